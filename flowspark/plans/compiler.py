"""Pipelines to data frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame

from ..errors import CompileError
from ..lang import ast as A
from ..operators import scan, summarize
from ..operators.expressions import Scope
from ..operators.rel import Rel
from ..sources import files


@dataclass
class Context:
    """What a pipeline may refer to. ``tee`` gets the rows of each ``insert_into``."""

    lookups: Mapping[str, Any] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    aggregates: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    js_concat: bool = False
    tee: Callable[[str, Rel], None] | None = None
    write: bool = True

    def scope(self, rel: Rel) -> Scope:
        return Scope.of(rel.df, rel.visible, self.lookups, self.functions, self.js_concat)


def where(rel: Rel, op: A.Where, context: Context) -> Rel:
    return rel.with_df(rel.df.filter(context.scope(rel).predicate(op.test)))


def select(rel: Rel, op: A.Select, context: Context) -> Rel:
    values = context.scope(rel).members(op.items)
    return Rel(rel.df.select(*[v.col.alias(k) for k, v in values.items()], *rel.order), list(values), rel.order)


def apply(rel: Rel, op: A.Op, context: Context) -> Rel:
    if isinstance(op, A.Where):
        return where(rel, op, context)
    if isinstance(op, A.Select):
        return select(rel, op, context)
    if isinstance(op, A.Summarize):
        return summarize.summarize(rel, op, context.scope(rel), context.aggregates)
    if isinstance(op, A.Scan):
        return scan.scan(rel, op, context.scope(rel))
    if isinstance(op, A.InsertInto):
        if context.tee:
            context.tee(op.target, rel)
        return rel
    if isinstance(op, A.WriteToFile):
        if context.write:
            files.write_rows(rel.result(), _path(op.path, context, rel), dict(op.options), rel.order and rel)
        return rel
    if isinstance(op, A.AssertExpected):
        if context.write:
            files.assert_or_save(rel, _path(op.path, context, rel))
        return rel
    raise CompileError(f"{type(op).__name__} can't be applied")


def _path(e: A.Expr, context: Context, rel: Rel) -> str:
    value = context.scope(rel).compile(e).literal
    if not isinstance(value, str):
        raise CompileError("a path is a constant text")
    return value


def compile_pipeline(rel: Rel, ops: tuple[A.Op, ...], context: Context) -> Rel:
    for i, op in enumerate(ops):
        if isinstance(op, A.WriteToFile) and i < len(ops) - 1:
            raise CompileError("write_to_file passes nothing on: it comes last")
        rel = apply(rel, op, context)
    return rel


def transform(pipeline: str, order_by: list[str] | None = None, **context: Any) -> Callable[[DataFrame], DataFrame]:
    """A function for ``DataFrame.transform`` from the operators of a pipeline, written without its source."""
    from ..lang.parser import parse_pipeline

    ops = parse_pipeline("_ | " + pipeline.strip().lstrip("|")).ops
    return lambda df: compile_pipeline(Rel.of(df, order_by), ops, Context(**context)).result()
