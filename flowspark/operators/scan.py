"""``scan`` over bounded data: running sums as windows, anything else as an ordered fold."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import CompileError
from ..functions.scalar import DOUBLE, LONG, NULL, STRING, Value, number
from ..lang import ast as A
from .expressions import Scope
from .machine import ScanMachine
from .rel import ORDER, Ordered, Rel


def _running_sum(op: A.Scan) -> tuple[str, A.Expr] | None:
    """The variable and its increment if the scan is one step, always true, that only adds to one variable."""
    if len(op.steps) != 1 or op.by:
        return None
    (step,) = op.steps
    if step.test != A.Lit(True) or len(step.assigns) != 1 or not step.emit:
        return None
    (a,) = step.assigns
    var = A.Field(A.Name(step.name), a.name)
    if a.step == step.name and isinstance(a.value, A.Binary) and a.value.op == "+" and a.value.left == A.Binary("||", var, A.Lit(0)):
        return a.name, a.value.right
    return None


def _state_types(op: A.Scan, scope: Scope) -> tuple[dict[str, dict[str, T.DataType]], dict[str, T.DataType], T.StructType]:
    """Types of the steps' variables, of fields assigned to rows, and of what is emitted, by a few rounds of typing."""
    state: dict[str, dict[str, T.DataType]] = {s.name: {} for s in op.steps}
    fields: dict[str, T.DataType] = dict(scope.fields)
    emitted = T.StructType([])

    def widen(a: T.DataType | None, b: T.DataType) -> T.DataType:
        if a is None or a == NULL or a == b:
            return b
        if b == NULL:
            return a
        return DOUBLE if isinstance(a, T.NumericType) and isinstance(b, T.NumericType) else STRING

    for _ in range(4):
        emitted = T.StructType([])
        for step in op.steps:
            def here(step=step) -> Scope:
                own = {n: Value(F.lit(None).cast(t), t) for n, t in state[step.name].items()}
                missing = {n: Value(F.lit(None).cast(t), t) for n, t in fields.items() if n not in scope.fields}
                mine = scope.struct(own) if own else Value(F.lit(None), NULL)
                return Scope(scope.df, scope.fields, scope.lookups, scope.functions, scope.js_concat, {**missing, step.name: mine})

            for a in step.assigns:
                kind = here().compile(a.value).type
                if a.step == step.name:
                    state[step.name][a.name] = widen(state[step.name].get(a.name), kind)
                elif a.step is None:
                    fields[a.name] = widen(fields.get(a.name), kind)
            if step.emit:
                for n, v in here().members(step.emit.items).items():
                    old = emitted[n].dataType if n in emitted.fieldNames() else None
                    kinds = {f.name: f.dataType for f in emitted.fields} | {n: widen(old, v.type)}
                    emitted = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    return state, fields, T.StructType([T.StructField(f.name, STRING if f.dataType == NULL else f.dataType) for f in emitted.fields])


def fit(value: Any, kind: T.DataType) -> Any:
    """A value as the schema wants it."""
    if value is None:
        return None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value)
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, T.BooleanType):
        return bool(value)
    return value


def _fold(op: A.Scan, lookups: Mapping[str, Any], names: list[str], keys: list[str], order: list[str], schema: T.StructType):
    arrow = to_arrow_schema(schema)
    n_fields = len(schema.fields) - len(order) - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, last = ScanMachine(op, lookups), None
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema.fields}
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    machine, last = ScanMachine(op, lookups), key
                for nth, made in enumerate(machine.push({n: row[n] for n in names})):
                    for f in schema.fields[:n_fields]:
                        out[f.name].append(fit(made.get(f.name), f.dataType))
                    for o in order:
                        out[o].append(row[o])
                    out["__nth"].append(nth)
            yield pa.RecordBatch.from_pydict(out, arrow)

    return fold


def scan(rel: Rel, op: A.Scan, scope: Scope) -> Rel:
    """Without ``by``, state is one for all rows, which then pass through one task in order; with it, keys are dealt
    out and each has its own. A fold holds one key's state and one batch of rows."""
    rel.keys()
    sum_of = _running_sum(op)
    if sum_of:
        name, increment = sum_of
        v = scope.compile(increment)
        if v.numeric:
            df = Ordered(rel).running("__sum", F.coalesce(number(v).col, F.lit(0))).df
            kind = LONG if isinstance(v.type, T.IntegralType) else DOUBLE
            step = op.steps[0]
            state = scope.struct({name: Value(F.col("__sum").cast(kind), kind)})
            inner = Scope(df, scope.fields, scope.lookups, scope.functions, scope.js_concat, {step.name: state})
            out = inner.members(step.emit.items)
            return Rel(df.select(*[x.col.alias(k) for k, x in out.items()], *rel.order), list(out), rel.order)
    _, _, emitted = _state_types(op, scope)
    if not emitted.fields:
        raise CompileError("the scan emits nothing")
    df, keys = rel.df, []
    for i, e in enumerate(op.by):
        keys.append(f"__k{i}")
        df = df.withColumn(keys[-1], scope.compile(e).col)
    lined = df.repartition(*keys) if keys else df.repartition(1)
    lined = lined.sortWithinPartitions(*keys, *rel.order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([*emitted.fields, *[T.StructField(o, kinds[o]) for o in rel.order], T.StructField("__nth", T.LongType())])
    names = [n for n in scope.fields if n in kinds]
    made = lined.select(*dict.fromkeys([*["`" + n + "`" for n in names], *keys, *rel.order])).mapInArrow(_fold(op, dict(scope.lookups), names, keys, rel.order, schema), schema)
    order = {f"{ORDER}_{i}": F.col(o) for i, o in enumerate([*rel.order, "__nth"])}
    visible = emitted.fieldNames()
    return Rel(made.select(*["`" + n + "`" for n in visible], *[c.alias(n) for n, c in order.items()]), visible, list(order))
