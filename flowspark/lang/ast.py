"""Syntax tree of the pipe language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Field(Expr):
    base: Expr
    name: str


@dataclass(frozen=True)
class Index(Expr):
    base: Expr
    at: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    value: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Choice(Expr):
    test: Expr
    yes: Expr
    no: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    value: Expr
    options: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Lambda(Expr):
    params: tuple[str, ...]
    body: Expr


@dataclass(frozen=True)
class Method(Expr):
    base: Expr
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class ArrayLit(Expr):
    items: tuple[Expr, ...]


class Item:
    pass


@dataclass(frozen=True)
class Prop(Item):
    key: str
    value: Expr


@dataclass(frozen=True)
class SpreadAll(Item):
    pass


@dataclass(frozen=True)
class Spread(Item):
    value: Expr


@dataclass(frozen=True)
class Exclude(Item):
    key: str


@dataclass(frozen=True)
class ObjectLit(Expr):
    items: tuple[Item, ...]


class Op:
    pass


@dataclass(frozen=True)
class Where(Op):
    test: Expr


@dataclass(frozen=True)
class Select(Op):
    items: tuple[Item, ...]


@dataclass(frozen=True)
class WindowSpec:
    name: str
    function: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class EmitSpec:
    kind: str  # every, when, change, group_change, update, every_count, every_interval
    interval: Expr | None = None
    value: Expr | None = None


@dataclass(frozen=True)
class Summarize(Op):
    items: tuple[Item, ...]
    by: tuple[Expr, ...] = ()
    window: WindowSpec | None = None
    emit: EmitSpec | None = None


@dataclass(frozen=True)
class Assign:
    step: str | None
    name: str
    value: Expr


@dataclass(frozen=True)
class Step:
    name: str
    test: Expr
    assigns: tuple[Assign, ...]
    emit: ObjectLit | None


@dataclass(frozen=True)
class Scan(Op):
    steps: tuple[Step, ...]
    by: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class InsertInto(Op):
    target: str


@dataclass(frozen=True)
class WriteToFile(Op):
    path: Expr
    options: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class AssertExpected(Op):
    path: Expr


@dataclass(frozen=True)
class Pipeline:
    source: str
    ops: tuple[Op, ...]


@dataclass(frozen=True)
class Statement:
    kind: str
    name: str | None = None
    mode: str = ""  # "", replace, if_not_exists
    pipeline: Pipeline | None = None
    value: Expr | None = None
    ttl: Expr | None = None
    text: str = field(default="", compare=False)
