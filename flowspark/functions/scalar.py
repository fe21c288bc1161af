"""Scalar functions of the language: each builds a column from typed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError


@dataclass(frozen=True)
class Value:
    """A column and its type; literals keep their value."""

    col: Column
    type: T.DataType
    literal: object = None

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.VarcharType, T.CharType))

    @property
    def boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def null(self) -> bool:
        return isinstance(self.type, T.NullType)


LONG, DOUBLE, BOOL, STRING, NULL = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.NullType()


def truthy(v: Value) -> Column:
    """False for null, false, 0, NaN and the empty string."""
    if v.null:
        return F.lit(False)
    if v.boolean:
        return F.coalesce(v.col, F.lit(False))
    if v.numeric:
        test = v.col.isNotNull() & (v.col != 0)
        return F.coalesce(test & ~F.isnan(v.col), F.lit(False)) if isinstance(v.type, (T.DoubleType, T.FloatType)) else F.coalesce(test, F.lit(False))
    if v.text:
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def number(v: Value) -> Value:
    """Coerced to a number: text is parsed, true is 1, times are seconds; what can't be is null."""
    if v.numeric:
        return Value(v.col.cast("double"), DOUBLE) if isinstance(v.type, T.DecimalType) else v
    if v.boolean:
        return Value(v.col.cast("long"), LONG)
    if v.text:
        return Value(F.trim(v.col).try_cast("double"), DOUBLE)
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return Value(F.unix_micros(v.col.cast("timestamp")) / 1e6, DOUBLE)
    return Value(F.lit(None).cast("double"), DOUBLE)


def is_float(*values: Value) -> bool:
    return any(isinstance(v.type, (T.DoubleType, T.FloatType, T.DecimalType)) for v in values)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    a, b = number(a), number(b)
    if op == "/":
        return Value(F.try_divide(a.col.cast("double"), b.col.cast("double")), DOUBLE)
    if op == "%":
        kind = DOUBLE if is_float(a, b) else LONG
        return Value(F.try_mod(a.col.cast(kind), b.col.cast(kind)), kind)
    kind = DOUBLE if is_float(a, b) else LONG
    x, y = a.col.cast(kind), b.col.cast(kind)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], kind)


def comparable(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both sides in one type; None if a comparison has no meaning."""
    if a.null or b.null:
        return None
    if a.text and b.text or a.boolean and b.boolean:
        return a.col, b.col
    if type(a.type) is type(b.type) and not a.numeric:
        return a.col, b.col
    if (a.numeric or a.text or a.boolean or isinstance(a.type, (T.TimestampType, T.TimestampNTZType))) and (
        b.numeric or b.text or b.boolean or isinstance(b.type, (T.TimestampType, T.TimestampNTZType))
    ):
        return number(a).col, number(b).col
    return None


def loose_equal(a: Value, b: Value) -> Column:
    if a.null or b.null:
        return (F.lit(True) if a.null and b.null else b.col.isNull() if a.null else a.col.isNull())
    sides = comparable(a, b)
    if not sides:
        return F.lit(False)
    # A text that is no number becomes null, and yet isn't equal to a null.
    return sides[0].eqNullSafe(sides[1]) & (a.col.isNull() == b.col.isNull())


def strict_equal(a: Value, b: Value) -> Column:
    """Values of different kinds are never equal; null equals null."""
    if a.null or b.null:
        return loose_equal(a, b)
    if a.numeric and b.numeric or type(a.type) is type(b.type):
        return a.col.eqNullSafe(b.col)
    return F.lit(False)


def ordered(op: str, a: Value, b: Value) -> Column:
    sides = comparable(a, b)
    if sides is None:
        return F.lit(False)
    x, y = sides
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


Builder = Callable[..., Value]
SCALARS: dict[str, Builder] = {}


def scalar(name: str, least: int = 0, most: int | None = None):
    def register(build: Builder) -> Builder:
        def checked(*args: Value) -> Value:
            if len(args) < least or most is not None and len(args) > most:
                raise CompileError(f"{name} takes {least if least == most else f'{least} to {most or "any number of"}'} arguments, not {len(args)}")
            return build(*args)

        SCALARS[name] = checked
        return build

    return register


def _fold(name: str, op: str, empty: int) -> None:
    @scalar(name)
    def build(*args: Value) -> Value:
        if not args:
            return Value(F.lit(empty).cast("long"), LONG)
        return reduce(lambda a, b: arithmetic(op, a, b), args[1:], number(args[0]))


_fold("add", "+", 0)
_fold("sub", "-", 0)
_fold("mul", "*", 1)
_fold("div", "/", 1)
scalar("mod", 2, 2)(lambda a, b: arithmetic("%", a, b))
scalar("pow", 2, 2)(lambda a, b: Value(F.pow(number(a).col, number(b).col), DOUBLE))
scalar("neg", 1, 1)(lambda a: Value(-number(a).col, number(a).type))
scalar("abs", 1, 1)(lambda a: Value(F.abs(number(a).col), number(a).type))
scalar("eq", 2, 2)(lambda a, b: Value(loose_equal(a, b), BOOL))
scalar("ne", 2, 2)(lambda a, b: Value(~loose_equal(a, b), BOOL))
scalar("lt", 2, 2)(lambda a, b: Value(ordered("<", a, b), BOOL))
scalar("le", 2, 2)(lambda a, b: Value(ordered("<=", a, b), BOOL))
scalar("gt", 2, 2)(lambda a, b: Value(ordered(">", a, b), BOOL))
scalar("ge", 2, 2)(lambda a, b: Value(ordered(">=", a, b), BOOL))
scalar("and")(lambda *a: Value(reduce(lambda x, y: x & y, map(truthy, a), F.lit(True)), BOOL))
scalar("or")(lambda *a: Value(reduce(lambda x, y: x | y, map(truthy, a), F.lit(False)), BOOL))
scalar("not", 1, 1)(lambda a: Value(~truthy(a), BOOL))
scalar("pi", 0, 0)(lambda: Value(F.pi(), DOUBLE))


def _extreme(name: str, pick) -> None:
    @scalar(name)
    def build(*args: Value) -> Value:
        if not args:
            return Value(F.lit(None), NULL)
        if len(args) == 1:
            return args[0]
        same = all(type(a.type) is type(args[0].type) for a in args)
        values = args if same else [Value(number(a).col.cast("double"), DOUBLE) for a in args]
        return Value(pick(*[v.col for v in values]), values[0].type)


_extreme("min", F.least)
_extreme("max", F.greatest)


@scalar("exp")
def _exp(*args: Value) -> Value:
    """Null for anything but one number."""
    if len(args) != 1 or not args[0].numeric:
        return Value(F.lit(None).cast("double"), DOUBLE)
    return Value(F.exp(args[0].col), DOUBLE)


def _text(v: Value) -> Column:
    return v.col.cast("string")


def _length(v: Value) -> Value:
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return Value(F.when(v.col.isNotNull(), F.size(v.col)).cast("long"), LONG)
    return Value(F.length(_text(v)).cast("long"), LONG)


scalar("length", 1, 1)(_length)
scalar("array_length", 1, 1)(_length)
scalar("to_upper", 1, 1)(lambda a: Value(F.upper(_text(a)), STRING))
scalar("to_lower", 1, 1)(lambda a: Value(F.lower(_text(a)), STRING))
scalar("format_date", 2, 2)(lambda a, f: Value(F.date_format(a.col.cast("timestamp"), f.literal), STRING))
scalar("now", 0, 0)(lambda: Value(F.unix_micros(F.current_timestamp()) / 1e6, DOUBLE))
scalar("epoch", 1, 1)(lambda a: Value(F.floor(number(a).col).cast("long"), LONG))
scalar("exists", 1, 1)(lambda a: Value(a.col.isNotNull(), BOOL))
scalar("coalesce", 1)(lambda *a: Value(F.coalesce(*[x.col for x in a]), a[0].type))
scalar("round", 1, 2)(lambda a, n=None: Value(F.round(number(a).col, n.literal if n else 0), number(a).type))
scalar("floor", 1, 1)(lambda a: Value(F.floor(number(a).col).cast("long"), LONG))
scalar("ceil", 1, 1)(lambda a: Value(F.ceil(number(a).col).cast("long"), LONG))
scalar("sqrt", 1, 1)(lambda a: Value(F.sqrt(number(a).col), DOUBLE))
