"""Aggregate functions, each as parts that merge: for grouping, for windows over partial sums, and for running results.

``parts`` are aggregate expressions over rows, ``merges`` name how partial results of two pieces combine, and ``final``
makes the result from the merged parts. What has no such form (median, percentile) only has ``whole``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalar import DOUBLE, LONG, Value, number, truthy


@dataclass(frozen=True)
class Aggregate:
    parts: tuple[Column, ...]
    merges: tuple[str, ...]  # sum, min, max, last: how each part combines with later ones
    final: Callable[..., Column]
    type: T.DataType
    whole: Column | None = None  # the result in one go; without parts it is the only form


def clean_number(v: Value) -> Column:
    """A double; what isn't a number, NaN and empty text are null."""
    n = number(v).col.cast("double")
    return F.when(~F.isnan(n), n)


def _count(*args: Value) -> Aggregate:
    return Aggregate((F.count(F.lit(1)),), ("sum",), lambda n: F.coalesce(n, F.lit(0)).cast("long"), LONG)


def _sum(v: Value) -> Aggregate:
    n = number(v)
    if isinstance(n.type, T.IntegralType):
        return Aggregate((F.sum(n.col.cast("long")),), ("sum",), lambda s: F.coalesce(s, F.lit(0).cast("long")), LONG)
    return Aggregate((F.sum(clean_number(v)),), ("sum",), lambda s: F.coalesce(s, F.lit(0.0)), DOUBLE)


def _avg(v: Value) -> Aggregate:
    x = clean_number(v)
    return Aggregate((F.sum(x), F.count(x)), ("sum", "sum"), lambda s, n: F.try_divide(s, n.cast("double")), DOUBLE)


def _extreme(f, how: str):
    return lambda v: Aggregate((f(v.col),), (how,), lambda x: x, v.type)


def _moments(whole: Callable[[Column], Column], of: Callable[[Column], Column]):
    """Squares are taken about each piece's own mean; what lies between the means is added when pieces merge."""

    def build(v: Value) -> Aggregate:
        x = clean_number(v)
        n = F.count(x)
        parts = (n, F.sum(x), F.var_pop(x) * n, F.avg(x) * F.sum(x))
        return Aggregate(parts, ("sum",) * 4, lambda *p: of(_variance(*p)), DOUBLE, whole(x))

    return build


def _variance(n: Column, total: Column, within: Column, between: Column) -> Column:
    return F.when(n > 1, (within + F.greatest(between - total * total / n, F.lit(0.0))) / (n - 1))


def _whole(f: Callable[..., Column], kind: T.DataType = DOUBLE):
    return lambda *a: Aggregate((), (), lambda: F.lit(None), kind, f(*a))


AGGREGATES: dict[str, Callable[..., Aggregate]] = {
    "count": _count,
    "sum": _sum,
    "avg": _avg,
    "min": _extreme(F.min, "min"),
    "max": _extreme(F.max, "max"),
    "variance": _moments(F.variance, lambda x: x),
    "stddev": _moments(F.stddev, F.sqrt),
    "median": _whole(lambda v: F.median(clean_number(v))),
    "percentile": _whole(lambda v, p: F.percentile(clean_number(v), F.lit(p.literal if p.literal <= 1 else p.literal / 100))),
    "count_distinct": _whole(lambda v: F.count_distinct(v.col), LONG),
    "count_if": lambda c: Aggregate((F.sum(truthy(c).cast("long")),), ("sum",), lambda n: F.coalesce(n, F.lit(0).cast("long")), LONG),
    "sum_if": lambda v, c: Aggregate((F.sum(F.when(truthy(c), clean_number(v))),), ("sum",), lambda s: F.coalesce(s, F.lit(0.0)), DOUBLE),
    "avg_if": lambda v, c: Aggregate(
        (F.sum(F.when(truthy(c), clean_number(v))), F.count(F.when(truthy(c), clean_number(v)))), ("sum", "sum"), lambda s, n: F.try_divide(s, n.cast("double")), DOUBLE
    ),
}
#: Names that are scalar functions with two or more arguments and aggregates with one.
BOTH = ("min", "max")


def last_value(col: Column, kind: T.DataType, order: list[Column]) -> Aggregate:
    """The value of the last row in order, null included."""
    part = F.max_by(F.struct(F.struct(*order).alias("o"), col.alias("v")), F.struct(*order))
    return Aggregate((part,), ("last",), lambda x: x["v"], kind)
