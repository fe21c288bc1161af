"""Window functions of ``summarize``: each adds a struct column with the window's fields to the rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CompileError
from ..functions.scalar import number
from ..lang import ast as A
from .expressions import Scope
from .rel import Ordered, Rel

#: Functions that read a value of the row; with a third or second argument the plain names do too.
VALUE_FORMS = {"tumbling_window_by": 2, "hopping_window_by": 3, "sliding_window_by": 2, "session_window": 2}
COUNT_FORMS = {"tumbling_window": 1, "hopping_window": 2, "sliding_window": 1, "count_window": 1}
SLIDING = ("sliding_window", "sliding_window_by")


def resolve(spec: A.WindowSpec, scope: Scope) -> tuple[str, list[float | int], A.Expr | None]:
    """The function, its sizes and the value expression, if it has one."""
    name, args = spec.function, list(spec.args)
    if name in COUNT_FORMS and len(args) == COUNT_FORMS[name] + 1 and name != "count_window":
        name += "_by"
    if name in VALUE_FORMS:
        n = VALUE_FORMS[name]
        sizes, value = args[: n - 1], args[-1] if len(args) == n else None
    elif name in COUNT_FORMS:
        n = COUNT_FORMS[name]
        sizes, value = args, None
    else:
        raise CompileError(f"unknown window function {spec.function!r}")
    if len(args) != n:
        raise CompileError(f"{name} takes {n} arguments, not {len(args)}")
    found = [scope.compile(s).literal for s in sizes]
    if any(not isinstance(s, (int, float)) or s <= 0 for s in found):
        raise CompileError(f"{name} takes sizes above 0")
    return name, found, value


def _fields(window_id: Column, start: Column, end: Column, kind: str, mode: str, **more: Column) -> Column:
    named = {"_id": window_id, "windowId": window_id, "start": start, "end": end, **more, "type": F.lit(kind), "mode": F.lit(mode)}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def assign(rel: Rel, spec: A.WindowSpec, scope: Scope, column: str) -> Rel:
    """``rel`` with the struct ``column``; a row in several windows is repeated."""
    name, sizes, value = resolve(spec, scope)
    if value is None:
        ordered = Ordered(rel).index("__i")
        df, at, mode = ordered.df, F.col("__i"), "count"
    else:
        v = number(scope.compile(value)).col
        df, at, mode = rel.df.withColumn("__i", v), F.col("__i"), "value"
        df = df.filter(at.isNotNull())
    build: Callable = {"tumbling": _tumbling, "count": _tumbling, "hopping": _hopping, "sliding": _sliding, "session": _session}[name.split("_")[0]]
    if build is _session:
        return _session(rel, v, sizes[0], column)
    out = build(df, at, sizes, mode, column, name)
    return rel.with_df(out.drop("__i"))


def _tumbling(df, at, sizes, mode, column, name):
    (size,) = sizes
    k = F.floor(at / size).cast("long") if mode == "count" else F.floor(at / size) * size
    start = k * size if mode == "count" else k
    if name == "count_window":
        return df.withColumn(column, _fields(k, start, start + size, "count", mode, count=F.lit(size)))
    return df.withColumn(column, _fields(k, start, start + size, "tumbling", mode, size=F.lit(size)))


def _hopping(df, at, sizes, mode, column, name):
    size, hop = sizes
    first = F.floor((at - size) / hop).cast("long") + 1
    last = F.floor(at / hop).cast("long")
    if mode == "count":
        first = F.greatest(first, F.lit(0).cast("long"))
    held = df.withColumn("__k", F.explode(F.sequence(first, last, F.lit(1).cast("long")))) if size >= hop else (
        df.withColumn("__k", last).filter(F.col("__k") >= first)
    )
    start = F.col("__k") * hop
    window_id = F.col("__k") if mode == "count" else start
    return held.withColumn(column, _fields(window_id, start, start + size, "hopping", mode, size=F.lit(size), hop=F.lit(hop))).drop("__k")


def _sliding(df, at, sizes, mode, column, name):
    (size,) = sizes
    start = F.greatest(F.lit(0).cast("long"), at - size + 1) if mode == "count" else at + 1 - size
    return df.withColumn(column, _fields(at, start, at + 1, "sliding", mode, size=F.lit(size)))


def tiles(at: Column, size: float, exact: bool) -> Column:
    """The tile of a value and, after it, the later ones with windows that may reach back to it. Of two values in a
    tile, the window of the larger one holds the other: tiles of whole numbers (``exact``) are a window long; those of
    doubles are a power of two long, so that they are cut without rounding, and values too large to be cut are alone."""
    if exact:
        own = F.call_function("div", at, F.lit(size)) - (at % F.lit(size) < 0).cast("long")
        return F.array(own, own + 1) if size > 1 else F.array(own)
    reach = size - 1.0
    if reach <= 0:
        return F.array(at)
    wide = math.ldexp(0.5, math.frexp(reach)[1])
    start = lambda v: F.when(F.abs(v / wide) < 2.0**53, F.floor(v / wide) * F.lit(wide)).otherwise(v)
    own, last = start(at), start(at + reach + (F.abs(at) + reach) * 2.0**-50)
    return F.filter(F.array_distinct(F.array(own, *[own + i * wide for i in (1, 2, 3)])), lambda t: t <= last)


def session_rows(rel: Rel, v: Column, timeout: float) -> Rel:
    """Rows with their session's number ``__sid``, from 1, and their value ``__v0``. A session ends where the next
    value is more than ``timeout`` later."""
    ordered = Ordered(rel.with_df(rel.df.withColumn("__v0", v).filter(F.col("__v0").isNotNull()))).lag("__p", F.col("__v0"))
    opens = F.col("__p").isNull() | (F.col("__v0") - F.col("__p.v") > timeout)
    return rel.with_df(ordered.running("__sid", opens.cast("long")).df.drop("__p"))


def session_fields(start: Column, last: Column, timeout: float) -> Column:
    """``end`` is the last value and the timeout."""
    return _fields(F.col("__sid"), start, last + timeout, "session", "value", timeout=F.lit(timeout))


def _session(rel: Rel, v: Column, timeout: float, column: str) -> Rel:
    """Rows joined with their session's bounds, for aggregates that read them row by row."""
    df = session_rows(rel, v, timeout).df
    bounds = df.groupBy("__sid").agg(F.min_by("__v0", F.struct(*rel.keys())).alias("__from"), F.max("__v0").alias("__to"))
    both = df.join(bounds, "__sid")
    fields = session_fields(F.col("__from"), F.col("__to"), timeout)
    return rel.with_df(both.withColumn(column, fields).drop("__sid", "__v0", "__from", "__to"))


def native_time(df, ts: str, size: str, hop: str | None = None) -> Column:
    """Spark's own event-time window, for streams with a watermark."""
    return F.window(F.col(ts), size, hop) if hop else F.window(F.col(ts), size)
