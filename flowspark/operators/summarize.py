"""``summarize``: plain, windowed, or emitting running results when a trigger fires."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from ..functions.aggregates import AGGREGATES, BOTH, Aggregate, last_value
from ..functions.scalar import Value, number
from ..lang import ast as A
from . import windows
from .expressions import Scope
from .rel import ORDER, Ordered, Rel

#: An ``every`` interval from here on counts milliseconds, below it rows.
CLOCK_INTERVAL = 100
#: Rows of a sliding window's block, beyond the window's own length.
BLOCK = 65_536


@dataclass
class Plan:
    """Aggregates by temporary name, and the items rewritten to read those names."""

    aggregates: dict[str, Aggregate] = field(default_factory=dict)
    items: list[A.Item] = field(default_factory=list)


class Planner:
    def __init__(self, scope: Scope, order: list[Column] | None, window: str | None, keys: dict[A.Expr, str], custom):
        self.scope, self.order, self.window, self.keys, self.custom = scope, order, window, keys, custom
        self.plan = Plan()
        self.known: dict[A.Expr, str] = {}

    def items(self, items: tuple[A.Item, ...]) -> Plan:
        for it in items:
            if isinstance(it, A.SpreadAll):
                raise CompileError("...* has no meaning in summarize")
            self.plan.items.append(A.Prop(it.key, self.rewrite(it.value)) if isinstance(it, A.Prop) else it)
        return self.plan

    def is_aggregate(self, e: A.Expr) -> bool:
        name = e.name.lower() if isinstance(e, A.Call) else ""
        if name in self.custom:
            return True
        return name in AGGREGATES and (name not in BOTH or len(e.args) == 1)

    def has_aggregate(self, e) -> bool:
        if self.is_aggregate(e):
            return True
        return any(self.has_aggregate(x) for x in _children(e))

    def aggregates_in(self, items: tuple[A.Item, ...]) -> list[A.Expr]:
        todo = [it.value for it in items if isinstance(it, (A.Prop, A.Spread))]
        found = []
        while todo:
            e = todo.pop()
            if self.is_aggregate(e):
                found.append(e)
            else:
                todo += _children(e)
        return found

    def rewrite(self, e: A.Expr) -> A.Expr:
        if e in self.keys:
            return A.Name(self.keys[e])
        if self.is_aggregate(e):
            return self.keep(e, self.aggregate(e))
        if self.has_aggregate(e):
            return _map_children(e, self.rewrite)
        names = set(_names(e))
        if not names or names == {self.window}:
            return e
        if self.window in names:
            return _map_children(e, self.rewrite)
        if self.order is None:
            raise CompileError(f"a field outside an aggregate is its last value in order: give the stream an order_by ({sorted(names)})")
        v = self.scope.compile(e)
        return self.keep(e, last_value(v.col, v.type, self.order))

    def keep(self, e: A.Expr, agg: Aggregate) -> A.Expr:
        if e not in self.known:
            self.known[e] = f"__a{len(self.plan.aggregates)}"
            self.plan.aggregates[self.known[e]] = agg
        return A.Name(self.known[e])

    def aggregate(self, e: A.Call) -> Aggregate:
        name = e.name.lower()
        if any(self.has_aggregate(a) for a in e.args):
            raise CompileError(f"{e.name} of an aggregate")
        args = [] if name == "count" else [self.scope.compile(a) for a in e.args]
        if name in self.custom:
            whole = self.custom[name](*[a.col for a in args])
            return Aggregate((), (), lambda: F.lit(None), self.scope.df.agg(whole.alias("x")).schema[0].dataType, whole)
        try:
            return AGGREGATES[name](*args)
        except TypeError as error:
            raise CompileError(f"{e.name}: wrong number of arguments") from error


def _children(e) -> list[A.Expr]:
    if isinstance(e, (A.Lit, A.Name)) or not isinstance(e, A.Expr):
        return []
    out = []
    for v in e.__dict__.values():
        for x in v if isinstance(v, tuple) else (v,):
            if isinstance(x, A.Expr):
                out.append(x)
            elif isinstance(x, (A.Prop, A.Spread)):
                out.append(x.value)
    return out


def _map_children(e: A.Expr, f) -> A.Expr:
    def one(x):
        if isinstance(x, A.Expr):
            return f(x)
        if isinstance(x, A.Prop):
            return A.Prop(x.key, f(x.value))
        if isinstance(x, A.Spread):
            return A.Spread(f(x.value))
        return x

    if isinstance(e, (A.Lit, A.Name)):
        return e
    return type(e)(**{k: tuple(map(one, v)) if isinstance(v, tuple) else one(v) for k, v in e.__dict__.items()})


def _names(e) -> Iterator[str]:
    if isinstance(e, A.Name):
        yield e.name
    for x in _children(e):
        yield from _names(x)


def summarize(rel: Rel, op: A.Summarize, scope: Scope, custom=None) -> Rel:
    column = op.window.name if op.window else None
    if op.emit:
        return _emitting(rel, op, scope, custom or {})
    if op.window and op.window.function == "session_window" and (found := _sessions(rel, op, scope, column, custom or {})):
        return found
    if op.window:
        hidden = "__w"
        rel = windows.assign(rel, op.window, scope, hidden)
        scope = Scope(rel.df, scope.fields, scope.lookups, scope.functions, scope.js_concat, {column: scope_value(rel.df, hidden)})
        if op.window.function in windows.SLIDING:
            return _sliding(rel, op, scope, column, custom or {})
    df, key_names, keys = _with_keys(rel.df, op.by, scope)
    planner = Planner(scope, rel.keys() if rel.order else None, column, keys, custom or {})
    plan = planner.items(op.items)
    by = [*(["__w"] if column else []), *key_names]
    first = [F.min(F.struct(*rel.keys())).alias("__first")] if rel.order else []
    parts = _part_columns(plan)
    grouped = df.groupBy(*by) if by else df.groupBy()
    out = grouped.agg(*[c.alias(n) for n, c in parts.items()], *first) if parts or first else grouped.agg(F.count(F.lit(1)).alias("__rows"))
    order = {}
    if column:
        order[f"{ORDER}_0"] = F.col("__w.start")
    if first:
        order[f"{ORDER}_{len(order)}"] = F.col("__first")
    return _finish(out, plan, key_names, column, order, scope)


def _sessions(rel: Rel, op: A.Summarize, scope: Scope, column: str, custom) -> Rel | None:
    """Sessions whose bounds come from their own groups, so rows are grouped once; None if an aggregate or a key reads
    the bounds row by row."""
    _, (timeout,), value = windows.resolve(op.window, scope)
    rows = windows.session_rows(rel, number(scope.compile(value)).col, timeout)
    kind = rows.df.schema["__v0"].dataType
    shape = rows.df.select(windows.session_fields(F.col("__v0"), F.col("__v0"), timeout).alias("__w"))
    scope = Scope(rows.df, scope.fields, scope.lookups, scope.functions, scope.js_concat, {column: scope_value(shape, "__w")})
    planner = Planner(scope, rows.keys(), column, {e: f"__k{i}" for i, e in enumerate(op.by)}, custom)
    read = [*op.by, *planner.aggregates_in(op.items)]
    if any(column in _names(e) for e in read):
        return None
    df, key_names, _ = _with_keys(rows.df, op.by, scope)
    plan = planner.items(op.items)
    bounds = {"__first": F.min(F.struct(*rows.keys(), F.col("__v0").alias("v"))), "__last": F.max("__v0")}
    out = df.groupBy("__sid", *key_names).agg(*[c.alias(n) for n, c in (_part_columns(plan) | bounds).items()])
    start, last = F.col("__first"), F.col("__last")
    if key_names:
        session = Window.partitionBy("__sid")
        start, last = F.min("__first").over(session), F.max("__last").over(session)
    out = out.withColumn("__w", windows.session_fields(start["v"].cast(kind), last, timeout))
    return _finish(out, plan, key_names, column, {f"{ORDER}_0": F.col("__sid"), f"{ORDER}_1": F.col("__first")}, scope)


def scope_value(df: DataFrame, name: str) -> Value:
    return Value(F.col(name), df.schema[name].dataType)


def _with_keys(df: DataFrame, by: tuple[A.Expr, ...], scope: Scope) -> tuple[DataFrame, list[str], dict[A.Expr, str]]:
    names, keys = [], {}
    for i, e in enumerate(by):
        names.append(f"__k{i}")
        keys[e] = names[-1]
        df = df.withColumn(names[-1], scope.compile(e).col)
    return df, names, keys


def _part_columns(plan: Plan) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, agg in plan.aggregates.items():
        if agg.whole is not None:
            out[name] = agg.whole
            continue
        for i, p in enumerate(agg.parts):
            out[f"{name}_{i}"] = p
    return out


def _finish(df: DataFrame, plan: Plan, keys: list[str], column: str | None, order: dict[str, Column], scope: Scope) -> Rel:
    """Final aggregates, then the items over them; the window's fields follow the others."""
    finals = {n: a.final(*[F.col(f"{n}_{i}") for i in range(len(a.parts))]) for n, a in plan.aggregates.items() if a.whole is None}
    df = df.withColumns(finals) if finals else df
    local = {column: scope_value(df, "__w")} if column else {}
    visible = [*plan.aggregates, *keys]
    inner = Scope.of(df, visible, scope.lookups, scope.functions, scope.js_concat)
    inner.local = local
    props = inner.members(tuple(i for i in plan.items if isinstance(i, A.Prop)))
    for it in plan.items:
        if isinstance(it, A.Spread):
            props |= inner.spread(inner.compile(it.value))
    for it in plan.items:
        if isinstance(it, A.Exclude):
            props.pop(it.key, None)
    return Rel(df.select(*[v.col.alias(k) for k, v in props.items()], *[c.alias(n) for n, c in order.items()]), list(props), list(order))


def _sliding(rel: Rel, op: A.Summarize, scope: Scope, column: str, custom) -> Rel:
    """Each row's trailing window. Windows over values merge where their aggregates do. Else rows lie in blocks of
    consecutive places; a block also holds, as a halo, the rows before it that its windows reach back to, so blocks are
    independent and a row is in two at most."""
    name, sizes, value = windows.resolve(op.window, scope)
    size = sizes[0]
    span = max(8 * size, BLOCK if name == "sliding_window" else 8 * size)
    df, key_names, keys = _with_keys(rel.df, op.by, scope)
    plan = Planner(scope, rel.keys() if rel.order else None, column, keys, custom).items(op.items)
    at = F.col("__w._id")
    if value is not None and size >= 1 and plan.aggregates and all(a.whole is None for a in plan.aggregates.values()):
        out = _sliding_merged(df, plan, key_names, size)
        return _finish(out, plan, key_names, column, {n: F.col(n) for n in rel.order} or {f"{ORDER}_0": at}, scope)
    block = F.floor(at / span).cast("long")
    reaches = F.floor((at + (size - 1)) / span).cast("long")
    df = df.withColumn("__block", block).withColumn("__in", F.explode(F.sequence(block, reaches)))
    frame = Window.partitionBy("__in", *key_names).orderBy(at).rangeBetween(-(size - 1), 0)
    parts = _part_columns(plan)
    out = df.withColumns({n: c.over(frame) for n, c in parts.items()}).filter(F.col("__in") == F.col("__block"))
    order = {n: F.col(n) for n in rel.order} or {f"{ORDER}_0": at}
    return _finish(out, plan, key_names, column, order, scope)


def _sliding_merged(df: DataFrame, plan: Plan, key_names: list[str], size: float) -> DataFrame:
    """Rows with the merged parts of their trailing windows of values.

    Rows of one key and value share a window, so they are summed first. Values lie in tiles that are no wider than a
    window: what a window holds of its own tile runs along from the tile's start, what it holds of earlier ones runs
    along from their end, down to the window's. So each sum is read a few times, however many a window holds.
    """
    exact = float(size).is_integer() and isinstance(df.schema["__w"].dataType["_id"].dataType, T.IntegralType)
    size = int(size) if exact else size
    df = df.withColumn("__at", F.col("__w._id").cast("long" if exact else "double"))
    at, own = F.col("__at"), F.col("__far") == 0
    sums = df.groupBy("__at", *key_names).agg(*[c.alias(n) for n, c in _part_columns(plan).items()])
    sums = sums.select("*", F.posexplode(windows.tiles(at, size, exact)).alias("__far", "__tile"))
    low = F.coalesce(F.try_subtract(at, F.lit(size - 1)), F.lit(-(2**63))) if exact else at - F.lit(size - 1.0)
    sums = sums.withColumn("__edge", F.when(own, low).otherwise(at))
    tile = Window.partitionBy("__tile", *key_names)
    here = tile.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = tile.orderBy(F.desc("__edge")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running, merged = {}, []
    for name, agg in plan.aggregates.items():
        for i, how in enumerate(agg.merges):
            n = f"{name}_{i}"
            merge, both = _JOINED[how]
            if how == "last" and isinstance(sums.schema[n].dataType["v"].dataType, (T.NumericType, T.StringType, T.DatetimeType)):
                merge = F.max  # the order comes first in the struct; cheaper, for values that have an order themselves
            running |= {f"{n}_h": merge(F.when(own, F.col(n))).over(here), f"{n}_b": merge(F.when(~own, F.col(n))).over(before)}
            merged.append(both(F.col(f"{n}_h"), F.col(f"{n}_b")).alias(n))
    found = sums.withColumns(running).filter(own).select("__at", *key_names, *merged)
    return _null_safe(df, found, key_names, "__at")


# Emitting


def greedy_triggers(step: float):
    """Marks rows whose value is ``step`` or more beyond the last marked one; the first is marked. Rows stream through
    one task in order, with a single number of state."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            hits = []
            for v in b.column("v").to_pylist():
                hit = v is not None and (last is None or v - last >= step)
                last = v if hit else last
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(hits, pa.bool_())], ["__j", "hit"])

    return mark


def _epochs(rel: Rel, op: A.Summarize, scope: Scope, key_names: list[str]) -> DataFrame:
    """Rows with ``__hit``, whether the row fires the trigger, and ``__e``, the number of triggers before it: a trigger
    is the last row of its epoch."""
    emit = op.emit
    if emit.kind == "every_interval":
        raise CompileError("emit every_interval counts milliseconds of the clock: it needs a running stream")
    if emit.kind in ("every", "every_count") and emit.value is None:
        n = scope.compile(emit.interval).literal
        if not isinstance(n, (int, float)) or n <= 0:
            raise CompileError("emit every takes a number above 0")
        if emit.kind == "every" and n >= CLOCK_INTERVAL:
            raise CompileError(f"emit every {n} counts milliseconds of the clock: it needs a running stream")
        i = F.col("__i")
        df = Ordered(rel).index("__i").df
        if emit.kind == "every":
            return df.withColumns({"__hit": i % n == 0, "__e": F.ceil(i / n).cast("long")})
        return df.withColumns({"__hit": (i + 1) % n == 0, "__e": F.floor(i / n).cast("long")})
    if emit.kind == "every":
        step = scope.compile(emit.interval).literal
        ordered = Ordered(rel.with_df(rel.df.withColumn("__x", number(scope.compile(emit.value)).col.cast("double")))).index("__i")
        line = ordered.df.select(F.col("__i").alias("i"), F.col("__x").alias("v")).repartition(1).sortWithinPartitions("i")
        hits = line.mapInArrow(greedy_triggers(step), "__j long, __hit boolean")
        ordered.df = ordered.df.join(hits, F.col("__i") == F.col("__j")).drop("__j", "__x")
    else:
        ordered = Ordered(rel)
        if emit.kind == "when":
            hit = scope.test(emit.value)
        elif emit.kind == "update":
            hit = F.lit(True)
        else:
            value = scope.compile(emit.value).col if emit.kind == "change" else F.struct(*key_names) if key_names else F.lit(0)
            ordered = ordered.lag("__p", value)
            hit = F.col("__p").isNull() | ~value.eqNullSafe(F.col("__p.v"))
        ordered.df = ordered.df.withColumn("__hit", hit)
    return ordered.running("__e", F.col("__hit").cast("long"), inclusive=False).df


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
#: How parts merge that come in any order, and how two results do, the second of which may be null.
_JOINED = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.max_by(c, c["o"]), lambda a, b: F.when(b.isNull() | (a["o"] >= b["o"]), a).otherwise(b)),
}


def _emitting(rel: Rel, op: A.Summarize, scope: Scope, custom) -> Rel:
    """At each trigger, the running results of all groups seen so far, and all once more at the end.

    Rows are first summed per group and epoch; groups are then expanded over the epochs from their first one, and
    merged in order. So the work on rows is one partial aggregation, and the rest is as long as the result.
    """
    df, key_names, keys = _with_keys(rel.df, op.by, scope)
    plan = Planner(scope, rel.keys(), None, keys, custom).items(op.items)
    for name, agg in plan.aggregates.items():
        if agg.parts:
            plan.aggregates[name] = replace(agg, whole=None)
        elif agg.whole is not None:
            raise CompileError("this aggregate can't run along with emit: its partial results don't merge")
    rows = _epochs(rel.with_df(df), op, scope, key_names)
    parts = _part_columns(plan)
    first = F.min(F.struct(*rel.keys()))
    if not key_names:
        rows, key_names = rows.withColumn("__k0", F.lit(0)), ["__k0"]
    sums = rows.groupBy(*key_names, "__e").agg(*[c.alias(n) for n, c in parts.items()], first.alias("__f"))
    n_triggers = rows.agg(F.sum(F.col("__hit").cast("long"))).first()[0] or 0
    groups = sums.groupBy(*key_names).agg(F.min("__e").alias("__from"), F.min("__f").alias("__first"))
    grid = groups.withColumn("__e", F.explode(F.sequence(F.col("__from"), F.lit(n_triggers).cast("long"))))
    joined = _null_safe(grid, sums.drop("__f"), key_names)
    w = Window.partitionBy(*key_names).orderBy("__e").rowsBetween(Window.unboundedPreceding, 0)
    merged = {}
    for name, agg in plan.aggregates.items():
        for i, how in enumerate(agg.merges):
            merged[f"{name}_{i}"] = _MERGE[how](F.col(f"{name}_{i}")).over(w)
    out = joined.withColumns(merged) if merged else joined
    order = {f"{ORDER}_0": F.col("__e"), f"{ORDER}_1": F.col("__first")}
    return _finish(out, plan, key_names, None, order, scope)


def _null_safe(grid: DataFrame, sums: DataFrame, key_names: list[str], at: str = "__e") -> DataFrame:
    named = sums.select(*[F.col(k).alias(f"{k}_r") for k in (*key_names, at)], *[c for c in sums.columns if c not in key_names and c != at])
    on = F.col(at) == F.col(f"{at}_r")
    for k in key_names:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return grid.join(named, on, "left").drop(f"{at}_r", *[f"{k}_r" for k in key_names])
