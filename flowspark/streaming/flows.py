"""Flows over live data, on Structured Streaming.

``where`` and ``select`` stay expressions. Windows over a time column, on a stream with a watermark, are Spark's own.
Other ordered operators run as state machines: state is dealt out by the operator's keys where its rules allow that,
and is one for the stream where they don't. Rows of a micro-batch are taken in order of the stream's order key.
"""

from __future__ import annotations

import json
import os
import pickle
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import CompileError
from ..lang import ast as A
from ..lang.parser import parse_pipeline
from ..operators.rel import Rel
from ..operators.scan import fit
from ..plans.compiler import Context, apply, compile_pipeline
from .machines import machine

#: A row of a stream with this column true asks the machines to emit what they hold.
FLUSH = "__flush"


@dataclass
class LandingFolder:
    """A folder of NDJSON files that a stream reads; each insert is one file, moved in when complete."""

    path: str

    def insert(self, docs: list[dict[str, Any]]) -> None:
        os.makedirs(self.path, exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        part = os.path.join(self.path, f".{name}")
        with open(part, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(d, default=str) + "\n" for d in docs)
        os.rename(part, os.path.join(self.path, name))

    def flush(self) -> None:
        self.insert([{FLUSH: True}])

    def stream(self, spark, schema: str, max_files: int | None = None) -> DataFrame:
        """``max_files`` bounds what one micro-batch takes, so that a backlog is worked off in pieces."""
        os.makedirs(self.path, exist_ok=True)
        reader = spark.readStream.schema(f"{schema}, {FLUSH} boolean")
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(self.path)


def _event_time(op: A.Summarize, kinds: Mapping[str, T.DataType]) -> tuple[str, list[float]] | None:
    """The time column and sizes in seconds if the window is one that Spark has."""
    w = op.window
    if not w or w.function not in ("tumbling_window_by", "hopping_window_by") or not all(isinstance(a, A.Lit) for a in w.args[:-1]):
        return None
    value = w.args[-1]
    if isinstance(value, A.Call) and value.name.lower() == "epoch" and len(value.args) == 1:
        value = value.args[0]
    if not isinstance(value, A.Name) or not isinstance(kinds.get(value.name), (T.TimestampType, T.TimestampNTZType)):
        return None
    return value.name, [a.value for a in w.args[:-1]]


def _native_windows(df: DataFrame, visible: list[str], op: A.Summarize, at: tuple[str, list[float]], watermark: str, context: Context) -> Rel:
    from ..operators.summarize import Planner, _finish, _part_columns, _with_keys

    column, sizes = at
    seconds = [f"{s} seconds" for s in sizes]
    timed = df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark)
    scope = context.scope(Rel(timed, visible))
    timed, key_names, keys = _with_keys(timed, op.by, scope)
    plan = Planner(scope, None, op.window.name, keys, context.aggregates).items(op.items)
    grouped = timed.groupBy(F.window(column, *seconds).alias("__win"), *key_names).agg(*[c.alias(n) for n, c in _part_columns(plan).items()])
    start, end = (F.col(f"__win.{x}").cast("long") for x in ("start", "end"))
    kind = op.window.function.split("_")[0]
    fields = {"_id": start, "windowId": start, "start": start, "end": end, "size": F.lit(sizes[0])} | ({"hop": F.lit(sizes[1])} if len(sizes) > 1 else {})
    w = F.struct(*[c.alias(n) for n, c in fields.items()], F.lit(kind).alias("type"), F.lit("value").alias("mode"))
    return _finish(grouped.withColumn("__w", w), plan, key_names, op.window.name, {}, scope)


def _with_state(df: DataFrame, visible: list[str], op: A.Op, order: list[str], context: Context) -> Rel:
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name in visible]
    empty = spark.createDataFrame([], T.StructType(fields))
    # Types don't depend on when results are emitted, and clocks have no meaning for bounded rows.
    typed = replace(op, emit=None) if isinstance(op, A.Summarize) else op
    known = apply(Rel.of(empty, [o for o in order if o in visible] or visible[:1]), typed, context)
    out = T.StructType([T.StructField(n, known.df.schema[n].dataType) for n in known.visible])
    plain = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.NullType, T.VariantType)) else f.dataType) for f in out.fields])
    lookups = dict(context.lookups)

    def step(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = pickle.loads(state.get[0]) if state.exists else machine(op, lookups)
        rows = pd.concat(list(frames))
        made: list[dict[str, Any]] = []
        asks = rows[FLUSH].eq(True) if FLUSH in rows else pd.Series(False, index=rows.index)
        body = rows[~asks]
        if order:
            body = body.sort_values([o for o in order if o in body], kind="stable")
        for r in body[visible].astype(object).where(body[visible].notna(), None).to_dict("records"):
            made += m.push({k: v.item() if hasattr(v, "item") else v for k, v in r.items()})
        if asks.any():
            made += m.flush()
        state.update((pickle.dumps(m),))
        yield pd.DataFrame({f.name: pd.Series([fit(r.get(f.name), f.dataType) for r in made], dtype=object) for f in plain.fields})

    by = getattr(op, "by", ()) if isinstance(op, A.Scan) else ()
    scope = context.scope(Rel(df, visible))
    keyed = df.withColumns({f"__k{i}": scope.compile(e).col.cast("string") for i, e in enumerate(by)} or {"__k0": F.lit("all")})
    keys = [f"__k{i}" for i in range(max(1, len(by)))]
    made = keyed.groupBy(*keys).applyInPandasWithState(step, plain, "machine binary", "append", GroupStateTimeout.NoTimeout)
    return Rel(made, plain.fieldNames())


def compile_stream(df: DataFrame, ops: tuple[A.Op, ...], context: Context, order_by: list[str] | None = None, watermark: str = "0 seconds") -> tuple[Rel, tuple[A.Op, ...]]:
    """The streaming plan of the leading operators, and the operators that are left for each micro-batch: sinks, and
    what follows them."""
    flush = FLUSH in df.columns
    rel, order = Rel(df, [c for c in df.columns if c != FLUSH]), list(order_by or [])
    stateful = False
    for i, op in enumerate(ops):
        if isinstance(op, (A.InsertInto, A.WriteToFile, A.AssertExpected)):
            return rel, ops[i:]
        if isinstance(op, A.Where):
            test = context.scope(rel).test(op.test)
            rel = rel.with_df(rel.df.filter(test | F.coalesce(F.col(FLUSH), F.lit(False)) if flush and not stateful else test))
        elif isinstance(op, A.Select):
            values = context.scope(rel).members(op.items)
            kept = [FLUSH] if flush and not stateful else []
            rel = Rel(rel.df.select(*[v.col.alias(k) for k, v in values.items()], *kept), list(values))
        elif stateful:
            raise CompileError("a live flow takes one operator with state: chain flows for more")
        else:
            kinds = {f.name: f.dataType for f in rel.df.schema.fields}
            at = _event_time(op, kinds) if isinstance(op, A.Summarize) else None
            rel = _native_windows(rel.df, rel.visible, op, at, watermark, context) if at else _with_state(rel.df, rel.visible, op, order, context)
            stateful = True
    if flush and not stateful:
        rel = rel.with_df(rel.df.filter(~F.coalesce(F.col(FLUSH), F.lit(False))))
    return rel, ()


def start(pipeline: str | A.Pipeline, df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, inserts: Callable[[str, DataFrame], None] | None = None,
          order_by: list[str] | None = None, watermark: str = "0 seconds", context: Context | None = None, **trigger: Any):
    """Starts a flow over the streaming frame ``df``; a StreamingQuery. ``sink`` gets each micro-batch of results,
    ``inserts`` the rows of each ``insert_into``. The checkpoint folder keeps offsets and state: a restart goes on."""
    pipeline = parse_pipeline(pipeline) if isinstance(pipeline, str) else pipeline
    context = context or Context()
    rel, rest = compile_stream(df, pipeline.ops, context, order_by, watermark)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            tee = lambda target, r: inserts and inserts(target, r.result())
            here = Context(context.lookups, context.functions, context.aggregates, context.js_concat, tee, True)
            out = compile_pipeline(Rel.of(rows), rest, here)
            if sink:
                sink(out.result(), number)
        finally:
            rows.unpersist()

    return rel.result().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def start_flow(engine: Any, name: str, df: DataFrame, checkpoint: str, landing: LandingFolder | None = None, **options: Any) -> Any:
    """Runs a registered flow of the engine over live rows. What it inserts goes to the target's subscribers and rows.
    Through ``landing``, the folder that ``df`` reads, a flow that ends is asked for what it holds."""
    flow = engine.flow(name)
    flow.landing = landing

    def inserts(target: str, rows: DataFrame) -> None:
        for r in rows.toLocalIterator():
            engine.insert(target, r.asDict(recursive=True))

    flow.running = start(flow.pipeline, df, checkpoint, inserts=inserts, context=engine.context(write=True), **options)
    return flow.running
