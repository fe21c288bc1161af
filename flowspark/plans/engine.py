"""The engine: statements, scripts, flows and their results."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError, FlowCycle, FlowError, FlowExists, FlowNotFound
from ..lang import ast as A
from ..lang.durations import parse_duration
from ..lang.parser import constant, parse_pipeline, parse_program
from ..operators.map import map_rows
from ..operators.rel import ORDER, Ordered, Rel
from . import compiler
from .catalog import LOG, Catalog, Flow

SEQ = "__seq"


@dataclass
class Result:
    success: bool
    type: str
    message: str = ""
    value: Any = None
    code: str | None = None

    def as_dict(self) -> dict[str, Any]:
        if self.success:
            return {"success": True, "type": self.type, "message": self.message} | ({"value": self.value} if self.value is not None else {})
        return {"success": False, "error": {"code": self.code, "message": self.message}}


class Engine:
    """Runs statements over named streams.

    A bounded stream is a data frame with a total order (``order_by``), or rows that were inserted, in order of
    insertion. A flow sees the rows inserted after it began, and all rows of a data frame. What flows insert into a
    stream is part of it, so flows over flows are plans over plans, and Spark optimises them as one.

    ``js_concat``: a missing value in a concatenation is the text "undefined", as in the language's goldens; else the
    result is null.
    """

    def __init__(self, spark: SparkSession, js_concat: bool = False):
        self.spark, self.js_concat = spark, js_concat
        self.catalog = Catalog()
        self.functions: dict[str, Callable[..., Column]] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self.started = time.time()

    # Registration

    def register_stream(self, name: str, df: DataFrame, order_by: list[str] | None = None) -> None:
        self.catalog.create_stream(name, "replace", df, order_by)

    def register_function(self, name: str, build: Callable[..., Column]) -> None:
        """``build`` makes a column from columns; it may be a Pandas UDF."""
        if name.lower() in self.functions:
            raise FlowError(f"the function {name!r} is registered")
        self.functions[name.lower()] = build

    def register_map(self, name: str, target: str, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str) -> None:
        """A stream ``target`` of what ``fn`` makes of each row of the stream ``name``."""
        rel = self.rel(name)
        made = map_rows(rel.df.select(*["`" + n + "`" for n in rel.visible], *rel.order), fn, schema, rel.order)
        self.catalog.create_stream(target, "replace", made, rel.order)

    def register_aggregate(self, name: str, build: Callable[..., Column]) -> None:
        if name.lower() in self.aggregates:
            raise FlowError(f"the aggregate {name!r} is registered")
        self.aggregates[name.lower()] = build

    def context(self, write: bool = False, tee: Callable[[str, Rel], None] | None = None) -> compiler.Context:
        return compiler.Context(self.catalog.lookups, self.functions, self.aggregates, self.js_concat, tee, write)

    # Rows of streams and flows

    def _inserted(self, name: str, since: int = 0) -> Rel | None:
        rows = self.catalog.stream(name).rows[since:]
        if not rows:
            return None
        lines = [json.dumps(r, default=str) for r in rows]
        text = self.spark.createDataFrame([(i + since, x) for i, x in enumerate(lines)], f"{SEQ} long, value string")
        kinds = infer_type(rows)
        names = _names_in_order(rows)
        df = text.select(F.from_json("value", kinds).alias("d"), F.col(SEQ).alias(f"{ORDER}_0"))
        return Rel(df.select(*[F.col("d").getField(n).alias(n) for n in names], f"{ORDER}_0"), names, [f"{ORDER}_0"])

    def rel(self, name: str, since: int = 0, path: tuple[str, ...] = ()) -> Rel:
        """All rows of a stream: its own and what flows insert."""
        if name in path:
            raise FlowCycle(" -> ".join((*path, name)))
        stream = self.catalog.stream(name)
        parts: list[Rel] = []
        if stream.df is not None:
            parts.append(Rel.of(stream.df, stream.order_by))
        if (own := self._inserted(name, since)) is not None:
            parts.append(own)
        for flow in self.catalog.sources_of(name):
            found: list[Rel] = []
            f = self.catalog.flows[flow]
            tee = lambda target, rel: found.append(rel) if target == name else None  # noqa: E731, B023
            compiler.compile_pipeline(self.rel(f.source, f.since, (*path, name)), f.pipeline.ops, self.context(tee=tee))
            parts += found
        if not parts:
            return Rel(self.spark.createDataFrame([], f"{ORDER}_0 long"), [], [f"{ORDER}_0"])
        return parts[0] if len(parts) == 1 else _merged(parts)

    def df(self, name: str) -> DataFrame:
        """A stream's rows."""
        return self.rel(name).result()

    def query(self, pipeline: str, sort: bool = False) -> DataFrame:
        """The result of a pipeline over what its source holds now."""
        p = parse_pipeline(pipeline)
        return compiler.compile_pipeline(self.rel(p.source), p.ops, self.context(write=True)).result(sort)

    def flow_rel(self, name: str, write: bool = False) -> Rel:
        f = self.flow(name)
        return compiler.compile_pipeline(self.rel(f.source, f.since), f.pipeline.ops, self.context(write))

    def results(self, flow: str, sort: bool = True) -> DataFrame:
        """What a flow has made of its rows, as after a flush."""
        return self.flow_rel(flow).result(sort)

    # Flows

    def flow(self, name: str) -> Flow:
        if name not in self.catalog.flows:
            raise FlowNotFound(f"there is no flow {name!r}")
        return self.catalog.flows[name]

    def create_flow(self, name: str, pipeline: A.Pipeline, mode: str = "", ttl: float | None = None, text: str = "") -> Flow:
        if name in self.catalog.flows:
            if mode == "if_not_exists":
                return self.catalog.flows[name]
            if mode != "replace":
                raise FlowExists(f"the flow {name!r} exists")
            self.stop_flow(name)
        source = self.catalog.stream(pipeline.source)
        flow = Flow(name, pipeline, text, ttl, len(source.rows))
        for target in flow.sinks:
            self.catalog.stream(target)
            if target == pipeline.source or target in self._upstream(pipeline.source):
                raise FlowCycle(f"{target!r} feeds itself through {name!r}")
        self.catalog.flows[name] = flow
        if ttl:
            flow.timer = threading.Timer(ttl, lambda: self.catalog.flows.get(name) is flow and self._expire_flow(name))
            flow.timer.daemon = True
            flow.timer.start()
        self.catalog.fire("flow_created", name=name, ttl=ttl)
        return flow

    def _upstream(self, stream: str) -> set[str]:
        out: set[str] = set()
        todo = [stream]
        while todo:
            for f in self.catalog.sources_of(todo.pop()):
                source = self.catalog.flows[f].source
                if source not in out:
                    out.add(source)
                    todo.append(source)
        return out

    def stop_flow(self, name: str) -> None:
        flow = self.flow(name)
        if flow.timer:
            flow.timer.cancel()
        if flow.running:
            flow.running.stop()
        del self.catalog.flows[name]
        self.catalog.fire("flow_stopped", name=name)

    def finish_flow(self, name: str) -> None:
        """Hands out what a flow still holds, as a flush does, and stops it."""
        flow = self.flow(name)
        if flow.landing and flow.running:
            flow.landing.flush()
        self._flush_flow(name)
        if self.catalog.flows.get(name) is flow:
            self.stop_flow(name)

    def _expire_flow(self, name: str) -> None:
        """As ``finish_flow``, but a flow goes even if its results fail; the fault is logged."""
        flow = self.flow(name)
        try:
            self.finish_flow(name)
        except Exception as e:  # noqa: BLE001  nobody waits for what a timer raises
            self.log("error", getattr(e, "code", "FLOW_FAILED"), str(e), flow.text)
            self.stop_flow(name)

    def stop_all_flows(self) -> None:
        for name in list(self.catalog.flows):
            self.stop_flow(name)

    def flow_info(self, name: str) -> dict[str, Any]:
        f = self.flow(name)
        running = f.running.lastProgress if f.running else None
        return {"name": name, "source": f.source, "sinks": f.sinks, "ttl": f.ttl, "created": f.created, "text": f.text, "progress": running}

    def list_flows(self) -> list[dict[str, Any]]:
        return [self.flow_info(n) for n in self.catalog.flows]

    # Inserting

    def insert(self, stream: str, data: Any) -> int:
        """One document, a list of them, or plain values, which become ``{"value": x}``."""
        s = self.catalog.stream(stream)
        docs = list(data) if isinstance(data, (list, tuple)) else [data]
        docs = [d if isinstance(d, dict) else {"value": d} for d in docs]
        s.rows += docs
        s.last_activity = time.time()
        for d in docs:
            for sub in list(self.catalog.subscriptions.values()):
                if sub.stream in (stream, None):
                    sub.callback(stream, d)
        return len(docs)

    def flush(self, stream: str) -> list[str]:
        """Runs the file sinks of the flows on the stream, and hands results to the subscribers of their targets."""
        self.catalog.stream(stream)
        return [name for name in self.catalog.readers_of(stream) if self._flush_flow(name)]

    def _flush_flow(self, name: str) -> bool:
        """Whether the flow's plan was run here; a live one only catches up."""
        flow = self.catalog.flows[name]
        if flow.running:
            if flow.running.isActive:
                flow.running.processAllAvailable()
            return False
        heard: list[tuple[str, Rel]] = []
        compiler.compile_pipeline(self.rel(flow.source, flow.since), flow.pipeline.ops, self.context(True, lambda target, rel: heard.append((target, rel))))
        for target, rel in heard:
            listening = [s for s in self.catalog.subscriptions.values() if s.stream in (target, None)]
            if listening:
                for row in rel.result(sort=True).toLocalIterator():
                    for s in listening:
                        s.callback(target, row.asDict(recursive=True))
        return True

    def log(self, level: str, code: str, message: str, query: str = "") -> None:
        rows = self.catalog.streams[LOG].rows
        rows.append({"_id": len(rows) + 1, "timestamp": time.time(), "level": level, "code": code, "message": message, "query": query})

    # Statements

    def execute(self, text: str) -> Result:
        """The last result of a script."""
        return (self.run_script(text) or [Result(True, "empty")])[-1]

    def run_script(self, text: str) -> list[Result]:
        """Each statement in turn; one that fails is logged, and the others run."""
        try:
            statements = parse_program(text)
        except FlowError as e:
            self.log("error", e.code, str(e), text)
            return [Result(False, "program", str(e), code=e.code)]
        out = []
        for s in statements:
            try:
                out.append(getattr(self, "_do_" + s.kind)(s))
            except FlowError as e:
                self.log("error", e.code, str(e), s.text)
                out.append(Result(False, s.kind, str(e), code=e.code))
        return out

    def _do_create_stream(self, s: A.Statement) -> Result:
        self.catalog.create_stream(s.name, s.mode)
        return Result(True, s.kind, f"stream {s.name}")

    def _do_create_flow(self, s: A.Statement) -> Result:
        ttl = None
        if s.ttl is not None:
            value = constant(s.ttl)
            try:
                ttl = float(value) if isinstance(value, (int, float)) else parse_duration(value)
            except (TypeError, ValueError) as e:
                raise CompileError(str(e)) from e
        self.create_flow(s.name, s.pipeline, s.mode, ttl, s.text)
        return Result(True, s.kind, f"flow {s.name}")

    def _do_create_lookup(self, s: A.Statement) -> Result:
        self.catalog.set_lookup(s.name, constant(s.value), s.mode)
        return Result(True, s.kind, f"lookup {s.name}")

    def _do_delete_stream(self, s: A.Statement) -> Result:
        self.catalog.stream(s.name)
        for f in self.catalog.readers_of(s.name):
            self._expire_flow(f)
        self.catalog.delete_stream(s.name)
        return Result(True, s.kind, f"stream {s.name}")

    def _do_delete_flow(self, s: A.Statement) -> Result:
        self.finish_flow(s.name)
        return Result(True, s.kind, f"flow {s.name}")

    def _do_delete_lookup(self, s: A.Statement) -> Result:
        self.catalog.delete_lookup(s.name)
        return Result(True, s.kind, f"lookup {s.name}")

    def _do_insert(self, s: A.Statement) -> Result:
        n = self.insert(s.name, constant(s.value))
        return Result(True, s.kind, f"{n} rows", n)

    def _do_flush(self, s: A.Statement) -> Result:
        return Result(True, s.kind, f"stream {s.name}", self.flush(s.name))

    def _do_list(self, s: A.Statement) -> Result:
        c = self.catalog
        found = {
            "streams": lambda: sorted(c.streams),
            "flows": self.list_flows,
            "lookups": lambda: dict(sorted(c.lookups.items())),
            "subscriptions": lambda: [{"id": x.id, "stream": x.stream} for x in c.subscriptions.values()],
        }[s.name]()
        return Result(True, s.kind, s.name, found)

    def _do_info(self, s: A.Statement) -> Result:
        names = [s.name] if s.name else sorted(self.catalog.streams)
        return Result(True, s.kind, s.name or "", [self.stream_info(n) for n in names])

    def stream_info(self, name: str) -> dict[str, Any]:
        x = self.catalog.stream(name)
        subs = [s.id for s in self.catalog.subscriptions.values() if s.stream == name]
        return {
            "name": name, "type": "table" if x.df is not None else "stream", "documentCount": len(x.rows), "createdAt": x.created, "lastActivity": x.last_activity,
            "subscribers": subs, "readers": self.catalog.readers_of(name), "writers": self.catalog.sources_of(name),
        }

    def _do_subscribe(self, s: A.Statement) -> Result:
        return Result(True, s.kind, s.name, self.catalog.subscribe(s.name, lambda stream, d: print(stream, json.dumps(d, default=str))))

    def _do_unsubscribe(self, s: A.Statement) -> Result:
        if not s.name.isdigit():
            raise CompileError("a subscription is named by its number")
        self.catalog.unsubscribe(int(s.name))
        return Result(True, s.kind, s.name)

    def _do_query(self, s: A.Statement) -> Result:
        rel = compiler.compile_pipeline(self.rel(s.pipeline.source), s.pipeline.ops, self.context(write=True))
        return Result(True, s.kind, s.pipeline.source, rel.result())


def infer_type(values: Iterable[Any]) -> T.DataType:
    """The narrowest type that holds all values; unlike kinds are text. Nulls alone are text, too."""
    found = [v for v in values if v is not None]
    if not found:
        return T.StringType()
    if all(isinstance(v, bool) for v in found):
        return T.BooleanType()
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in found):
        return T.LongType() if all(isinstance(v, int) for v in found) else T.DoubleType()
    if all(isinstance(v, dict) for v in found):
        return T.StructType([T.StructField(n, infer_type(v.get(n) for v in found)) for n in _names_in_order(found)])
    if all(isinstance(v, (list, tuple)) for v in found):
        return T.ArrayType(infer_type(x for v in found for x in v))
    return T.StringType()


def _names_in_order(rows: Iterable[dict[str, Any]]) -> list[str]:
    return list(dict.fromkeys(k for r in rows for k in r))


def _merged(parts: list[Rel]) -> Rel:
    """Rows of several origins, each in its order, one origin after another."""
    visible = list(dict.fromkeys(n for p in parts for n in p.visible))
    depth = max(len(p.order) for p in parts)
    frames = []
    for i, p in enumerate(parts):
        kinds = {f.name: f.dataType for f in p.df.schema.fields}
        # Orders of unlike types can't be compared, so others become places in their own origin.
        if all(isinstance(kinds[o], (T.LongType, T.IntegerType)) for o in p.order):
            df, keys = p.df, [F.col(o).cast("long") for o in p.order]
        else:
            df, keys = Ordered(p).index("__place").df, [F.col("__place")]
        keys += [F.lit(0).cast("long")] * (depth - len(keys))
        frames.append(df.select(*["`" + n + "`" for n in p.visible], F.lit(i).alias(f"{ORDER}_0"), *[k.alias(f"{ORDER}_{j + 1}") for j, k in enumerate(keys[:depth])]))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Rel(df.select(*["`" + n + "`" for n in visible], *[f"{ORDER}_{j}" for j in range(depth + 1)]), visible, [f"{ORDER}_{j}" for j in range(depth + 1)])
