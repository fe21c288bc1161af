"""Streams, flows, lookups, subscriptions and the log."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..errors import InvalidLookup, LookupExists, LookupNotFound, StreamExists, StreamNotFound, SubscriptionNotFound
from ..functions.aggregates import AGGREGATES
from ..functions.scalar import SCALARS
from ..lang import ast as A

LOG = "_log"


@dataclass
class Stream:
    """A named source: a data frame with an order, or rows inserted one by one."""

    name: str
    df: DataFrame | None = None
    order_by: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    created: float = field(default_factory=time.time)
    last_activity: float | None = None


@dataclass
class Flow:
    name: str
    pipeline: A.Pipeline
    text: str = ""
    ttl: float | None = None
    since: int = 0  # rows of the source inserted before the flow began
    created: float = field(default_factory=time.time)
    running: Any = None  # a StreamingQuery, for flows over live data
    landing: Any = None  # the folder that a live flow reads, if it is one of ours
    timer: Any = None

    @property
    def source(self) -> str:
        return self.pipeline.source

    @property
    def sinks(self) -> list[str]:
        return [op.target for op in self.pipeline.ops if isinstance(op, A.InsertInto)]


@dataclass
class Subscription:
    id: int
    stream: str | None  # None: all streams
    callback: Callable[[str, dict[str, Any]], None]


class Catalog:
    def __init__(self) -> None:
        self.streams: dict[str, Stream] = {LOG: Stream(LOG)}
        self.flows: dict[str, Flow] = {}
        self.lookups: dict[str, Any] = {}
        self.subscriptions: dict[int, Subscription] = {}
        self._ids = itertools.count(1)
        self.listeners: list[Callable[[str, dict[str, Any]], None]] = []

    def fire(self, event: str, **what: Any) -> None:
        for f in self.listeners:
            f(event, what)

    def stream(self, name: str) -> Stream:
        if name not in self.streams:
            raise StreamNotFound(f"there is no stream {name!r}")
        return self.streams[name]

    def create_stream(self, name: str, mode: str = "", df: DataFrame | None = None, order_by: list[str] | None = None) -> Stream:
        if name in self.streams:
            if mode == "if_not_exists":
                return self.streams[name]
            if mode != "replace":
                raise StreamExists(f"the stream {name!r} exists")
            self.delete_stream(name)
        self.streams[name] = Stream(name, df, order_by or [])
        self.fire("stream_created", name=name)
        return self.streams[name]

    def delete_stream(self, name: str) -> None:
        self.stream(name)
        del self.streams[name]
        self.subscriptions = {i: s for i, s in self.subscriptions.items() if s.stream != name}
        self.fire("stream_deleted", name=name)

    def delete_all_streams(self) -> None:
        for name in [n for n in self.streams if n != LOG]:
            self.delete_stream(name)

    def set_lookup(self, name: str, value: Any, mode: str = "") -> None:
        low = name.lower()
        if low in SCALARS or low in AGGREGATES:
            raise InvalidLookup(f"{name!r} is a function")
        if low in self.lookups and mode != "replace":
            raise LookupExists(f"the lookup {name!r} exists")
        check_lookup(value)
        self.lookups[low] = value

    def get_lookup(self, name: str) -> Any:
        if name.lower() not in self.lookups:
            raise LookupNotFound(f"there is no lookup {name!r}")
        return self.lookups[name.lower()]

    def delete_lookup(self, name: str) -> None:
        self.get_lookup(name)
        del self.lookups[name.lower()]

    def subscribe(self, stream: str | None, callback: Callable[[str, dict[str, Any]], None]) -> int:
        if stream is not None:
            self.stream(stream)
        i = next(self._ids)
        self.subscriptions[i] = Subscription(i, stream, callback)
        return i

    def unsubscribe(self, sid: int) -> None:
        if sid not in self.subscriptions:
            raise SubscriptionNotFound(f"there is no subscription {sid}")
        del self.subscriptions[sid]

    def sources_of(self, stream: str) -> list[str]:
        """Flows that insert into the stream."""
        return [f.name for f in self.flows.values() if stream in f.sinks]

    def readers_of(self, stream: str) -> list[str]:
        return [f.name for f in self.flows.values() if f.source == stream]


def check_lookup(value: Any) -> None:
    if value is None or isinstance(value, (bool, int, float, str)):
        return
    if isinstance(value, (list, tuple)):
        for v in value:
            check_lookup(v)
    elif isinstance(value, dict):
        for k, v in value.items():
            if not isinstance(k, str):
                raise InvalidLookup("keys of a lookup are texts")
            check_lookup(v)
    else:
        raise InvalidLookup(f"a lookup can't hold {type(value).__name__}")
