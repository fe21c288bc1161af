"""Row-by-row forms of the ordered operators, for live streams: state is a small Python object per key.

They follow the same rules as the plans for bounded data, which tests hold them against.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Mapping
from typing import Any

from ..errors import CompileError
from ..lang import ast as A
from ..operators.machine import Evaluator, ScanMachine, truth
from ..operators.sorter import ReorderBuffer
from ..operators.summarize import CLOCK_INTERVAL

AGGREGATES = ("count", "sum", "avg", "min", "max", "count_if", "sum_if", "avg_if", "count_distinct", "variance", "stddev", "median", "percentile")


def _number(x: Any) -> float | int | None:
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, str):
        try:
            x = float(x)
        except ValueError:
            return None
    return x if isinstance(x, (int, float)) and x == x else None


def _quantile(counts: Mapping[float, int] | None, share: float) -> float | None:
    """The value at ``share`` of the way through the sorted values, between neighbours by the straight line."""
    if not counts:
        return None
    at = share * (sum(counts.values()) - 1)
    low, high = math.floor(at), math.ceil(at)
    seen, first = 0, None
    for value in sorted(counts):
        seen += counts[value]
        if first is None and seen > low:
            first = value
        if seen > high:
            return float(first + (value - first) * (at - low))
    return None


class Accumulator:
    """The items of one group: aggregates fold, other fields keep their last value."""

    def __init__(self, items: tuple[A.Item, ...], ev: Evaluator):
        self.items, self.ev = items, ev
        self.state: dict[A.Expr, Any] = {}
        self.row: Mapping[str, Any] = {}
        # An aggregate that several items hold is folded once.
        self.aggregates = list(dict.fromkeys(e for it in items if isinstance(it, A.Prop) for e in self._find(it.value)))

    def push(self, row: Mapping[str, Any]) -> None:
        self.row = row
        for e in self.aggregates:
            self.state[e] = self._fold(e, self.state.get(e), row)

    def _is_aggregate(self, e: A.Expr) -> bool:
        return isinstance(e, A.Call) and e.name.lower() in AGGREGATES and (e.name.lower() not in ("min", "max") or len(e.args) == 1)

    def _find(self, e: A.Expr) -> Iterator[A.Call]:
        if self._is_aggregate(e):
            yield e
            return
        for v in e.__dict__.values():
            for x in v if isinstance(v, tuple) else (v,):
                if isinstance(x, A.Expr):
                    yield from self._find(x)
                elif isinstance(x, A.Prop):
                    yield from self._find(x.value)

    def _fold(self, e: A.Call, old: Any, row: Mapping[str, Any]) -> Any:
        name = e.name.lower()
        args = [self.ev.eval(a, row) for a in e.args]
        if name == "count":
            return (old or 0) + 1
        if name == "count_if":
            return (old or 0) + truth(args[0])
        if name in ("sum_if", "avg_if"):
            name, args = name[:3], args[:1] if truth(args[1]) else [None]
        if name == "sum":
            x = _number(args[0])
            return (old or 0) + (0 if x is None else x)
        if name == "avg":
            s, n = old or (0.0, 0)
            x = _number(args[0])
            return (s, n) if x is None else (s + x, n + 1)
        if name in ("variance", "stddev"):
            n, mean, squares = old or (0, 0.0, 0.0)
            x = _number(args[0])
            if x is None:
                return n, mean, squares
            step = x - mean
            mean += step / (n + 1)
            return n + 1, mean, squares + step * (x - mean)
        if name in ("median", "percentile"):
            # How often each value came: exact, and as large as there are different values.
            x = _number(args[0])
            if x is None:
                return old
            seen = {} if old is None else old
            seen[x] = seen.get(x, 0) + 1
            return seen
        if name == "count_distinct":
            return (old or set()) | ({args[0]} if args[0] is not None else set())
        if args[0] is None:
            return old
        return args[0] if old is None else (min if name == "min" else max)(old, args[0])

    def _value(self, e: A.Expr, extra: Mapping[str, Any]) -> Any:
        if self._is_aggregate(e):
            x = self.state.get(e)
            name = e.name.lower()
            if name in ("avg", "avg_if"):
                return x[0] / x[1] if x and x[1] else None
            if name == "count_distinct":
                return len(x or ())
            if name in ("variance", "stddev"):
                spread = x[2] / (x[0] - 1) if x and x[0] > 1 else None
                return spread if name == "variance" or spread is None else math.sqrt(spread)
            if name in ("median", "percentile"):
                share = 0.5 if name == "median" else self.ev.eval(e.args[1], self.row)
                return _quantile(x, share if share <= 1 else share / 100)
            return 0 if x is None and name.startswith(("count", "sum")) else x
        if isinstance(e, A.ObjectLit):
            return {p.key: self._value(p.value, extra) for p in e.items if isinstance(p, A.Prop)}
        if isinstance(e, (A.Lit, A.Name)):
            return self.ev.eval(e, {**self.row, **extra})
        parts = {k: tuple(A.Lit(self._value(x, extra)) if isinstance(x, A.Expr) else x for x in v) if isinstance(v, tuple) else A.Lit(self._value(v, extra)) if isinstance(v, A.Expr) else v for k, v in e.__dict__.items()}
        return self.ev.eval(type(e)(**parts), {**self.row, **extra})

    def result(self, window: str | None = None, fields: Mapping[str, Any] | None = None) -> dict[str, Any]:
        extra = {window: fields} if window else {}
        out = {it.key: self._value(it.value, extra) for it in self.items if isinstance(it, A.Prop)}
        for it in self.items:
            if isinstance(it, A.Spread):
                out |= self.ev.eval(it.value, {**self.row, **extra}) or {}
        for it in self.items:
            if isinstance(it, A.Exclude):
                out.pop(it.key, None)
        return out


def _key(ev: Evaluator, by: tuple[A.Expr, ...], row: Mapping[str, Any]) -> Any:
    return tuple(repr(ev.eval(e, row)) for e in by)


class EmitMachine:
    """Running results of all groups whenever the trigger fires; ``flush`` emits them once more and keeps them."""

    def __init__(self, op: A.Summarize, lookups: Mapping[str, Any] | None = None):
        self.op, self.ev = op, Evaluator(lookups)
        self.groups: dict[Any, Accumulator] = {}
        self.rows = 0
        self.last: Any = None
        self.started = False

    def _fires(self, row: Mapping[str, Any], now: float) -> bool:
        emit, first = self.op.emit, not self.started
        self.started = True
        if emit.kind == "update":
            return True
        if emit.kind == "when":
            return truth(self.ev.eval(emit.value, row))
        if emit.kind in ("change", "group_change"):
            value = self.ev.eval(emit.value, row) if emit.kind == "change" else _key(self.ev, self.op.by, row)
            changed, self.last = first or value != self.last, value
            return changed
        n = self.ev.eval(emit.interval, row)
        if emit.kind == "every_count":
            return self.rows % n == 0
        if emit.kind == "every" and emit.value is None and n < CLOCK_INTERVAL:
            return (self.rows - 1) % n == 0
        x = now * 1000 if emit.value is None else _number(self.ev.eval(emit.value, row))
        if x is None or self.last is not None and x - self.last < n:
            return False
        self.last = x
        return True

    def push(self, row: Mapping[str, Any], now: float | None = None) -> list[dict[str, Any]]:
        self.groups.setdefault(_key(self.ev, self.op.by, row), Accumulator(self.op.items, self.ev)).push(row)
        self.rows += 1
        return self.flush() if self._fires(row, time.time() if now is None else now) else []

    def flush(self) -> list[dict[str, Any]]:
        return [g.result() for g in self.groups.values()]


class WindowMachine:
    """Windows in order of arrival: one closes, and its groups are emitted, when a row comes that isn't in it."""

    def __init__(self, op: A.Summarize, lookups: Mapping[str, Any] | None = None):
        self.op, self.ev = op, Evaluator(lookups)
        self.open: dict[Any, tuple[dict[str, Any], dict[Any, Accumulator]]] = {}
        self.rows = 0
        self.session = (0, None, None)  # number, start, last value

    def _windows(self, row: Mapping[str, Any]) -> list[dict[str, Any]]:
        spec = self.op.window
        name, args = spec.function, [self.ev.eval(a, row) for a in spec.args]
        i, self.rows = self.rows, self.rows + 1
        base = name.split("_")[0]
        n_sizes = 2 if base == "hopping" else 1
        by_value = len(args) > n_sizes
        v = _number(args[-1]) if by_value else i
        size = args[0]
        if v is None:
            return []
        if base == "session":
            number, start, last = self.session
            if last is None or v - last > size:
                number, start = number + 1, v
            self.session = (number, start, v)
            return [{"_id": number, "windowId": number, "start": start, "end": v + size, "timeout": size, "type": "session", "mode": "value"}]
        mode = "value" if by_value else "count"
        if base in ("tumbling", "count"):
            k = math.floor(v / size)
            start = k * size
            extra = {"count": size} if base == "count" else {"size": size}
            return [{"_id": start if by_value else k, "windowId": start if by_value else k, "start": start, "end": start + size, **extra, "type": base, "mode": mode}]
        if base == "sliding":
            return [{"_id": v, "windowId": v, "start": v + 1 - size if by_value else max(0, v + 1 - size), "end": v + 1, "size": size, "type": base, "mode": mode}]
        if base != "hopping":
            raise CompileError(f"unknown window function {name!r}")
        hop = args[1]
        ks = range(math.floor((v - size) / hop) + 1, math.floor(v / hop) + 1)
        return [
            {"_id": k * hop if by_value else k, "windowId": k * hop if by_value else k, "start": k * hop, "end": k * hop + size, "size": size, "hop": hop, "type": base, "mode": mode}
            for k in ks if by_value or k >= 0
        ]

    def push(self, row: Mapping[str, Any], now: float | None = None) -> list[dict[str, Any]]:
        found = {w["_id"]: w for w in self._windows(row)}
        out = []
        for wid in [x for x in self.open if x not in found]:
            out += self._results(*self.open.pop(wid))
        for wid, w in found.items():
            _, groups = self.open.get(wid, (w, {}))
            self.open[wid] = (w, groups)  # a session's end moves on
            groups.setdefault(_key(self.ev, self.op.by, row), Accumulator(self.op.items, self.ev)).push(row)
        return out

    def _results(self, w: dict[str, Any], groups: dict[Any, Accumulator]) -> list[dict[str, Any]]:
        return [g.result(self.op.window.name, w) for g in groups.values()]

    def flush(self) -> list[dict[str, Any]]:
        return [r for w, groups in self.open.values() for r in self._results(w, groups)]


class GroupMachine:
    """Plain ``summarize``: results come with a flush only, and stay."""

    def __init__(self, op: A.Summarize, lookups: Mapping[str, Any] | None = None):
        self.op, self.ev = op, Evaluator(lookups)
        self.groups: dict[Any, Accumulator] = {}

    def push(self, row: Mapping[str, Any], now: float | None = None) -> list[dict[str, Any]]:
        self.groups.setdefault(_key(self.ev, self.op.by, row), Accumulator(self.op.items, self.ev)).push(row)
        return []

    def flush(self) -> list[dict[str, Any]]:
        return [g.result() for g in self.groups.values()]


class ScanStream(ScanMachine):
    def push(self, row: Mapping[str, Any], now: float | None = None) -> list[dict[str, Any]]:
        return super().push(row)

    def flush(self) -> list[dict[str, Any]]:
        return []


class SortStream:
    def __init__(self, key: A.Expr, max_size: int = 100, max_age: float = 5.0, lookups: Mapping[str, Any] | None = None):
        ev = Evaluator(lookups)
        self.key, self.buffer = key, ReorderBuffer(lambda r: ev.eval(key, r), max_size, max_age)

    def push(self, row: Mapping[str, Any], now: float | None = None) -> list[dict[str, Any]]:
        return self.buffer.push(dict(row), time.time() if now is None else now)

    def flush(self) -> list[dict[str, Any]]:
        return self.buffer.flush()


def machine(op: A.Op, lookups: Mapping[str, Any] | None = None):
    if isinstance(op, A.Scan):
        return ScanStream(op, lookups)
    if isinstance(op, A.Summarize):
        return (EmitMachine if op.emit else WindowMachine if op.window else GroupMachine)(op, lookups)
    raise CompileError(f"{type(op).__name__} keeps no state")
