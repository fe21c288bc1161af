"""Reordering by a key: a sort for bounded data, a bounded buffer for arriving rows."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame


def sorter(df: DataFrame, *keys: str | Column) -> DataFrame:
    """All rows in order of the keys: bounded data is never late."""
    return df.orderBy(*keys)


class ReorderBuffer:
    """Holds up to ``max_size`` rows for up to ``max_age`` and lets the oldest go in order of their keys.

    A row with a key below those let go is late and dropped. When the buffer is 80 % full, or the row that came first
    has waited half of ``max_age``, rows leave, those that came first before others, sorted among themselves.
    """

    def __init__(self, key: Callable[[Any], Any], max_size: int = 100, max_age: float = 5.0):
        self.key, self.max_size, self.max_age = key, max_size, max_age
        self.rows: list[tuple[Any, int, float, Any]] = []
        self.count = 0
        self.watermark: Any = None
        self.dropped = 0

    def push(self, row: Any, now: float) -> list[Any]:
        k = self.key(row)
        if self.watermark is not None and k < self.watermark:
            self.dropped += 1
            return []
        bisect.insort(self.rows, (k, self.count, now, row), key=lambda x: x[:2])
        self.count += 1
        full = len(self.rows) > 0.8 * self.max_size
        old = min((r[2] for r in self.rows), default=now) <= now - self.max_age / 2
        return self._leave(now) if full or old else []

    def _leave(self, now: float) -> list[Any]:
        by_age = sorted(self.rows, key=lambda r: r[1])
        n = max(len(by_age) - int(0.5 * self.max_size), sum(r[2] <= now - self.max_age / 2 for r in by_age), 1)
        gone = {r[1] for r in by_age[:n]}
        out = [r for r in self.rows if r[1] in gone]
        self.rows = [r for r in self.rows if r[1] not in gone]
        self.watermark = max([r[0] for r in out] + ([self.watermark] if self.watermark is not None else []))
        return [r[3] for r in out]

    def flush(self) -> list[Any]:
        out = [r[3] for r in self.rows]
        if self.rows:
            self.watermark = self.rows[-1][0]
        self.rows = []
        return out
