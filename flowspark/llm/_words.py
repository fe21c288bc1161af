"""Words of many texts at once, as arrays: places, lengths and polynomial hashes over the texts' UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from ._shared import ASCII_SPACE

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that are looked at together.
BATCH_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[list(ASCII_SPACE.encode())] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, x, U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """``starts`` and ``ends`` of all words in ``data``; text i has the words from ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[self.data]
        self.inner = ~space
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.starts = np.flatnonzero(self.inner & before)
        self.ends = np.flatnonzero(space & ~before)
        self.limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.limits)

    def hashes(self, data: np.ndarray | None = None, keep: np.ndarray | None = None) -> np.ndarray:
        """A hash of each word's bytes, of ``data`` in place of the texts' and of the kept ones only."""
        data = self.data if data is None else data
        if keep is None:
            starts, ends = self.starts, self.ends
        else:
            n = np.zeros(len(keep) + 1, np.int64)
            np.cumsum(keep, out=n[1:])
            data, starts, ends = data[keep], n[self.starts], n[self.ends]
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        total = np.zeros(len(per_word) + 1, np.float64)
        np.cumsum(per_word, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def byte_sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return total[self.limits[1:]] - total[self.limits[:-1]]


def in_batches(texts: Iterable[str]) -> Iterator[list[bytes]]:
    batch: list[bytes] = []
    held = 0
    for t in texts:
        batch.append(t.encode())
        held += len(batch[-1]) + 1
        if held >= BATCH_BYTES:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch
