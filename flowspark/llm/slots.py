"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots, bytes are summed per slot, and a versioned map says which shard owns each
slot. Rebalancing edits that map: slots move or swap owners until the shards' bytes are near equal, and every edit is
a new version. Only per-slot totals reach the driver; their number is the parameter ``n_slots``.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, table, text_bytes, with_heavy, written

N_SLOTS = 16_384
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Owner of each slot; ``version`` counts the edits and ``moved`` the slots whose owner the last edit changed."""

    owners: tuple[int, ...]
    n_shards: int
    version: int = 1
    moved: int = 0

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        return cls(tuple(s % n_shards for s in range(n_slots)), n_shards)

    def loads(self, slot_bytes: Mapping[int, int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, size in slot_bytes.items():
            out[self.owners[slot]] += size
        return out

    def rebalanced(self, slot_bytes: Mapping[int, int], n_shards: int | None = None, tolerance: float = 1e-4) -> SlotMap:
        """The next version. Slots of the fullest shard move to the emptiest, or swap with one of its slots, while that
        narrows the gap between the two; it ends within ``tolerance`` of the mean or when nothing narrows it further."""
        n_shards = n_shards or self.n_shards
        owners = [o if o < n_shards else i % n_shards for i, o in enumerate(self.owners)]
        held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
        loads = [0] * n_shards
        for slot, size in slot_bytes.items():
            if size:
                held[owners[slot]].append((size, slot))
                loads[owners[slot]] += size
        for h in held:
            h.sort()
        slack = max(1, round(tolerance * sum(loads) / n_shards))
        stuck: set[int] = set()
        while True:
            order = sorted((s for s in range(n_shards) if s not in stuck), key=lambda s: (loads[s], s))
            if len(order) < 2 or loads[order[-1]] - loads[order[0]] <= slack:
                break
            full = order[-1]
            # A few of its slots are tried first, and all of them before it is left alone.
            tried = ((s, e) for s in sorted({max(1, len(held[full]) // 64), 1}, reverse=True) for e in order[:-1])
            found = ((e, _best_step(held[full], held[e], loads[full] - loads[e], s)) for s, e in tried)
            empty, step = next(((e, step) for e, step in found if step), (full, None))
            if not step:
                stuck.add(full)  # nothing on it can narrow any gap while the others stay
                continue
            stuck.clear()
            give, take = step
            for item, a, b in ((give, full, empty), (take, empty, full)):
                if item:
                    held[a].pop(bisect.bisect_left(held[a], item))
                    bisect.insort(held[b], item)
                    loads[a] -= item[0]
                    loads[b] += item[0]
                    owners[item[1]] = b
        moved = sum(a != b for a, b in zip(self.owners, owners, strict=True))
        return SlotMap(tuple(owners), n_shards, self.version + 1, moved)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, owner, self.n_shards) for slot, owner in enumerate(self.owners)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, n_shards int")


def _best_step(full: list[tuple[int, int]], empty: list[tuple[int, int]], gap: int, stride: int = 1):
    """The move, or the swap of every ``stride``-th slot, that leaves the two shards closest to each other, or None if
    none narrows the gap."""
    best, best_left = None, gap
    i = bisect.bisect_left(full, (gap // 2, -1))
    for item in full[max(0, i - 1) : i + 1]:
        if abs(gap - 2 * item[0]) < best_left:
            best, best_left = (item, None), abs(gap - 2 * item[0])
    for item in full[::stride]:
        j = bisect.bisect_left(empty, (item[0] - gap // 2, -1))
        for other in empty[max(0, j - 1) : j + 1]:
            left = abs(gap - 2 * (item[0] - other[0]))
            if item[0] > other[0] and left < best_left:
                best, best_left = (item, other), left
    return best


@dataclass
class SlotMapStore:
    """Versions of a slot map as Parquet folders ``version=N``; a version is written once and never changed."""

    spark: SparkSession
    folder: str
    written: list[int] = field(default_factory=list)

    def save(self, slot_map: SlotMap) -> SlotMap:
        slot_map.frame(self.spark).drop("version").coalesce(1).write.parquet(f"{self.folder}/version={slot_map.version}")
        self.written.append(slot_map.version)
        return slot_map

    def frame(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, n_shards int").parquet(f"{self.folder}/version={version}")

    def load(self, version: int) -> SlotMap:
        rows = self.frame(version).orderBy("virtual_slot").collect()  # one row per slot
        return SlotMap(tuple(r.shard for r in rows), rows[0].n_shards, version)


NEW = ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version")


def sized_records(docs: DataFrame, n_slots: int, key: str, text: str, carry: Sequence[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Written key, ``carry``, ``size``, ``text_crc32`` and ``virtual_slot`` of each row.

    A record's slot is a hash of its key, or of its checksum where the key is null. Rows of a key or checksum that is
    heavy are told apart by their place as well and so spread over all slots: one slot can't be split.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    carried = [c for c in carry if c != key and c not in NEW]
    rows = docs.select(F.col(key), *carried, (text_bytes(text) + ROW_OVERHEAD).alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("__place"))
    rows = keep(rows.withColumn("__h", F.when(F.col(key).isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64(key))))
    marked = with_heavy(rows, "__h", "__heavy", keep)
    h = F.when(F.col("__heavy"), F.xxhash64("__h", "__place")).otherwise(F.col("__h"))
    return keep(marked.select(key, *carried, "size", "text_crc32", F.pmod(h, F.lit(n_slots)).cast("int").alias("virtual_slot")))


def assign_shards(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, key: str = "doc_id", text: str = "text", folder: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Key, the columns ``carry``, ``size``, ``text_crc32``, ``virtual_slot``, ``shard``, ``slot`` (place in the shard,
    gapless from 0) and ``map_version`` of each row.

    Sizes are taken once and summed per slot (at most ``n_slots`` rows leave the executors), the map is rebalanced on
    them and stored, and each record's slot is looked up in it. Places come from the slots' row counts and the order
    (key, crc32, size) inside a slot, so no task sees a whole shard; only the key and two numbers are sorted.

    Nulls: a null text counts as empty (16 bytes, crc 0); null keys hash with the text's checksum, so that they spread.
    Repeated rows are rows of their own, and very many of one key are dealt over all slots. Columns of ``docs`` that
    aren't named aren't read, and carried ones with the names above are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sized = sized_records(docs, n_slots, key, text, carry, scratch.written)
        totals = sized.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # n_slots rows at most
        store = SlotMapStore(spark, folder or scratch.folder())
        first = store.save(SlotMap.initial(n_slots, n_shards))
        current = store.save(first.rebalanced({r.virtual_slot: r["size"] for r in totals}))
        counts = {r.virtual_slot: r.n for r in totals}
        filled, rows = [0] * n_shards, []
        for slot, owner in enumerate(store.load(current.version).owners):
            rows.append((slot, owner, filled[owner], current.version))
            filled[owner] += counts.get(slot, 0)
        owners = spark.createDataFrame(rows, "virtual_slot int, shard int, __offset long, map_version int")
        inside = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")
        placed = sized.withColumn("__rank", F.row_number().over(inside) - 1)
        joined = placed.join(F.broadcast(owners), "virtual_slot")  # n_slots rows
        return written(joined.select(*sized.columns, "shard", (F.col("__offset") + F.col("__rank")).cast("long").alias("slot"), "map_version"))


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = assign_shards(docs, 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )
