"""Near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

Shingles of five words are weighted by count and inverse document frequency over all documents. Signatures are cut
into bands; documents that share a band are candidates, and weighted Jaccard similarity of the full vectors decides.

How document frequencies reach the documents without a row per shingle: documents are dealt into blocks; each block
sends its distinct shingle hashes, packed by hash range, to the range's task, which returns the frequencies of all
documents, packed in the same order. A shared shingle, however common, is one entry per block.

A document can only be similar to another if ``THRESHOLD`` of its weight lies on shingles that occur in another
document too; the rest needs neither signature nor vector, and loses no link.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, table, text_bytes, written
from ._words import BASE, U64, Words, in_batches, mix
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Share of equal samples from which a pair's vectors are compared; five standard deviations below THRESHOLD.
LEAST_AGREEMENT = 0.55
#: Bytes of text in a block, and those whose shingles a range's task counts: there are as many ranges as keep it so.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 64 << 20
#: Members of a band's bucket that meet as many others in one group of rows, in expectation.
CHUNK = 256

HASH_BITS = 48


def _some_shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    cut = Words(texts)
    words, first = cut.hashes(), cut.first
    n = len(words)
    factors = [pow(BASE, 2 * i + 3, 1 << 64) for i in range(size)]
    rolled = np.zeros(max(0, n - size + 1), U64)
    for i, f in enumerate(factors):
        rolled += words[i : i + len(rolled)] * U64(f)
    rolled = mix(rolled) >> U64(64 - HASH_BITS)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(rolled[a : b - size + 1])
        elif b > a:  # a text of fewer words is one shingle
            whole = sum((int(w) * f for w, f in zip(words[a:b], factors, strict=False)), 0) & ((1 << 64) - 1)
            out.append(mix(np.array([whole], U64)) >> U64(64 - HASH_BITS))
        else:
            out.append(np.zeros(0, U64))
    return out


def shingles(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and how often each occurs."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in in_batches(texts):
        out += [np.unique(h, return_counts=True) for h in _some_shingles(batch, size)]
    return out


def pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, in the fewest bytes that hold the largest."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.view("<u8").ravel(), dtype=U64)


def _squeeze(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _distinct(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct shingles, the place among them of each document's, and the documents that have each."""
    joined = np.concatenate([h for h, _ in each]) if each else np.zeros(0, U64)
    values, places, counts = np.unique(joined, return_inverse=True, return_counts=True)
    return values, places, counts


def _bounds(values: np.ndarray, n_ranges: int) -> np.ndarray:
    edges = np.array([(i << HASH_BITS) // n_ranges for i in range(n_ranges + 1)], U64)
    return np.searchsorted(values, edges)


def _texts(t: pa.Table) -> list[str]:
    return t.column("text").to_pylist()


def _send_counts(n_ranges: int):
    def send(t: pa.Table) -> pa.Table:
        values, _, counts = _distinct(shingles(_texts(t)))
        at = _bounds(values, n_ranges)
        used = [i for i in range(n_ranges) if at[i] < at[i + 1]]
        return pa.table(
            {
                "range": pa.array(used, pa.int32()),
                "block": pa.array([t.column("block")[0].as_py()] * len(used), pa.int32()),
                "hashes": pa.array([pack(values[at[i] : at[i + 1]]) for i in used], pa.binary()),
                "counts": pa.array([_squeeze(counts[at[i] : at[i + 1]].astype(np.uint32)) for i in used], pa.binary()),
            }
        )

    return send


def _sum_counts(t: pa.Table) -> pa.Table:
    hashes = [unpack(x) for x in t.column("hashes").to_pylist()]
    counts = [_unsqueeze(x, np.uint32) for x in t.column("counts").to_pylist()]
    joined = np.concatenate(hashes)
    _, places = np.unique(joined, return_inverse=True)
    df = np.bincount(places, weights=np.concatenate(counts)).astype(np.uint32)[places]
    parts = np.split(df, np.cumsum([len(x) for x in hashes])[:-1])
    return pa.table({"block": t.column("block"), "range": t.column("range"), "df": pa.array([_squeeze(p) for p in parts], pa.binary())})


@cache
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the sampling's random numbers, Gamma(2, 1), log of Gamma(2, 1) and uniform; hashes index them."""
    rng = np.random.default_rng(20110)
    return rng.gamma(2, 1, 1 << 16), np.log(rng.gamma(2, 1, 1 << 16)), rng.random(1 << 16)


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, SAMPLES, dtype=U64) * U64(2) + U64(1)


def signatures(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (documents by SAMPLES) of the documents that begin at ``starts``, none empty."""
    gamma, log_c, beta = _variates()
    log_w = np.log(weights)
    sizes = np.diff(np.append(starts, len(hashes)))
    base = mix(hashes + U64(1))
    out = np.empty((len(starts), SAMPLES), U64)
    for k, m in enumerate(_multipliers()):
        x = mix(base * m)
        i, j, u = (x >> U64(48)).astype(np.intp), ((x >> U64(32)) & U64(0xFFFF)).astype(np.intp), ((x >> U64(16)) & U64(0xFFFF)).astype(np.intp)
        r, b = gamma[i], beta[u]
        t = np.floor(log_w / r + b)
        log_a = log_c[j] - r * (t - b) - r
        least = np.repeat(np.minimum.reduceat(log_a, starts), sizes)
        at = np.flatnonzero(log_a == least)
        at = at[np.searchsorted(at, starts)]
        out[:, k] = mix(hashes[at] ^ (t[at].astype(np.int64).view(U64) << U64(HASH_BITS)))
    return out


def bounded_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    """1 for a shingle that all documents have, 2 for one that a single document has, by the logarithm between."""
    return 1 + np.log(n_docs / np.minimum(df, n_docs)) / np.log(n_docs) if n_docs > 1 else np.ones(len(df))


def smoothed_frequency(df: np.ndarray, n_docs: int) -> np.ndarray:
    """The usual smoothed form, 1 + ln((1 + n) / (1 + df)). In a large group of copies it makes the few changed words
    weigh far more than the many common ones, so that copies which differ by single words fall below 0.8."""
    return 1 + np.log((1 + n_docs) / (1 + df.astype(np.float64)))


#: Inverse document frequencies from frequencies and the number of documents, at least 1 each.
Frequency = Callable[[np.ndarray, int], np.ndarray]


SKETCH = "node string, total double, hashes binary, weights binary, samples array<int>, bands array<long>"


def _sketch(n_docs: int, frequency: Frequency):
    def sketch(docs: pa.Table, counts: pa.Table) -> pa.Table:
        columns: dict[str, list] = {n: [] for n in ("node", "total", "hashes", "weights", "samples", "bands")}
        if docs.num_rows:
            each = shingles(_texts(docs))
            nodes = docs.column("node").to_pylist()
            _, places, _ = _distinct(each)
            parts = sorted(zip(counts.column("range").to_pylist(), counts.column("df").to_pylist(), strict=True))
            df = np.concatenate([_unsqueeze(x, np.uint32) for _, x in parts]) if parts else np.zeros(0, np.uint32)
            idf, at, done = frequency(df, n_docs), 0, set()
            chosen: list[tuple[np.ndarray, np.ndarray]] = []
            for node, (h, n) in zip(nodes, each, strict=True):
                mine = places[at : at + len(h)]
                at += len(h)
                if node in done or not len(h):
                    continue
                done.add(node)
                w = n * idf[mine]
                shared = df[mine] > 1
                total = float(w.sum())
                if w[shared].sum() < THRESHOLD * total * (1 - 1e-9):
                    continue
                columns["node"].append(node)
                columns["total"].append(total)
                columns["hashes"].append(pack(h[shared]))
                columns["weights"].append(_squeeze(w[shared]))
                chosen.append((h, w))
            if chosen:
                starts = np.cumsum([0, *(len(h) for h, _ in chosen)])[:-1]
                samples = signatures(np.concatenate([h for h, _ in chosen]), np.concatenate([w for _, w in chosen]), starts)
                columns["samples"] = list((samples & U64(0x7FFFFFFF)).astype(np.int32))
                banded = samples.reshape(len(samples), BANDS, ROWS)
                keys = np.zeros(banded.shape[:2], U64)
                for i in range(ROWS):
                    keys = mix(keys * U64(BASE) + banded[:, :, i])
                columns["bands"] = list(keys.view(np.int64))
        kinds = (pa.string(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table({n: pa.array(x, k) for (n, x), k in zip(columns.items(), kinds, strict=True)})

    return sketch


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", frequency: Frequency = bounded_frequency, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """A written row for each distinct text that may have a near-duplicate: its id ``node`` (MD5), vector and samples."""
    spark = docs.sparkSession
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(text_bytes(text)).alias("b")).first()
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_ranges = (max(n_tasks, -(-(size.b or 0) // x), 1) for x in (BLOCK_BYTES, RANGE_BYTES))
    # Copies of a text have keys of their own and lie in several blocks, so no group of copies makes a block large.
    block = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))), F.lit(n_blocks)).cast("int")
    blocks = docs.filter(F.col(text).isNotNull()).select(block.alias("block"), F.md5(text).alias("node"), F.col(text).alias("text"))
    sent = blocks.groupBy("block").applyInArrow(_send_counts(n_ranges), "range int, block int, hashes binary, counts binary")
    returned = sent.groupBy("range").applyInArrow(_sum_counts, "block int, range int, df binary")
    made = blocks.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(_sketch(size.n, frequency), SKETCH)
    return keep(made.dropDuplicates(["node"]))


def weighted_jaccard(h1, w1, total1: float, h2, w2, total2: float) -> float:
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    both = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    shared = float(np.minimum(w1[both], w2[at[both]]).sum())
    return shared / (total1 + total2 - shared)


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last = {"a": [], "b": [], "similarity": []}, (None, None)
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if last[0] != r["a"]:
                    last = (r["a"], (unpack(r["hashes_a"]), _unsqueeze(r["weights_a"], np.float64)))
                s = weighted_jaccard(*last[1], r["total_a"], unpack(r["hashes_b"]), _unsqueeze(r["weights_b"], np.float64), r["total_b"])
                if s >= threshold * (1 - 1e-9):
                    for n, v in (("a", r["a"]), ("b", r["b"]), ("similarity", s)):
                        rows[n].append(v)
            yield pa.RecordBatch.from_pydict({"a": pa.array(rows["a"], pa.string()), "b": pa.array(rows["b"], pa.string()), "similarity": pa.array(rows["similarity"], pa.float64())})

    return verify


def _links(pairs: DataFrame, sketched: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Written ``a, b, similarity`` of the candidate pairs that are similar. ``pairs`` is a written table."""
    end = lambda c, *names: sketched.select(F.col("node").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in names])
    agree = F.aggregate(F.zip_with("samples_a", "samples_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    likely = pairs.join(end("a", "samples"), "a").join(end("b", "samples"), "b").filter(agree >= LEAST_AGREEMENT * SAMPLES).select("a", "b")
    likely = keep(likely)
    vectors = ("hashes", "weights", "total")
    both = likely.join(end("b", *vectors), "b").join(end("a", *vectors), "a")
    return keep(both.mapInArrow(_verify(threshold), "a string, b string, similarity double"))


def _involved(t: pa.Table) -> pa.Table:
    """Members of a cell, few (``minor``) against some of all, that agree with one of another class. Samples alone
    decide; a pair is looked at where it first shares a band."""
    band = t.column("band")[0].as_py()
    _, classes = np.unique(np.asarray(t.column("label").to_pylist()), return_inverse=True)
    minor = np.asarray(t.column("minor"))
    samples, bands = np.stack(t.column("samples").to_numpy()), np.stack(t.column("bands").to_numpy())
    few, all_ = np.flatnonzero(minor), np.flatnonzero(~minor)
    met = np.zeros(len(minor), bool)
    for i in few:
        near = all_[classes[all_] != classes[i]]
        near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
        near = near[(samples[near] == samples[i]).sum(axis=1) >= LEAST_AGREEMENT * SAMPLES]
        met[near] = True
        met[i] = len(near) > 0
    return t.select(["band", "value", "node"]).filter(pa.array(met))


def _unlike_links(threshold: float):
    """Links between members of a cell that are in different classes, compared where they first share a band.

    Classes grow as links are found, and members of one class aren't compared any more: a link for each class that
    joins another is enough. Comparing one member with many adds up shared weight over the cell's own shingles.
    """

    def find(t: pa.Table) -> pa.Table:
        nodes = t.column("node").to_pylist()
        _, classes = np.unique(np.asarray(t.column("label").to_pylist()), return_inverse=True)
        minor, band = np.asarray(t.column("minor")), t.column("band")[0].as_py()
        samples, bands = np.stack(t.column("samples").to_numpy()), np.stack(t.column("bands").to_numpy())
        totals = np.asarray(t.column("total"))
        vectors = [unpack(x) for x in t.column("hashes").to_pylist()]
        limits = np.cumsum([0, *map(len, vectors)])
        shingle_count, places = np.unique(np.concatenate(vectors), return_inverse=True)
        weights = np.concatenate([_unsqueeze(x, np.float64) for x in t.column("weights").to_pylist()])
        dense = np.zeros(len(shingle_count))
        few, all_ = np.flatnonzero(minor), np.flatnonzero(~minor)
        found: dict[str, list] = {"a": [], "b": [], "similarity": []}
        for i in few:
            near = all_[classes[all_] != classes[i]]
            near = near[(bands[near] == bands[i]).argmax(axis=1) == band]
            near = near[(samples[near] == samples[i]).sum(axis=1) >= LEAST_AGREEMENT * SAMPLES]
            if not len(near):
                continue
            own = slice(limits[i], limits[i + 1])
            dense[places[own]] = weights[own]
            for j in near:
                if classes[j] == classes[i]:
                    continue
                theirs = slice(limits[j], limits[j + 1])
                shared = np.minimum(dense[places[theirs]], weights[theirs]).sum()
                s = shared / (totals[i] + totals[j] - shared)
                if s >= threshold * (1 - 1e-9):
                    for n, v in (("a", min(nodes[i], nodes[j])), ("b", max(nodes[i], nodes[j])), ("similarity", float(s))):
                        found[n].append(v)
                    classes[classes == classes[i]] = classes[j]
            dense[places[own]] = 0
        return pa.table({"a": pa.array(found["a"], pa.string()), "b": pa.array(found["b"], pa.string()), "similarity": pa.array(found["similarity"], pa.float64())})

    return find


def _mixed(members: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Buckets of ``members`` that hold several classes: the largest class ``top``, and the numbers ``n`` of members and
    ``m`` of those outside it."""
    sizes = members.groupBy("band", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("band", "value").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("classes"))
    return keep(buckets.filter("classes > 1 and n > 2").select("band", "value", F.col("top.label").alias("top"), "n", (F.col("n") - F.col("top.n")).alias("m")))


def _cells(members: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``members`` of buckets (``band, value, node, label``) dealt into cells: those outside their bucket's largest class
    (``minor``) in chunks against all members in chunks, CHUNK at most of either in expectation.

    Of a pair in different classes one end at least is outside the largest class, so each such pair meets in a cell. A
    member goes to as many cells as there are chunks of the others: in a bucket of n members, m of them minor, rows
    grow as n * m / CHUNK, which is the number of comparisons in units of CHUNK, and as n where m is small.
    """
    buckets = _mixed(members, keep)
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    placed = members.join(buckets, ["band", "value"])
    dealt = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), chunks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), chunks(c) - 1))
    all_ = placed.withColumn("right", dealt("n", 0)).withColumn("left", every("m")).withColumn("minor", F.lit(False))
    few = placed.filter("label <> top").withColumn("left", dealt("m", 1)).withColumn("right", every("n")).withColumn("minor", F.lit(True))
    return all_.unionByName(few).drop("top", "n", "m")


def _links_across(members: DataFrame, sketched: DataFrame, threshold: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between members of one bucket that are in different classes. First samples alone tell which members agree
    with one of another class; vectors are fetched for these only."""
    cell = ["band", "value", "left", "right"]
    narrow = _cells(members, keep).join(sketched.select("node", "samples", "bands"), "node")
    met = keep(narrow.groupBy(*cell).applyInArrow(_involved, "band int, value long, node string").distinct())
    involved = keep(members.join(met, ["band", "value", "node"], "left_semi"))
    wide = _cells(involved, keep).join(sketched.select("node", "total", "hashes", "weights", "samples", "bands"), "node")
    return keep(wide.groupBy(*cell).applyInArrow(_unlike_links(threshold), "a string, b string, similarity double"))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, frequency: Frequency = bounded_frequency) -> DataFrame:
    """Written ``key, node, class_id, class_size, stays`` for each row of ``docs``; ``class_id`` is its class's least key,
    and ``stays`` is true for the rows of that key with the text that stands for the class.

    Rows are in one class if their texts are equal or linked by a chain of texts whose weighted Jaccard similarity,
    over TF-IDF weighted five-word shingles, is ``threshold`` or more. First every member of a bucket is compared with
    the bucket's first member; then, in buckets that still hold several classes, all pairs in different classes are
    compared, in cells. So within buckets no link between classes is lost, and no group is expanded into its pairs.

    Equal texts are one class, empty ones too; a text without words is like no other. A null text is a class by
    itself, with a null ``node``. Rows with a null key take part; the class's id is the least key that isn't null, or
    null. Repeated rows are in one class. Only the two named columns are read. An empty table gives an empty result.

    The sketches, bands and least agreement are made for THRESHOLD and would lose links below it, so a lower
    ``threshold`` is refused. ``frequency`` weighs the shingles.
    """
    if not threshold >= THRESHOLD:
        raise ValueError(f"threshold must be {THRESHOLD} or more, not {threshold}")
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        out = _classes(docs, threshold, frequency, scratch.written)
        return written(out.withColumnRenamed("key", key))


def _classes(docs: DataFrame, threshold: float, frequency: Frequency, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    named = docs.select("key", F.md5("text").alias("node"))
    groups = keep(named.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    sketched = sketches(docs, "key", "text", frequency, keep)
    bands = keep(sketched.select("node", F.posexplode("bands").alias("band", "value")))
    buckets = bands.groupBy("band", "value").agg(F.min("node").alias("a"), F.max("node").alias("top"))
    leaders = keep(buckets.filter("a < top").drop("top"))
    pairs = keep(bands.join(leaders, ["band", "value"]).filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    links = _links(pairs, sketched, threshold, keep)
    bucketed = keep(bands.join(leaders, ["band", "value"], "left_semi"))
    labels = keep(components(links.select("a", "b"), keep))
    # Buckets that hold several classes; the members of one of two have been compared already.
    labelled = keep(bucketed.join(labels, "node", "left").select("band", "value", "node", F.coalesce("label", "node").alias("label")))
    mixed = labelled.groupBy("band", "value").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count(F.lit(1)).alias("size"))
    members = keep(labelled.join(mixed.filter("l1 < l2 and size > 2").select("band", "value"), ["band", "value"]))
    more = _links_across(members, sketched, threshold, keep)
    if not more.isEmpty():
        labels = keep(components(links.unionByName(more).select("a", "b"), keep))
    placed = keep(groups.join(labels, "node", "left").select("node", "first", "n", F.coalesce("label", "node").alias("label")))
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node"))
    classes = keep(placed.groupBy("label").agg(least.alias("w"), F.sum("n").alias("class_size")))
    by_node = keep(placed.join(classes, "label").select(F.col("node").alias("__node"), F.col("w.first").alias("class_id"), F.col("w.node").alias("winner"), "class_size"))
    out = named.join(by_node, F.col("node") == F.col("__node"), "left")
    alone = F.col("node").isNull()
    return out.select(
        "key",
        "node",
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | ((F.col("node") == F.col("winner")) & F.col("key").eqNullSafe(F.col("class_id")))).alias("stays"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class of ``near_classes`` keeps its member of least key, with all their
    columns; no column name is reserved.

    Of repeated rows, which share key and text, one stays, in no fixed way if their other columns differ. A row with a
    null text stays. An empty table gives an empty result.

    One plan at every size: each distinct text's row of least key, which no other row of that text can outlast, meets
    the verdicts in a join by text. Rows are reduced before they are shuffled, so copies reach a task as a row for each
    input task, and each distinct text moves once.
    """
    classes = near_classes(docs, key, text)
    kept = classes.filter("stays and node is not null").select(F.col("node").alias("__n")).distinct()
    # Columns of the caller are carried in a struct, so that none can clash.
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k")).alias("__order"), F.md5(F.col(text)).alias("__md5"))
    first = rows.filter(F.col("__md5").isNotNull()).groupBy("__md5").agg(F.min_by("__row", "__order").alias("__row"))
    stay = first.join(kept, F.col("__md5") == F.col("__n"), "left_semi")
    return stay.select("__row.*").unionByName(rows.filter(F.col("__md5").isNull()).select("__row.*"))


def op3_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
