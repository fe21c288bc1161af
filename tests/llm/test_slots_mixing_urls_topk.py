"""Sharding, mixing, URL filters and top-k against plain Python on small tables with odd rows."""

import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from flowspark.llm import mixing, slots, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, rate double"
ROWS = [
    (1, "abc", "en", "a", 3, 9, 1.0),
    (2, "", "en", "a", 0, 9, 1.0),
    (3, None, None, None, None, 9, 1.0),
    (None, "né", "fr", "b", 2, 9, 1.0),
    (None, "né", "fr", "b", 2, 9, 1.0),
    (4, "abc", "en", "a", 3, 9, 1.0),
    (4, "abc", "en", "a", 3, 9, 1.0),
    (5, "x" * 100_000, "en", "b", 100_000, 9, 1.0),
] + [(i, "word " * (i % 17), "en", "a", 0, 9, 1.0) for i in range(10, 400)]


def test_shards_are_near_equal_gapless_and_whole(spark):
    out = slots.assign_shards(spark.createDataFrame(ROWS, DOCS), 5, n_slots=512, carry=("text", "shard", "doc_id")).collect()
    assert len(out) == len(ROWS)
    places = {}
    for r in out:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    loads = [sum(r["size"] for r in out if r.shard == s) for s in range(5)]
    others = sorted(loads)[:-1]  # one text is larger than all others together
    assert max(others) - min(others) <= 16 + 85
    assert slots.assign_shards(spark.createDataFrame([], DOCS), 5).count() == 0


def plain_slots(rows, n_shards, n_slots):
    """Virtual slot, shard and place of each row: plain hashing, moves and swaps over all pairs of slots."""
    hashed = lambda v: xxhash.xxh64(struct.pack("<q", v), seed=42).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    made = []
    for key, text in rows:
        data = (text or "").encode()
        crc = zlib.crc32(data)
        made.append((signed(hashed(crc if key is None else key)) % n_slots, key, crc, len(data) + 16))
    sizes = {}
    for s, _, _, n in made:
        sizes[s] = sizes.get(s, 0) + n
    owner = [s % n_shards for s in range(n_slots)]
    load = lambda s: sum(n for slot, n in sizes.items() if owner[slot] == s)
    return made, sizes, owner, load


def test_assignment_like_a_plain_version(spark):
    """Hashes, sizes, loads and places are computed anew; no move or swap is left that would bring two shards closer."""
    rows = [(r[0], r[1]) for r in ROWS if r[0] != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = slots.assign_shards(df, 3, n_slots=64).collect()
    made, sizes, _, _ = plain_slots(rows, 3, 64)
    order = lambda x: (x[0], x[1] is not None, x[1] or 0, *x[2:])
    assert sorted(((r.virtual_slot, r.doc_id, r.text_crc32, r["size"]) for r in out), key=order) == sorted(made, key=order)
    owner = {r.virtual_slot: r.shard for r in out}
    assert all(owner[r.virtual_slot] == r.shard for r in out)
    for s in range(3):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [(r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in mine]
        assert keys == sorted(keys)
    loads = [sum(n for s, n in sizes.items() if owner[s] == k) for k in range(3)]
    slack = max(1, round(1e-4 * sum(loads) / 3))
    for a in range(3):
        for b in range(3):
            gap = loads[a] - loads[b]
            if gap <= slack:
                continue
            mine, theirs = ([n for s, n in sizes.items() if owner[s] == k] for k in (a, b))
            assert all(abs(gap - 2 * (x - y)) >= gap for x in mine for y in [0, *theirs] if x > y)


def test_rows_of_one_key_spread(spark):
    """A third of the rows under one key, and as many under none with one text, fill no single slot, and loads stay equal."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("some text").alias("text"))
    out = slots.assign_shards(rows, 8, n_slots=512)
    assert out.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 150
    loads = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(loads) - min(loads) <= 0.01 * sum(loads) / 8
    docs = rows.withColumn("lang", F.lit("en")).withColumn("source", F.lit("a"))
    mixed = mixing.replicate(docs, {"a": 1.0}, epochs=2.0)
    assert mixed.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0] < 0.5 * mixed.count()


def test_slot_map_versions_are_edits(spark, tmp_path):
    first = slots.SlotMap.initial(64, 4)
    sizes = {s: 10 + s % 7 for s in range(64)}
    second = first.rebalanced(sizes)
    grown = second.rebalanced(sizes, n_shards=5)
    assert (first.version, second.version, grown.version) == (1, 2, 3)
    assert max(grown.loads(sizes)) - min(grown.loads(sizes)) <= 10
    assert grown.moved <= 64 // 5 + 8  # little more than what the new shard takes
    store = slots.SlotMapStore(spark, str(tmp_path / "map"))
    for m in (first, second, grown):
        store.save(m)
    assert store.load(3).owners == grown.owners and store.load(1).owners == first.owners


def quantile(mean, u):
    n, p = 0, math.exp(-mean)
    c = p
    while c <= u and n < mixing.TABLE_TERMS + 1:
        n += 1
        p *= mean / n
        c += p
    return n


def test_copies_are_inverted_poisson(spark):
    import hashlib

    rows = [r for r in ROWS if r[0] is not None]
    weights = {"a": 30.0}
    out = mixing.replicate(spark.createDataFrame(rows, DOCS), weights).collect()
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").encode())
    w = {s: weights.get(s, 1.0) for s, b in size.items() if b}
    rate = {s: w[s] * (sum(size.values()) / sum(w.values())) / b if b else 1.0 for s, b in size.items()}
    assert max(rate.values()) > mixing.PART_MEAN  # the sum of several parts is tested, too
    want = []
    for r in rows:
        parts = max(1, math.ceil(rate[r[3]] / mixing.PART_MEAN))
        u = [int(hashlib.md5(f"{r[0]}:{mixing.SEED}:{j}".encode()).hexdigest()[:13], 16) / (1 << 52) for j in range(1, parts + 1)]
        n = sum(quantile(rate[r[3]] / parts, x) for x in u)
        want += [(r[0], k) for k in range(1, n + 1)]
    assert sorted((r.doc_id, r.copy_no) for r in out) == sorted(want)
    assert [c for c in out[0].asDict() if c in ("rate", "copies", "copy_no")] and mixing.replicate(spark.createDataFrame([], DOCS), {}).count() == 0


def test_salted_and_broadcast_mixing_agree(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, DOCS)
    key = lambda d: sorted((str(r.doc_id), r.text or "", r.copy_no) for r in d.collect())
    small = key(mixing.replicate(df, {"b": 3.0}))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert key(mixing.replicate(df, {"b": 3.0})) == small


URLS = [
    (1, "http://WWW.Example.com/en/705?x=/de/"), (2, "http://example.com/en/6#f"), (3, "https://a.b.net/de/8"), (4, "http://example.net/de/88"), (5, "http://x.org/es/"), (6, "http://x.org/es"),
    (7, None), (8, "no scheme/en/"), (9, "http://?q"), (10, "http://com/en/1"), (11, "http://notexample.net/de/8"), (12, "x://y://com/en/"), (1, "http://WWW.Example.com/en/705?x=/de/"),
    (13, ""), (14, "http://" + "a." * 500 + "com/en/" + "z" * 5000), (15, "http://xcom/en/7"), (16, "http://com.:80/en/7"),
]


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else default


@pytest.mark.parametrize("broadcast", [True, False])
def test_urls_like_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(*r, "mine") for r in URLS], "page_id long, url string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urls.filter_urls(df, urls.RULES).collect())
    want = sorted((i, h, p, n or "", v) for i, u in URLS for h, p, n, v in [judge(u, urls.RULES)])
    assert got == want
    assert urls.filter_urls(df.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("group_bytes", [1 << 25, 100])
def test_top_k_like_brute_force(spark, monkeypatch, group_bytes):
    """On one band and on many; repeated and odd rows; columns of the result's names."""
    import random

    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "GROUP_BYTES", group_bytes)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.0, 0.25, 2.0, 900.0]) for _ in range(6)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None]), (92, [float("nan")]), (93, [float("inf"), 1.0]), (None, [1.0]), (94, []), (95, [1.0, 2.0, 1e7])]
    rows += [(10, rows[10][1]), (11, rows[11][1]), (11, rows[11][1]), (20, [4.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, score int, rank int, query_id int, block int")
    got = sorted(tuple(r) for r in topk.exact_top_k(df.filter("vec_id % 10 = 0"), df, 7).select("query_id", "rank", "vec_id", "score").collect())
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 10 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:7]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want)
    assert topk.exact_top_k(df.limit(0), df, 3).count() == 0 and topk.exact_top_k(df, df.limit(0), 3).count() == 0
