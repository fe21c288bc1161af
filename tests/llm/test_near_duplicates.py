"""Near-duplicate classes against brute force, and components against union-find."""

import collections
import math
import random

import numpy as np
import pytest

from flowspark.llm import minhash
from flowspark.llm.graph import components


def classes(rows):
    texts = [t for _, t in rows]
    n = len(texts)
    bags = []
    for t in texts:
        w = [x for x in (t or "").encode().split()]
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {})
    df = collections.Counter(k for b in bags for k in b)
    weigh = [{k: c * (1 + math.log(n / df[k]) / math.log(n)) for k, c in b.items()} for b in bags]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            shared = sum(min(w, weigh[j][k]) for k, w in weigh[i].items() if k in weigh[j])
            total = sum(weigh[i].values()) + sum(weigh[j].values())
            if texts[i] == texts[j] or total and shared / (total - shared) >= 0.8 - 1e-12:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    return {frozenset(g) for g in groups.values()}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + ["", "", " \n", "one two", "one two", "three", None, None, "wide " * 3000, "wide " * 3001, texts[3] + " x" * 40]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_classes_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(minhash, "CHUNK", 4)
    rows = corpus()
    out = minhash.near_classes(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r.class_id].add(r.doc_id)
    assert {frozenset(g) for g in got.values()} == classes(rows)
    assert all(k == min(g) for k, g in got.items())
    assert all(r.class_size == len(got[r.class_id]) for r in out)


def test_one_of_each_class_stays(spark):
    rows = corpus(2) + [(0, corpus(2)[0][1]), (None, "lone row without a key"), (None, "lone row without a key"), (None, "one two")]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, lang string")
    kept = minhash.keep_one(df).collect()
    groups = classes(rows)
    nulls = sum(t is None for _, t in rows)
    assert len(kept) == len(groups)
    assert sum(r.text is None for r in kept) == nulls
    want = sorted(min((rows[i][0] for i in g if rows[i][0] is not None), default=-1) for g in groups)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == want
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang"}


def test_a_stay_moves_each_text_once(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows * 3], "doc_id long, text string, __md5 int, __n int, key int")
    out = minhash.keep_one(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    texts = [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(__md5" in line]
    assert out.columns == df.columns and len(texts) == 1
    assert out.count() == len(classes(rows)) + 2 * sum(t is None for _, t in rows)


def test_mixed_bucket_of_thousands(spark):
    """5,000 texts that share most of their words: every pair at or above 0.8 is in one class, however buckets mix."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(4))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(5000):
        t = list(base)
        if i % 2:  # a second family, at about 0.8 of the first
            t[20:28] = ["other", "words", "stand", "in", "this", "place", "of", "those"]
        for _ in range(rng.choice((0, 0, 1))):
            t[rng.randrange(120)] = word()
        texts.append(" ".join(t))
    out = minhash.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r.class_id].add(r.doc_id)
    by = np.zeros(5000, int)
    for k, g in got.items():
        by[list(g)] = k
    df = collections.Counter()
    bags = []
    for t in texts:
        w = t.split()
        bag = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        df.update(bag.keys())
        bags.append(bag)
    weigh = lambda k: 1 + math.log(5000 / df[k]) / math.log(5000)
    # Each text against the classes' members that it could link: distinct texts only, by shared weight.
    distinct = {}
    for i, t in enumerate(texts):
        distinct.setdefault(t, i)
    ids = list(distinct.values())
    total = np.array([sum(n * weigh(k) for k, n in bags[i].items()) for i in ids])
    postings = collections.defaultdict(list)
    for a, i in enumerate(ids):
        for k in bags[i]:
            postings[k].append(a)
    lost = links = 0
    for a, i in enumerate(ids):
        shared = np.zeros(len(ids))
        for k, n in bags[i].items():
            shared[postings[k]] += n * weigh(k)
        s = shared / (total[a] + total - shared)
        near = np.flatnonzero(s >= 0.8 + 1e-9)
        links += len(near)
        lost += (by[[ids[b] for b in near]] != by[i]).sum()
    assert links > 100_000 and lost == 0


@pytest.mark.parametrize("frequency, all_found", [(minhash.bounded_frequency, True), (minhash.smoothed_frequency, False)])
def test_recall_of_large_groups_by_frequency(spark, frequency, all_found):
    """Copies of one text that differ in a word each: all found with the bounded frequency, few with the smoothed."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(400):
        t = list(base)
        t[rng.randrange(100)] = word()
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = minhash.near_classes(df, frequency=frequency).groupBy("class_id").count().agg({"count": "max"}).first()[0]
    assert out == 400 if all_found else out < 40


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_classes(df).count() == 0 and minhash.keep_one(df).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 48, 3000, dtype=np.uint64)
    hits = expected = 0.0
    for _ in range(40):
        pick = rng.choice(3000, 300, replace=False)
        w1, w2 = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
        h = hashes[pick]
        both = minhash.signatures(np.concatenate([h, h]), np.concatenate([w1, w2]), np.array([0, 300]))
        hits += (both[0] == both[1]).mean()
        expected += np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs(hits - expected) / 40 < 0.02


def test_packing():
    for n in (0, 1, 1000):
        a = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n, dtype=np.uint64))
        assert (minhash.unpack(minhash.pack(a)) == a).all()


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(40)] + [("x", "x"), ("s1", "hub")]
    edges += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    assert got.keys() == parent.keys()
    for a in parent:
        for b in parent:
            assert (find(a) == find(b)) == (got[a] == got[b])
    assert components(spark.createDataFrame([("x", "x")], "a string, b string")).count() == 0


def test_thresholds_that_would_lose_links_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for t in (0.5, 0.79, float("nan")):
        with pytest.raises(ValueError, match="threshold"):
            minhash.near_classes(df, threshold=t)
