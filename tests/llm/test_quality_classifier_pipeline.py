"""Quality rules, the weak-label classifier and the pipeline on small tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowspark.llm import quality, weak_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, d2 double"


def prose(rng, n, lang="en"):
    words = {"en": "the of and to in is that it".split(), "de": "der die und das von zu mit nicht".split()}[lang]
    made = lambda: "".join(rng.choice(["an", "er", "tion", "st", "ing", "ou", "th"]) for _ in range(rng.randint(1, 4)))
    out, line = [], 0
    for i in range(n):
        w = rng.choice(words) if rng.random() < 0.3 else made()
        w = w.capitalize() if line == 0 else w
        line += 1
        if line > 6 and rng.random() < 0.2:
            w, line = w + rng.choice([".", ".\n"]), 0
        out.append(w)
    return " ".join(out)


def table(n=600, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(60, 400), lang := rng.choice(["en", "de"]))
        kind = "good"
        if i % 10 == 0:
            kind = ("shout", "symbols", "repeat", "pipes")[i // 10 % 4]
            if kind == "shout":
                text = " ".join(w.upper() + "!!" for w in text.split())
            elif kind == "symbols":
                text = " ".join(w + rng.choice("#*$%&") * 3 for w in text.split())
            elif kind == "pipes":
                text = " | ".join(w for w in text.split() if len(w) > 4)
            else:
                text = " ".join(w for w in text.split()[:20] for _ in range(15))
        rows.append((i, text, lang, rng.choice(["a", "a", "b"]), len(text), kind))
    return rows


def statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_statistics_like_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "one", "a b c", "a b c a b c", "a a a a", "x y\nx y\n\n \nx y \nx y", "né é | <b>\x0b\x0c\r*", "w " * 5000, "😂 " * 60]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["a b", "c", " ", "", "a b "]) for _ in range(20)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in quality.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == statistics(t), t


FLOOR = np.array(list(quality.FLOORS.values()))


def vector(r):
    share = lambda a, b: np.sqrt(a / max(b, 1))
    return [np.log(max(r.word_chars, 1) / max(r.n_words, 1)), share(r.n_symbols, r.word_chars), share(r.n_dup_lines, r.n_lines), share(r.n_repeat_words, r.n_words), share(r.n_capitals, r.word_chars)]


def bins(d):
    return np.floor(np.log2(np.maximum(d, 1e-9)) * quality.OCTAVE)


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def plain_starts(x):
    """Location and scatter: medians with quartile ranges, all rows, spatial signs."""
    q = lambda p: np.array([(np.sort(np.floor(c * quality.UNIT))[max(int(np.ceil(p * len(c))) - 1, 0)] + 0.5) / quality.UNIT for c in x.T])
    mid, spread = q(0.5), (q(0.75) - q(0.25)) / 1.349
    yield mid, np.diag(spread**2 + FLOOR**2)
    yield x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(FLOOR**2)
    scale = np.maximum(spread, FLOOR)
    u = (x - mid) / scale
    signs = u / np.sqrt(1e-9 + (u**2).sum(axis=1))[:, None]
    yield mid, 5 * (signs.T @ signs) / len(x) * np.outer(scale, scale) + np.diag(FLOOR**2)


def plain_mcd(x):
    """The estimate of least determinant over the starts, each followed until it stays, and scaled by the median."""
    ends = []
    for mean, cov in plain_starts(x):
        for _ in range(quality.STEPS):
            b, most = bins(distances(x, mean, cov)), quality.SUPPORT * len(x)
            cut = np.sort(b)[int(np.ceil(most)) - 1]
            w = np.where(b < cut, 1.0, np.where(b == cut, (most - (b < cut).sum()) / (b == cut).sum(), 0.0))
            mean, was = w @ x / w.sum(), cov
            cov = (x - mean).T @ ((x - mean) * w[:, None]) / w.sum() + np.diag(FLOOR**2)
            if abs(np.linalg.slogdet(cov)[1] - np.linalg.slogdet(was)[1]) <= quality.TOLERANCE:
                break
        ends.append((np.linalg.slogdet(cov)[1], mean, cov))
    _, mean, cov = min(ends, key=lambda e: round(e[0], 9))
    middle = 2 ** ((np.sort(bins(distances(x, mean, cov)))[(len(x) + 1) // 2 - 1] + 0.5) / quality.OCTAVE)
    return mean, cov * max(1.0, middle / quality.MEDIAN_D2)


def lean(n, own, onto):
    return tuple(n / (n + quality.PRIOR) * a + quality.PRIOR / (n + quality.PRIOR) * b for a, b in zip(own, onto))


def pooled(parts):
    return sum(n for n, _ in parts), tuple(sum(n * e[i] for n, e in parts) / sum(n for n, _ in parts) for i in (0, 1))


def plain_judge(rows):
    """``d2`` of each row that passed the base rules, by groups that lean on their language and that on all."""
    groups = {}
    for i, r in enumerate(rows):
        if not r.base_failed:
            groups.setdefault((r.lang, r.source), []).append(i)
    x = {g: np.array([vector(rows[i]) for i in at]) for g, at in groups.items()}
    est = {g: (len(v), plain_mcd(v)) for g, v in x.items()}
    _, overall = pooled(list(est.values()))
    language = {}
    for lang in {g[0] for g in groups}:
        n, e = pooled([v for g, v in est.items() if g[0] == lang])
        language[lang] = lean(n, e, overall)
    return {i: d for g, at in groups.items() for i, d in zip(at, distances(x[g], *lean(est[g][0], est[g][1], language[g[0]])))}


EXTRA = [
    (None, None, None, None, None), (700, "", "en", "a", 0), (701, prose(random.Random(9), 80), None, None, 5), (701, prose(random.Random(9), 80), None, None, 5),
    (702, "z " * 20_000, "en", "a", 1), (703, prose(random.Random(8), 90), "a", None, 5), (704, prose(random.Random(7), 90), None, "a", 5),
]


def test_outliers_like_plain_mcd(spark):
    rows = table()
    df = spark.createDataFrame([(*r[:5], True, 1.0) for r in rows] + [(*r, True, 1.0) for r in EXTRA], DOCS)
    got = quality.quality_rules(df).collect()
    assert len(got) == len(rows) + len(EXTRA)
    kept = {r.doc_id: r.kept for r in got}
    kinds = {r[0]: r[5] for r in rows}
    assert all(kept[i] for i, k in kinds.items() if k == "good")
    assert not any(kept[i] for i, k in kinds.items() if k in ("shout", "repeat", "symbols", "pipes"))
    assert not kept[700] and not kept[None] and not kept[702] and kept[701] and kept[703] and kept[704]
    want = plain_judge(got)
    assert all((r.d2 is None) == r.base_failed for r in got)
    assert np.allclose([want[i] for i in sorted(want)], [got[i].d2 for i in sorted(want)], rtol=1e-6)
    assert all(got[i].kept == (d <= quality.CUTOFF) for i, d in want.items())
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_least_determinant_of_the_starts():
    """One in five rows is far off on one side: the classical start alone ends no lower than the best of all."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.3, (400, 5)), rng.normal(2.0, 0.05, (100, 5))])
    mean, _ = plain_mcd(x)
    assert np.abs(mean).max() < 0.1


@pytest.mark.parametrize("n", [199, 200])
def test_small_groups_lean_by_degrees(spark, n):
    """A source of 199 documents is judged like one of 200, and a small one of junk alone doesn't judge itself."""
    rows = [r for r in table(900, 6) if r[5] == "good"]
    some = [(10_000 + i, prose(random.Random(i), 120, "en"), "en", "small", 0) for i in range(n)]
    junk = [(20_000 + i, " | ".join(prose(random.Random(i), 150, "en").split()), "en", "junk", 0) for i in range(10)]
    df = spark.createDataFrame([(*r[:5], True, 1.0) for r in rows] + [(*r, True, 1.0) for r in some + junk], DOCS)
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert all(got[r[0]].kept for r in some) and not any(got[r[0]].kept for r in junk)


def test_kept_rows_where_they_are(spark):
    """The stage's rows are those that the operator keeps, with columns of any name, and texts aren't shuffled."""
    rows = table(300, 4)
    names = "__md5", "__n", "d2", "kept", "__row", "n_words"
    data = [(*r[:4], *range(len(names))) for r in rows] + [(*r[:4], *range(len(names))) for r in EXTRA + EXTRA]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    out = quality.keep_by_rules(df)
    assert out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange RoundRobin" not in plan
    want = [r.doc_id for r in quality.quality_rules(df).collect() if r.kept]
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and all(r.__getitem__("n_words") == 5 for r in got)
    assert quality.keep_by_rules(df.limit(0)).count() == 0


def test_salted_groups_agree(spark, monkeypatch):
    from flowspark.llm import _shared

    df = spark.createDataFrame([(*r[:5], True, 1.0) for r in table(200)], DOCS)
    key = lambda: sorted((r.doc_id, r.kept, round(r.d2 or -1, 6)) for r in quality.quality_rules(df).collect())
    one = key()
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 0)
    assert key() == one


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    k = len(weak_labels.LABELLERS)
    good = rng.random(20_000) < 0.85
    hit = rng.uniform(0.4, 0.8, k)
    patterns, truth = {}, {}
    for g in good:
        p = "".join(str(weak_labels.GOOD) if g or rng.random() > h else str(weak_labels.BAD) for h in hit)
        patterns[p] = patterns.get(p, 0) + 1
        truth.setdefault(p, []).append(g)
    model = weak_labels.fit_label_model(patterns)
    assert abs(model.prior - 0.85) < 0.03
    assert np.abs(model.rates[:, weak_labels.BAD, weak_labels.BAD] - hit).max() < 0.08
    wrong = sum(abs((model.posterior(p) > 0.5) - np.mean(t)) * len(t) for p, t in truth.items())
    assert wrong / len(good) < 0.03
    assert weak_labels.fit_label_model({}).prior == 0.8


def plain_statistics(text):
    """The labellers' statistics of one text, word by word."""
    w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode()) if x]
    n, all_ = len(w), b"".join(w)
    low = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
    function = {x.encode() for x in weak_labels.FUNCTION_WORDS}
    windows = list(zip(w, w[1:], w[2:]))
    lean = n + weak_labels.USUAL_WORDS
    count = lambda test: sum(map(test, w))
    return [
        sum(c in b"#*$%&|<>" for c in all_) / max(1, len(all_)), sum(65 <= c <= 90 for c in all_) / max(1, len(all_)), sum(a == b for a, b in zip(w, w[1:])) / lean,
        1 - len(set(windows)) / len(windows) if windows else 0.0, count(lambda x: len(x) > 1 and x[-1] in b"!?" and x[-2] in b"!?") / lean,
        1 - (count(lambda x: low(x) in function) + weak_labels.USUAL_FUNCTION * weak_labels.USUAL_WORDS) / lean,
        1 - (count(lambda x: x[-1] in b".!?") + weak_labels.USUAL_ENDS * weak_labels.USUAL_WORDS) / lean, count(lambda x: any(c in b"#*$%&|<>" for c in x)) / lean,
    ]


def plain_votes(text):
    if not (text or "").strip(" \t\n\x0b\x0c\r"):
        return "2" * len(weak_labels.LABELLERS)
    return "".join("0" if s > bad else "1" if s <= good else "2" for s, (bad, good) in zip(plain_statistics(text), weak_labels.LABELLERS.values()))


def plain_em(votes):
    """Expectation-maximisation row by row, with the module's start and pseudo-counts; posteriors per row."""
    k = len(weak_labels.LABELLERS)
    start = {1: (0.01, 0.84, 0.15), 0: (0.40, 0.35, 0.25)}
    rate = {(i, c, v): start[c][v] for i in range(k) for c in (0, 1) for v in (0, 1, 2)}
    prior, pseudo = 0.8, max(1.0, 0.01 * len(votes))

    def posterior(vote):
        like = [1 - prior, prior]
        for i, v in enumerate(map(int, vote)):
            for c in (0, 1):
                like[c] *= rate[i, c, v] if v != 2 else 1
        return like[1] / sum(like)

    for _ in range(100):
        p = [posterior(v) for v in votes]
        fresh = {}
        for c in (0, 1):
            weight = [x if c else 1 - x for x in p]
            for i in range(k):
                for v in (0, 1, 2):
                    seen = sum(w for w, vote in zip(weight, votes) if int(vote[i]) == v)
                    fresh[i, c, v] = (seen + pseudo * start[c][v]) / (sum(weight) + pseudo)
        if max(abs(fresh[x] - rate[x]) for x in rate) < 1e-9:
            break
        rate, prior = fresh, (sum(p) + 0.8) / (len(votes) + 1)
    return [posterior(v) for v in votes]


def plain_scores(texts, targets):
    """Logistic regression with dictionaries of hashed word shapes; scores of the texts."""
    cls = lambda c: 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
    hashed = lambda x: int(weak_labels.Words([x]).hashes()[0])
    mix = lambda x: int(weak_labels.mix(np.array([x % (1 << 64)], np.uint64))[0])
    bags = []
    for t in texts:
        w = [x for x in re.split(rb"[ \t\n\x0b\x0c\r]+", (t or "").encode()) if x]
        bag, before, last = {}, 1, None
        for x in w:
            kinds = list(map(cls, x))
            shape = hashed(bytes(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]))
            for place in (shape, mix(before * 0x9E3779B97F4A7C15 + shape + (x == last))):
                bag[place % weak_labels.FEATURES] = bag.get(place % weak_labels.FEATURES, 0) + 1 / (len(w) + weak_labels.USUAL_WORDS)
            before, last = shape, x
        bags.append(bag)
    weight, seen, bias, bias_seen = {}, {}, 0.0, 1e-8
    used = [i for i, b in enumerate(bags) if b]
    for _ in range(weak_labels.ROUNDS):
        error = {i: 1 / (1 + np.exp(-(sum(x * weight.get(k, 0.0) for k, x in bags[i].items()) + bias))) - targets[i] for i in used}
        gradient = {k: 1e-6 * v for k, v in weight.items()}
        for i in used:
            for k, x in bags[i].items():
                gradient[k] = gradient.get(k, 0.0) + x * error[i] / len(used)
        for k, g in gradient.items():
            seen[k] = seen.get(k, 1e-8) + g * g
            weight[k] = weight.get(k, 0.0) - 0.5 * g / seen[k] ** 0.5
        step = sum(error.values()) / len(used)
        bias_seen += step**2
        bias -= 0.5 * step / bias_seen**0.5
    return [1 / (1 + np.exp(-(sum(x * weight[k] for k, x in b.items()) + bias))) if b else 0.0 for b in bags]


def test_classifier_like_brute_force(spark, monkeypatch, tmp_path):
    """Votes, label model and scorer against plain versions of all three, rows repeated and texts missing."""
    monkeypatch.setattr(weak_labels, "ROUNDS", 25)
    monkeypatch.setattr(weak_labels.train, "__defaults__", (25,))
    texts = [r[1][:400] for r in table(60, 11)] + [None, "", "é ÉÀ 12ab!! ok?? a1b2 der ## x", "a", "a a a", "Good. Good. Good."]
    rows = list(enumerate(texts)) + [(3, texts[3])] * 4
    spark.createDataFrame([(*r, "l", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(weak_labels.op10_weak_label_quality(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    rows.sort(key=lambda r: r[0])
    votes = [plain_votes(t) for _, t in rows]
    assert [r.votes for r in got] == votes
    want = plain_scores([t for _, t in rows], plain_em(votes))
    assert np.allclose([r.score for r in got], want, atol=1e-5)
    assert [r.kept for r in got] == [s >= weak_labels.KEEP for s in want]


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(weak_labels, "TRAINING_DOCS", 50)
    monkeypatch.setattr(weak_labels, "TRAINING_FEATURES", 2000)
    seen = []
    monkeypatch.setattr(weak_labels, "train", lambda places, values, targets, counts: seen.append((len(places), sum(map(len, places)), counts.sum())) or np.zeros(weak_labels.FEATURES + 1))
    rows = [(r[0], r[1]) for r in table(300, 13)]
    weak_labels.fit(spark.createDataFrame(rows + [(5, "the same text again and again")] * 500, "doc_id long, text string"))
    weak_labels.fit(spark.createDataFrame([(5, "the same text again and again")] * 500, "doc_id long, text string"))
    assert 0 < seen[0][0] <= 50 and seen[0][1] <= 2000
    assert seen[1][0] == 1 and seen[1][2] == 500


@pytest.mark.parametrize("bound", [10_000, 200])
def test_classifier_on_held_out_kinds(spark, monkeypatch, bound):
    monkeypatch.setattr(weak_labels, "TRAINING_DOCS", bound)
    rows = table(900, 3)
    odd = [(-1, None, "en", "a", 0), (-2, " \n", "en", "a", 0), (-3, "Good.", "en", "a", 0), (-4, "wide and so on " * 20_000, "en", "a", 0), (None, rows[1][1], "en", "a", 0), (None, rows[1][1], "en", "a", 0)]
    df = spark.createDataFrame([(*r[:5], True, 1.0) for r in rows] + [(*r, True, 1.0) for r in odd], DOCS)
    clash = df.withColumnsRenamed({"d2": "score"}).withColumn("votes", F.lit("mine")).withColumn("h", F.lit(1))
    got = weak_labels.classify(clash, columns=("lang", "score", "votes", "kept", "h")).collect()
    assert len(got) == len(rows) + len(odd)
    kept = {r.doc_id: r.kept for r in got}
    kinds = {r[0]: r[5] for r in rows}
    right = sum(kept[i] == (k == "good") for i, k in kinds.items())
    assert right >= 0.98 * len(rows)
    assert all(kept[i] for i, k in kinds.items() if k == "good")
    assert not kept[-1] and not kept[-2] and kept[None]
    assert weak_labels.classify(df.limit(0)).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    rows = table(300, 5)
    copies = [(1000 + i, rows[i][1], rows[i][2], rows[i][3], rows[i][4], "copy") for i in (1, 2, 3)]
    near = rows[4][1].split()
    near[10] = "changed"
    copies.append((1004, " ".join(near), rows[4][2], rows[4][3], 1, "copy"))
    spark.createDataFrame([(*r[:5], True, 1.0) for r in rows + copies], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kinds = {r[0]: r[5] for r in rows + copies}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    good = {i for i, k in kinds.items() if k in ("good", "copy")}
    assert seen[0] >= good and seen[1] == good and not seen[0] >= set(kinds)
    assert seen[2] == {i for i, k in kinds.items() if k == "good"}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    assert len(tokens) == mixed.count() and all(len(r.token_ids) == r.n_tokens for r in tokens)
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.ids_sha256) for r in tokens)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
