"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. How often each pattern of votes occurs, over all
documents, is all that expectation-maximisation needs to estimate the labellers' accuracies and the share of good
documents; the posteriors label a bounded sample, on which a linear scorer over hashed features is trained. The
scorer then judges every document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, table
from ._words import U64, Words, in_batches, mix

#: Documents that the scorer is trained on at most, those of least hash, and features that they hold together at most;
#: all are used where there are no more. Repeated rows are one document with its number of rows as weight.
TRAINING_DOCS = 8192
TRAINING_FEATURES = 16_000_000
#: Length of the hashed feature vector.
FEATURES = 1 << 16
ROUNDS = 300
#: Documents with a lower probability of being good are rejected.
KEEP = 0.5

GOOD, BAD, ABSTAIN = 1, 0, 2

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as be at by this and not or from have an they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus "
    "le la les de et des en un une du dans est que pour qui sur par au avec ce il elle "
    "el los las y del se por con una para su lo como más pero sus al"
).split()

#: Labeller: statistic, a vote of bad above, a vote of good up to.
LABELLERS: Mapping[str, tuple[float, float]] = {
    "symbols": (0.04, 0.005),
    "capitals": (0.35, 0.12),
    "repeats": (0.10, 0.03),
    "windows": (0.50, 0.25),
    "marks": (0.20, 0.03),
    "few_function_words": (0.95, 0.85),
    "unmarked_ends": (0.995, 0.98),
    "odd_words": (0.15, 0.03),
}

#: A short text's shares lean on this many words of the usual kind, with these shares of function words and sentence ends.
USUAL_WORDS, USUAL_FUNCTION, USUAL_ENDS = 10, 0.2, 0.08

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_LETTER = _CLASS >= ord("a")
_LETTER |= _CLASS == ord("A")
_LOWER = np.arange(256).astype(np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CAPITAL = _CLASS == ord("A")
_MARK = np.isin(np.arange(256), list(b"!?"))
_END = np.isin(np.arange(256), list(b".!?"))


@cache
def _function_hashes() -> np.ndarray:
    return np.sort(Words([w.encode() for w in FUNCTION_WORDS]).hashes())


@dataclass
class Described:
    """Statistics (texts by labellers), numbers of words, and the hashed features of each text's words."""

    stats: np.ndarray
    n_words: np.ndarray
    places: np.ndarray  # two for each word: its shape, and its shape after the last word's, with whether the word repeats it
    first: np.ndarray  # where each text's places begin

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.places) + 1)
        np.cumsum(weights[self.places], out=total[1:])
        z = (total[self.first[1:]] - total[self.first[:-1]]) / (self.n_words + USUAL_WORDS)
        return 1 / (1 + np.exp(-np.clip(z + weights[-1], -50, 50)))

    def counted(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text, and their values."""
        places, n = np.unique(self.places[self.first[i] : self.first[i + 1]], return_counts=True)
        return places.astype(np.int32), (n / (self.n_words[i] + USUAL_WORDS)).astype(np.float32)


def describe(texts: list[bytes]) -> Described:
    w = Words(texts)
    n = np.diff(w.first)
    classes = _CLASS[w.data]
    fresh = w.inner.copy()  # runs of one class count once
    fresh[1:] &= (classes[1:] != classes[:-1]) | ~w.inner[:-1]
    shape = w.hashes(classes, fresh)
    plain = w.hashes()
    core = w.hashes(_LOWER[w.data], _LETTER[w.data])
    known = _function_hashes()
    function = known[np.minimum(np.searchsorted(known, core), len(known) - 1)] == core
    last, last_but_one = w.data[w.ends - 1], w.data[np.maximum(w.ends - 2, 0)]
    marks = _MARK[last] & _MARK[last_but_one] & (w.ends - w.starts > 1)
    opens = np.zeros(len(plain), bool)
    opens[w.first[:-1][n > 0]] = True
    same = np.zeros(len(plain), bool)
    same[1:] = (plain[1:] == plain[:-1]) & ~opens[1:]
    windows = mix(plain[:-2] * U64(3) + plain[1:-1] * U64(5) + plain[2:] * U64(7)) if len(plain) > 2 else plain[:0]
    fewer = np.array([1 - len(np.unique(windows[a : b - 2])) / (b - a - 2) if b - a > 2 else 0.0 for a, b in zip(w.first[:-1], w.first[1:], strict=True)])
    chars = np.maximum(w.byte_sums(w.inner), 1)
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbols[1:])
    leant = n + USUAL_WORDS
    stats = np.stack(
        [
            w.byte_sums(_SYMBOL[w.data]) / chars,
            w.byte_sums(_CAPITAL[w.data]) / chars,
            w.sums(same) / leant,
            fewer,
            w.sums(marks) / leant,
            1 - (w.sums(function) + USUAL_FUNCTION * USUAL_WORDS) / leant,
            1 - (w.sums(_END[last]) + USUAL_ENDS * USUAL_WORDS) / leant,
            w.sums(symbols[w.ends] > symbols[w.starts]) / leant,
        ],
        axis=1,
    )
    before = np.zeros(len(shape), U64)
    before[1:] = shape[:-1]
    before[opens] = U64(1)
    pair = mix(before * U64(0x9E3779B97F4A7C15) + shape + same.astype(U64))
    places = np.stack([shape, pair], axis=1).ravel() % U64(FEATURES)
    return Described(stats, n, places.astype(np.int64), 2 * w.first)


def votes(d: Described) -> list[str]:
    """The labellers' votes on each text, a digit each. A text without words gets none."""
    bad, good = np.array(list(LABELLERS.values())).T
    cast = np.where(d.stats > bad, BAD, np.where(d.stats <= good, GOOD, ABSTAIN))
    cast[d.n_words == 0] = ABSTAIN
    return ["".join(map(str, row)) for row in cast.tolist()]


@dataclass(frozen=True)
class LabelModel:
    """Probability of each vote of each labeller for bad and good documents, and the share of good ones."""

    prior: float
    rates: np.ndarray  # labeller, class, vote

    def posterior(self, pattern: str) -> float:
        log = np.log([1 - self.prior, self.prior])
        for i, v in enumerate(map(int, pattern)):
            if v != ABSTAIN:
                log = log + np.log(self.rates[i, :, v])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))


def fit_label_model(patterns: Mapping[str, int], steps: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns with their numbers of documents. It starts from labellers that are
    seldom wrong about good documents; pseudo-counts keep all rates above zero. Without documents it stays there."""
    keys = sorted(patterns)
    k = len(LABELLERS)
    cast = np.array([[int(v) for v in p] for p in keys], int).reshape(len(keys), k)
    n = np.array([patterns[p] for p in keys], float)
    rates = np.empty((k, 2, 3))
    rates[:, GOOD] = (0.01, 0.84, 0.15)
    rates[:, BAD] = (0.40, 0.35, 0.25)
    model = LabelModel(0.8, rates)
    total = n.sum()
    for _ in range(steps if total else 0):
        p = np.array([model.posterior(x) for x in keys])
        fresh = np.empty_like(rates)
        for c, w in ((GOOD, n * p), (BAD, n * (1 - p))):
            for v in (BAD, GOOD, ABSTAIN):
                prior = rates[0, c, v] * max(1.0, 0.01 * total)
                fresh[:, c, v] = (w @ (cast == v) + prior) / (w.sum() + max(1.0, 0.01 * total))
        share = float((n @ p + 0.8) / (total + 1))
        if np.abs(fresh - model.rates).max() < 1e-9:
            break
        model = LabelModel(share, fresh)
    return model


def train(places: list[np.ndarray], values: list[np.ndarray], targets: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression on soft labels: full gradients with adaptive steps. ``counts``
    are the documents' weights."""
    share = counts / max(1, counts.sum())
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    at = np.concatenate(places).astype(np.int64) if places else np.zeros(0, np.int64)
    x = np.concatenate(values) if values else np.zeros(0)
    w, seen, bias, bias_seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8), 0.0, 1e-8
    for _ in range(rounds if len(places) else 0):
        score = np.bincount(rows, weights=x * w[at], minlength=len(places)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - targets) * share
        gradient = np.bincount(at, weights=x * error[rows], minlength=FEATURES) + 1e-6 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
        bias_seen += error.sum() ** 2
        bias -= 0.5 * error.sum() / bias_seen**0.5
    return np.append(w, bias)


def _texts(batch: pa.RecordBatch) -> Iterator[Described]:
    column = batch.column(0)
    return map(describe, in_batches(column[i].as_py() or "" for i in range(len(column))))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([v for d in _texts(batch) for v in votes(d)], pa.string())], ["pattern"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns, features = [], []
        for d in _texts(batch):
            patterns += votes(d)
            features += [d.counted(i) for i in range(len(d.n_words))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(patterns, pa.string()), pa.array([p for p, _ in features], pa.list_(pa.int32())), pa.array([v for _, v in features], pa.list_(pa.float32())), batch.column(1), batch.column(2)],
            ["pattern", "places", "values", "h", "n"],
        )


def _judge(weights: np.ndarray):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, scores = [], []
            for d in _texts(batch):
                patterns += votes(d)
                scores += np.where(d.n_words > 0, d.scores(weights), 0.0).tolist()
            new = [pa.array(patterns, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "votes", "score"])

    return judge


def _sample(docs: DataFrame, key: str, text: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Written features of the training documents, ``pattern, places, values, h, n``. Hashes choose rows where they are
    read; only these are shuffled, with repeated ones counted first, so neither long nor repeated rows meet unbounded."""
    hashed = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit(10), key, text).alias("h")).withColumn("at", F.pmod("h", F.lit(1 << 30)))
    distinct = hashed.agg(F.approx_count_distinct("h", 0.03).alias("n")).first().n
    if distinct > TRAINING_DOCS:  # more than are wanted; those of least hash stay
        hashed = hashed.filter(F.col("at") < F.lit(int(min(1.0, 1.2 * TRAINING_DOCS / distinct) * (1 << 30))))
    one = hashed.groupBy("at", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return keep(one.select("text", "h", "n").mapInArrow(_features, "pattern string, places array<int>, values array<float>, h long, n long"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[LabelModel, np.ndarray]:
    """The label model, from all rows, and the scorer's weights, from TRAINING_DOCS documents with TRAINING_FEATURES
    features at most, those of least hash: so much reaches the driver."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.written(docs.select(text).mapInArrow(_vote, "pattern string").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
        patterns = {r.pattern: r.n for r in found.collect()}  # at most 3 ** len(LABELLERS) rows
        model = fit_label_model(patterns)
        sample = _sample(docs, key, text, scratch.written)
        at = F.pmod("h", F.lit(1 << 30))
        sizes = sample.select(at.alias("at"), "h", F.size("places").alias("size")).orderBy("at", "h").limit(TRAINING_DOCS).collect()
        held, last = 0, (-1, 0)
        for r in sizes:
            held += r["size"]
            if held > TRAINING_FEATURES and last[0] >= 0:
                break
            last = (r["at"], r.h)
        chosen = sample.filter((at < last[0]) | ((at == last[0]) & (F.col("h") <= last[1])))
        rows = chosen.toArrow()
    place, hashes = np.asarray(rows.column("h")) % (1 << 30), np.asarray(rows.column("h"))
    order = np.lexsort((hashes, place)) if rows.num_rows else []
    posterior = {p: model.posterior(p) for p in patterns}
    places, values, target, counts = [], [], [], []
    for i in map(int, order):
        p = rows.column("places")[i].values.to_numpy()
        if len(p):
            places.append(p)
            values.append(rows.column("values")[i].values.to_numpy().astype(float))
            target.append(posterior.get(rows.column("pattern")[i].as_py(), model.prior))
            counts.append(rows.column("n")[i].as_py())
    return model, train(places, values, np.array(target), np.array(counts, float))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = (), fitted: tuple[LabelModel, np.ndarray] | None = None) -> DataFrame:
    """``text``, key, ``columns``, ``votes``, ``score`` (probability of a good document) and ``kept`` of each row.

    A null text or one without words scores 0 and isn't kept. Repeated rows score alike. Columns of ``docs`` that
    aren't named are left out, and so are named ones that are called ``votes``, ``score`` or ``kept``. Without documents
    nothing is trained and the result is empty.
    """
    _, weights = fitted or fit(docs, key, text)
    names = [text, key, *[c for c in columns if c not in (text, key, "votes", "score", "kept")]]
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", votes string, score double"
    judged = docs.select(*names).mapInArrow(_judge(weights), schema)
    return judged.withColumn("kept", F.col("score") >= KEEP)


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "votes", "score", "kept")
