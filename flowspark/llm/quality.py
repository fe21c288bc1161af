"""Quality rules: base rules on text statistics, then robust multivariate outliers per language and source.

Each (language, source) gets a minimum-covariance-determinant estimate of location and scatter of the documents'
transformed statistics. From each of three starts (medians with quartile ranges, all rows, spatial signs) concentration
steps keep the ``SUPPORT`` share of smallest Mahalanobis distance and estimate again until the determinant stays; the
start that ends with the least determinant counts. Estimates are scaled to normal data's median distance and lean on
their language's by the number of documents. Documents far from their group's estimate are rejected.

Everything is DataFrame expressions. A step counts documents per distance bin, cuts the bins at the support, the last
one in part, and sums moments per group, all with partial aggregation, so no group has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, Scratch, lookup, table, written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Share of a group that a concentration step keeps; the most steps; and the change of the scatter's log determinant
#: below which an estimate has converged.
SUPPORT = 0.75
STEPS = 8
TOLERANCE = 1e-3
#: Documents' worth of weight that a language's estimate has in that of each of its sources, and all languages' in a
#: language's: a small source leans on its language by degrees.
PRIOR = 200
#: Transformed statistics, with the least standard deviation that each is taken to have: a scatter matrix of a group
#: without any symbols or repeats would be singular. It is the statistic's resolution, the deviation that counts of
#: Poisson's law give in the smallest document that passes the base rules: MIN_WORDS words of 5 characters, 10 to a
#: line. That is 1/sqrt(n) for the logarithm of a mean and 1/(2 sqrt(n)) for the root of a share of n. Repeated words
#: come six at a time, two windows of three. Lines and repeats are so few that this exceeds 0.15, which is the most.
FLOORS = {
    "x_word": round((5 * MIN_WORDS) ** -0.5, 4),
    "x_symbol": round((5 * MIN_WORDS) ** -0.5 / 2, 4),
    "x_line": min(0.15, round((MIN_WORDS / 10) ** -0.5 / 2, 4)),
    "x_repeat": min(0.15, round((MIN_WORDS / 6) ** -0.5 / 2, 4)),
    "x_capital": round((5 * MIN_WORDS) ** -0.5 / 2, 4),
}
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "base_failed", "d2", "kept")
#: Largest squared distance that is kept, the 0.9999 quantile of chi-square with five degrees of freedom, and
#: the median of the squared distance, for five normal variables.
CUTOFF = 25.74
MEDIAN_D2 = 4.35
#: Distance bins in an octave of the squared distance; bins in a unit of a statistic.
OCTAVE, UNIT = 16, 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, ASCII_SPACE[1:], " " * 5), " "), "")


def repeated_words(word_list: Column) -> Column:
    """Number of words in a window of three words that the list holds twice or more."""

    def counted(w: Column, hashes: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        high = lambda k: F.call_function("shiftright", k, bits)
        # A window's hash with its place in the low bits: equal windows are neighbours once sorted.
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long"))))
        alike = _let(
            keys,
            lambda s: F.transform(
                F.filter(s, lambda k, i: F.coalesce(high(F.get(s, i - 1)) == high(k), F.lit(False)) | F.coalesce(high(F.get(s, i + 1)) == high(k), F.lit(False))),
                lambda k: k.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"),
            ),
        )
        # Hashes only nominate; the windows themselves decide.
        windows = F.array_sort(
            F.transform(alike, lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p")))
        )
        places = _let(
            windows,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["s"] == x["s"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["s"] == x["s"], F.lit(False))),
                    lambda x: x["p"],
                )
            ),
        )
        return _let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), x - 3))), F.lit(0), lambda a, x: a + x
            ),
        )

    def marked(w: Column) -> Column:
        hashes = F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        # Most texts repeat no window, which distinct hashes show at once.
        found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(w, h)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(found)

    return _let(word_list, marked).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text but with the base statistics (long) and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.translate(line, ASCII_SPACE, "") != "")
    listed = docs.withColumn("__whole", whole).withColumn("__words", words(whole)).withColumn("__lines", lines)
    t = F.col("__whole")
    out = listed.select(
        *[c for c in docs.columns if c != text],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(t, ASCII_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length(t) - F.length(F.translate(t, CAPITALS, ""))).cast("long").alias("n_capitals"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns(
        {
            "x_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
            "x_symbol": share("n_symbols", "word_chars"),
            "x_line": share("n_dup_lines", "n_lines"),
            "x_repeat": share("n_repeat_words", "n_words"),
            "x_capital": share("n_capitals", "word_chars"),
        }
    )


def _gid(lang: str, source: str) -> Column:
    return F.xxhash64(F.col(lang).isNull(), lang, F.col(source).isNull(), source)


def _cholesky(params: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``l_i_j``, the lower triangular factor of the scatter ``c_i_j``, column by column."""
    for j in range(len(names)):
        rest = F.col(f"c_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(rest))
        below = {
            f"l_{i}_{j}": (F.col(f"c_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}")
            for i in range(j + 1, len(names))
        }
        params = params.withColumns(below) if below else params
    return params


def _distance(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution."""
    for i, x in enumerate(names):
        z = F.col(x) - F.col(f"m_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"z_{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn("d2", sum((F.col(f"z_{i}") ** 2 for i in range(1, len(names))), F.col("z_0") ** 2))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(F.greatest(d2, F.lit(1e-9))) * OCTAVE).cast("int")


def _floored(names: list[str], mean: Callable[[int], Column], product: Callable[[int, int], Column]) -> list[Column]:
    """``m_i`` and, with the floors on its diagonal, ``c_i_j``."""
    floor = list(FLOORS.values())
    p = range(len(names))
    return [
        *[mean(i).alias(f"m_{i}") for i in p],
        *[(product(i, j) + F.lit(floor[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in p for j in range(i + 1)],
    ]


def _starts(points: DataFrame, names: list[str], spread: Column, rows: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Three estimates per group to start from: medians and interquartile ranges, from counts per bin (0); mean and
    scatter of all rows (1); the scatter of the directions from the medians, each row counting alike (2)."""
    p = range(len(names))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    each = points.select("gid", F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * UNIT).alias("b")) for i, x in enumerate(names)])))
    counts = each.groupBy("gid", "i", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("gid", "i").orderBy("b")
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("gid", "i")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("b") + 0.5) / UNIT))
    marks = ranked.groupBy("gid", "i").agg(at(0.5).alias("mid"), ((at(0.75) - at(0.25)) / 1.349).alias("spread"))
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    middle = keep(marks.groupBy("gid").agg(*[of(i, "mid").alias(f"m_{i}") for i in p], *[of(i, "spread").alias(f"s_{i}") for i in p]))
    quartiles = middle.select("gid", F.lit(0).alias("start"), *_floored(names, lambda i: F.col(f"m_{i}"), lambda i, j: F.col(f"s_{i}") ** 2 if i == j else F.lit(0.0)))
    # Offsets from the medians keep the sums of products exact.
    met = lookup(points, middle, ["gid"], spread, rows).withColumns({f"o_{i}": F.col(x) - F.col(f"m_{i}") for i, x in enumerate(names)})
    met = met.withColumns({f"u_{i}": F.col(f"o_{i}") / F.greatest(F.col(f"s_{i}"), F.lit(floor)) for i, floor in enumerate(FLOORS.values())})
    met = met.withColumn("r", sum((F.col(f"u_{i}") ** 2 for i in p), F.lit(1e-9)))
    sums = met.groupBy("gid").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"{c}_{i}").alias(f"{c}_{i}") for i in p for c in "ms"],
        *[F.sum(f"o_{i}").alias(f"t_{i}") for i in p], *[F.sum(F.col(f"o_{i}") * F.col(f"o_{j}")).alias(f"q_{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(f"u_{i}") * F.col(f"u_{j}") / F.col("r")).alias(f"d_{i}_{j}") for i, j in pairs],
    )
    n, scale = F.col("n"), lambda i: F.greatest(F.col(f"s_{i}"), F.lit(list(FLOORS.values())[i]))
    whole = _floored(names, lambda i: F.col(f"m_{i}") + F.col(f"t_{i}") / n, lambda i, j: F.col(f"q_{i}_{j}") / n - F.col(f"t_{i}") * F.col(f"t_{j}") / n**2)
    signs = _floored(names, lambda i: F.col(f"m_{i}"), lambda i, j: F.lit(len(names)) * F.col(f"d_{i}_{j}") / n * scale(i) * scale(j))
    sums = keep(sums)
    return quartiles.unionByName(sums.select("gid", F.lit(1).alias("start"), *whole)).unionByName(sums.select("gid", F.lit(2).alias("start"), *signs))


def _factored(params: DataFrame, names: list[str]) -> DataFrame:
    """Adds the scatter's factor and ``log_det``."""
    out = _cholesky(params, names)
    return out.withColumn("log_det", sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(names))), 2 * F.log("l_0_0")))


def _concentrate(points: DataFrame, params: DataFrame, names: list[str], spread: Column, rows: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Location and scatter of the SUPPORT share of each group that is nearest under each of its ``params``; the bin at
    the cut counts in part."""
    p = range(len(names))
    pairs = [(i, j) for i in p for j in range(i + 1)]
    seen = lambda given: _distance(lookup(points, given, ["gid"], spread, rows), names).withColumn("bin", _bin(F.col("d2")))
    w = Window.partitionBy("gid", "start")
    counts = seen(params).groupBy("gid", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("most", SUPPORT * F.sum("n").over(w))
    cut = counts.filter((F.col("before") < F.col("most")) & (F.col("before") + F.col("n") >= F.col("most")))
    cut = keep(params.join(cut.select("gid", "start", F.col("bin").alias("cut"), ((F.col("most") - F.col("before")) / F.col("n")).alias("part")), ["gid", "start"]))
    weighted = seen(cut).filter(F.col("bin") <= F.col("cut")).withColumn("w", F.when(F.col("bin") < F.col("cut"), F.lit(1.0)).otherwise(F.col("part")))
    off = [F.col(x) - F.col(f"m_{i}") for i, x in enumerate(names)]
    total = weighted.groupBy("gid", "start").agg(
        F.sum("w").alias("n"), F.first("log_det").alias("was"), *[F.first(f"m_{i}").alias(f"m_{i}") for i in p],
        *[F.sum(F.col("w") * off[i]).alias(f"s_{i}") for i in p], *[F.sum(F.col("w") * off[i] * off[j]).alias(f"q_{i}_{j}") for i, j in pairs],
    )
    n = F.col("n")
    moved = _floored(names, lambda i: F.col(f"m_{i}") + F.col(f"s_{i}") / n, lambda i, j: F.col(f"q_{i}_{j}") / n - F.col(f"s_{i}") * F.col(f"s_{j}") / n**2)
    return _factored(total.select("gid", "start", "was", *moved), names)


def _leaning(est: DataFrame, names: list[str], by: list[str], onto: DataFrame | None) -> DataFrame:
    """Sums up estimates (with their numbers ``n`` of documents) per ``by`` and lets each lean on that of ``onto``, which
    has one row per value of its own columns, by PRIOR documents."""
    entries = [*[f"m_{i}" for i in range(len(names))], *[f"c_{i}_{j}" for i in range(len(names)) for j in range(i + 1)]]
    mean = lambda c: (F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c)
    own = est.groupBy(*by).agg(*[mean(c) for c in entries], F.sum("n").alias("n"))
    if onto is None:
        return own
    keys = [c for c in onto.columns if c in by]
    base = onto.select(*[F.col(c).alias(f"__r_{c}") for c in onto.columns])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    share = F.col("n") / (F.col("n") + F.lit(float(PRIOR)))
    return own.join(base, on).select(*by, "n", *[(share * F.col(c) + (1 - share) * F.col(f"__r_{c}")).alias(c) for c in entries])


def fit(good: DataFrame, key: str, lang: str, source: str) -> DataFrame:
    """Written ``lang, source, m_i, l_i_j``, the estimate of each group of ``good``: a written table with the transformed
    statistics of the documents that passed the base rules. Tables with a row per document hold five numbers."""
    names = list(FLOORS)
    spread = F.xxhash64("__k", *names)
    with Scratch(good.sparkSession) as scratch:
        keep = scratch.written
        points = keep(good.select(_gid(lang, source).alias("gid"), *names, F.col(key).alias("__k")))
        groups = keep(good.select(_gid(lang, source).alias("gid"), lang, source).distinct())
        rows = 3 * groups.count()  # a row for each start
        running = keep(_factored(_starts(points, names, spread, rows, keep), names))
        done: list[DataFrame] = []
        for k in range(STEPS):
            moved = keep(_concentrate(points, running, names, spread, rows, keep))
            still = F.abs(F.col("log_det") - F.col("was")) > TOLERANCE if k < STEPS - 1 else F.lit(False)
            done.append(moved.filter(~still).drop("was"))
            running = moved.filter(still).drop("was")
            if running.isEmpty():
                break
        ends = done[0]
        for d in done[1:]:
            ends = ends.unionByName(d)
        # The start of least determinant; of equal ones the first.
        best = ends.groupBy("gid").agg(F.min(F.struct(F.round("log_det", 9).alias("d"), "start")).alias("b")).select(F.col("gid").alias("g"), F.col("b.start").alias("s"))
        best = keep(ends.join(best, (F.col("gid") == F.col("g")) & (F.col("start") == F.col("s"))).drop("g", "s", "start", "log_det"))
        # Scaled so that the median distance is no larger than normal data's.
        seen = _distance(lookup(points, best, ["gid"], spread, rows), names).withColumn("bin", _bin(F.col("d2")))
        counts = seen.groupBy("gid", "bin").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("gid")
        ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
        median = ranked.filter(2 * F.col("upto") >= F.col("all")).groupBy("gid").agg(F.min("bin").alias("bin"), F.first("all").alias("n"))
        scale = median.select("gid", "n", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 0.5) / OCTAVE) / MEDIAN_D2).alias("scale"))
        scaled = {f"c_{i}_{j}": F.col(f"c_{i}_{j}") * F.col("scale") for i in range(len(names)) for j in range(i + 1)}
        est = keep(groups.join(best.join(scale, "gid").withColumns(scaled), "gid"))
        language = _leaning(est, names, [lang], _leaning(est, names, [], None).drop("n")).drop("n")
        leant = _cholesky(_leaning(est, names, [lang, source], language), names)
        return written(leant.select(lang, source, *[c for c in leant.columns if c[:2] in ("m_", "l_")]))


def judge(stats: DataFrame, params: DataFrame, key: str, lang: str, source: str) -> DataFrame:
    """``stats`` with ``d2`` and ``kept`` under the groups' estimates; rows that fail the base rules have a null ``d2``.
    The table of estimates comes to the rows, which stay where they are unless there are very many groups."""
    names = list(FLOORS)
    good = _distance(lookup(stats.filter(~F.col("base_failed")), params, [lang, source], F.xxhash64(key, *names)), names)
    verdict = good.select(*stats.columns, "d2").withColumn("kept", F.col("d2") <= CUTOFF)
    failed = stats.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return verdict.unionByName(failed)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of ``docs``: key, language, source, base statistics, ``base_failed``, ``d2`` and ``kept``.

    ``kept`` is false for rows that fail the base rules, else whether the squared robust distance ``d2`` is at most
    CUTOFF. Rows that fail the base rules take no part in the estimates and have a null ``d2``.

    A null or empty text has no words and fails. Null languages and sources are values of their own. Repeated rows
    count each time. Other columns of ``docs`` aren't read. An empty table gives an empty result.
    """
    stats = written(vectors(statistics(docs.select(key, text, lang, source), text)))
    params = fit(stats.filter(~F.col("base_failed")), key, lang, source)
    return judge(stats, params, key, lang, source).select(key, lang, source, *OUTPUT)


def keep_by_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Two passes over the texts: one for the estimates, one that judges each row where it is read. No text is shuffled
    or written, and nothing that grows with the documents is sent to executors. Nulls, repeated rows and empty tables
    are as in ``quality_rules``: null texts go, repeated rows go or stay together. No column name is reserved.
    """
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.written(vectors(statistics(docs.select(key, text, lang, source), text)))
        params = fit(stats.filter(~F.col("base_failed")), key, lang, source)
    # Columns of the caller are carried in a struct, so that none can clash.
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.col(source).alias("__source"))
    named = params.withColumnsRenamed({lang: "__lang", source: "__source"})
    # The verdict needs both sides of the join, so that no part of it is evaluated below a second time.
    judged = _distance(lookup(vectors(statistics(whole, "__text")), named, ["__lang", "__source"], F.xxhash64("__key", *FLOORS)), list(FLOORS))
    return judged.filter(F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("d2") <= CUTOFF)).select("__row.*")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", F.round("d2", 4).alias("d2"))
