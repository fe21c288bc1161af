"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate that brings its bytes to its target share. A document's number of copies is
the Poisson distribution of that mean, inverted at a uniform number that a hash of the document and a seed gives; the
copies are exploded and dealt over the output in an order that hashes fix.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SALTS, table, text_bytes, with_heavy, written

SEED = 17
#: A mean above this is split into equal parts, whose Poisson counts add up; the inverted tables stay short.
PART_MEAN = 4.0
#: Terms of an inverted table: the mass beyond them, for PART_MEAN, is below 2 ** -52, the step of the uniform numbers.
TABLE_TERMS = 32
#: Up to so many sources are broadcast; more join by a salted shuffle.
BROADCAST_SOURCES = 10_000
#: Target weights of the registered query: any other source has weight 1.
TARGET_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5}


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts joined by colons; null parts are ``-``."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """``source, source_bytes, rate`` for every source of ``docs``, null included.

    The output's expected bytes are ``epochs`` times the input's, shared out in proportion to the weights; sources
    that ``weights`` doesn't name have weight 1. A source without bytes has rate 1.
    """
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = written(docs.groupBy(F.col(source).alias("source")).agg(F.sum(text_bytes(text)).alias("source_bytes")))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("source_bytes").alias("b"), F.sum(F.when(F.col("source_bytes") > 0, F.col("weight"))).alias("w")).first()
    factor = F.lit(float(epochs)) * F.lit(float(total.b or 0)) / F.lit(float(total.w or 1.0))
    rate = F.when(F.col("source_bytes") > 0, F.col("weight") * factor / F.col("source_bytes")).otherwise(F.lit(1.0))
    return sizes.select("source", "source_bytes", rate.alias("rate"))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... under a Poisson distribution."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE_TERMS)), start, step)["c"]


def replicate(docs: DataFrame, weights: Mapping[str, float], epochs: float = 1.0, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with ``rate``, ``copies`` and ``copy_no``, one row per copy, in a global order given by hashes.

    A row's partition and its place inside the partition are hashes of the document, the copy and the seed, so the
    order is a fixed random one over all sources, and a rerun gives the same.

    A null source is a source of its own. Null keys are told apart by their text. Repeated rows get the same number
    of copies each; very many of one key are dealt over the output by their place in the input. Columns named ``rate``, ``copies`` or ``copy_no`` are replaced. An empty table gives none.
    """
    spark = docs.sparkSession
    new = ["rate", "copies", "copy_no"]
    docs = docs.drop(*[c for c in new if c in docs.columns])
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = written(
        repetition_rates(docs, weights, epochs, source, text)
        .select(F.col("source").alias("__source"), "rate", parts.alias("__parts"))
        .withColumn("__table", poisson_table(F.col("rate") / F.col("__parts")))
    )
    identity = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)))
    plain = docs.columns
    docs = with_heavy(docs.withColumn("__h", F.xxhash64(identity)).withColumn("__place", F.monotonically_increasing_id()), "__h", "__heavy", written)
    if rates.count() <= BROADCAST_SOURCES:
        rated = docs.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("__source")))
    else:
        dealt = rates.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn("__salt", F.pmod(F.xxhash64(identity), F.lit(SALTS)).cast("int"))
        rated = rated.join(dealt, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__salt") == F.col("__s")))
    drawn = lambda j: F.size(F.filter(F.col("__table"), lambda c: c <= uniform(identity, F.lit(seed), j)))
    one = drawn(F.lit(1))
    many = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, j: acc + drawn(j))
    counted = rated.withColumn("copies", F.when(F.col("__parts") == 1, one).otherwise(many)).filter(F.col("copies") > 0)
    copied = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.xxhash64(identity, F.col("copy_no"), F.lit(seed), F.when(F.col("__heavy"), F.col("__place")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shuffled = copied.withColumn("__order", order).repartition(n, "__order").sortWithinPartitions("__order")
    return shuffled.select(*plain, *new)


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return replicate(docs, TARGET_WEIGHTS).withColumn("rate", F.round("rate", 9))


OP6_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS DOUBLE) AS b,
  CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 0.5::DOUBLE WHEN 'src2' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN b > 0 THEN w * (1.0::DOUBLE * (SELECT sum(b) FROM sizes) / (SELECT sum(w) FROM sizes WHERE b > 0)) / b ELSE 1.0::DOUBLE END AS rate FROM sizes),
parts AS (SELECT source, rate, greatest(ceil(rate / {PART_MEAN}), 1)::INTEGER AS parts FROM rates),
terms(source, mean, k, p, c) AS (
  SELECT source, rate / parts, 0, exp(-rate / parts), exp(-rate / parts) FROM parts
  UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM terms WHERE k < {TABLE_TERMS}),
drawn AS (SELECT d.*, rate, unnest(generate_series(1, parts)) AS j FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
u AS (SELECT *, row_number() OVER () AS r, ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, md5(text)), ':{SEED}:', j)), 1, 13))::BIGINT::DOUBLE / {1 << 52} AS u FROM drawn),
n AS (SELECT u.r, count(t.k) AS n FROM u LEFT JOIN terms t ON u.source IS NOT DISTINCT FROM t.source AND t.c <= u.u GROUP BY u.r),
counts AS (SELECT doc_id, text, lang, source, n_chars, rate, CAST(sum(n) AS INTEGER) AS copies FROM u JOIN n USING (r) GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies, unnest(generate_series(1, copies))::INTEGER AS copy_no FROM counts WHERE copies > 0
"""
