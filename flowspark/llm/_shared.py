"""Helpers of the training-data operators: materialised tables and salted joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, remove_at_end, shared_folder, written

__all__ = ["ASCII_SPACE", "Scratch", "lookup", "remove_at_end", "salted_lookup", "shared_folder", "table", "text_bytes", "with_heavy", "written"]

#: Word separators: space and the ASCII controls from tab to carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Copies of a row that a salted join spreads over.
SALTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, how: str = "left", hot: Column | None = None) -> DataFrame:
    """Join ``left`` to ``right``, which has few rows per key, with each key's left rows dealt over ``SALTS`` tasks.

    ``spread`` is a left column that tells rows of one key apart. Right rows are repeated once per salt; with ``hot``,
    a condition on right rows, the rest must match no left row and are left out. Keys join null-safely.
    """
    if hot is not None:
        right = right.filter(hot)
    names = [c for c in right.columns if c not in keys]
    right = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *names, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__r_salt")
    )
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    on = F.col("__salt") == F.col("__r_salt")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, on, how).drop("__salt", "__r_salt", *[f"__r_{k}" for k in keys])


#: A hash that more than one in so many rows share is heavy; so there are no more heavy ones than this.
HEAVY_SHARE = 4096


def with_heavy(df: DataFrame, h: str, name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the boolean ``name``: whether more than one in HEAVY_SHARE rows, and more than HEAVY_SHARE, have the
    hash in column ``h``. Hashes are counted with partial sums; at most HEAVY_SHARE of them are sent back to the rows."""
    counts = df.groupBy(F.col(h).alias("__heavy_h")).agg(F.count(F.lit(1)).alias("n"))
    most = keep(counts.filter(F.col("n") > max(HEAVY_SHARE, df.count() // HEAVY_SHARE)).select("__heavy_h"))
    marked = df.join(F.broadcast(most), F.col(h) == F.col("__heavy_h"), "left")
    return marked.withColumn(name, F.col("__heavy_h").isNotNull()).drop("__heavy_h")


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


#: A small side of up to so many rows is broadcast; a larger one joins by salted shuffle.
BROADCAST_ROWS = 10_000


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, rows: int | None = None) -> DataFrame:
    """Inner, null-safe join of ``left`` with a table of few rows per key, which has been written already. ``rows``:
    no less than the table's number of rows, if it is known."""
    if (right.count() if rows is None else rows) > BROADCAST_ROWS:
        return salted_lookup(left, right, keys, spread, "inner")
    named = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(F.broadcast(named), on).drop(*[f"__r_{k}" for k in keys])
