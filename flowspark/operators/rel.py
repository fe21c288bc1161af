"""Rows with an order: what flows between operators, and global order without a single task.

Results of the language depend on arrival order. Rows keep their order key in hidden columns. Global row numbers,
running sums and lags cut the order key's range into buckets at approximate quantiles; windows run inside a bucket,
and what a bucket needs from earlier ones is a small table with a row per bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError

#: Most buckets of an order key; it also bounds the tables that are broadcast back to the rows, a row per bucket.
MAX_BUCKETS = 4096
#: Marks that are looked through one by one; with more, the right run of marks is found first.
RUN = 64
#: Leading bytes of a text that place it among the buckets.
TEXT_BYTES = 6
ORDER, BUCKET = "__ord", "__bucket"


@dataclass(frozen=True)
class Rel:
    """``visible`` columns in their order and, hidden, the columns of a total order."""

    df: DataFrame
    visible: list[str]
    order: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str] | None = None) -> Rel:
        names = [f"{ORDER}_{i}" for i, _ in enumerate(order_by or [])]
        hidden = {n: F.col(c) for n, c in zip(names, order_by or [], strict=True)}
        return cls(df.withColumns(hidden) if hidden else df, [c for c in df.columns if not c.startswith(ORDER)], names)

    def result(self, sort: bool = False) -> DataFrame:
        df = self.df.orderBy(*self.order) if sort and self.order else self.df
        return df.select(*["`" + c.replace("`", "``") + "`" for c in self.visible])

    def with_df(self, df: DataFrame) -> Rel:
        return replace(self, df=df)

    def keys(self) -> list[Column]:
        if not self.order:
            raise CompileError("this operator depends on the order of rows: give the stream an order_by")
        return [F.col(c) for c in self.order]


def _text_place(text: Column) -> Column:
    """A number that never falls as texts grow: their leading bytes, with zeros where a text ends."""
    digits = F.rpad(F.substring(F.hex(text.cast("binary")), 1, 2 * TEXT_BYTES), 2 * TEXT_BYTES, "0")
    return F.conv(digits, 16, 10).cast("long")


def _marks_below(marks: list, value: Column, kind: T.DataType) -> Column:
    """How many of the sorted marks lie below the value."""
    below = lambda at: F.size(F.filter(at, lambda m: m < value))
    column = lambda found: F.array(*[F.lit(m).cast(kind) for m in found])
    if len(marks) <= RUN:
        return F.when(value.isNull(), 0).otherwise(below(column(marks)))
    runs = [marks[i : i + RUN] for i in range(0, len(marks), RUN)]
    run = below(column([r[-1] for r in runs[:-1]]))
    return F.when(value.isNull(), 0).otherwise(run * RUN + below(F.get(F.array(*map(column, runs)), run)))


class Ordered:
    """Rows of ``rel`` in ``BUCKET``s of their order."""

    def __init__(self, rel: Rel):
        self.keys = rel.keys()
        df = rel.df
        first, kind = F.col(rel.order[0]), df.schema[rel.order[0]].dataType
        if isinstance(kind, T.StringType):
            first, kind = _text_place(first), T.LongType()
        cut = F.lit(0)
        n = min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if n > 1 and isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            marks = df.select(F.percentile_approx(first, [i / n for i in range(1, n)], max(1000, 10 * n))).first()[0] or []
            marks = sorted(set(marks))
            if marks:
                cut = _marks_below(marks, first, kind)
        self.df = df.withColumn(BUCKET, cut.cast("int"))
        self.inside = Window.partitionBy(BUCKET).orderBy(*self.keys)

    def _earlier(self, per_bucket: DataFrame, value: str) -> DataFrame:
        """Sums of ``value`` over earlier buckets; one row per bucket, at most MAX_BUCKETS + 1."""
        w = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return per_bucket.select(F.col(BUCKET).alias("__b"), F.coalesce(F.sum(value).over(w), F.lit(0)).alias("__before"))

    @staticmethod
    def _joined(df: DataFrame, per_bucket: DataFrame) -> DataFrame:
        """Rows with their bucket's row. Buckets are never null; the null-safe test keeps the optimiser from carrying
        the bucket's own expression over to the other side, whose columns can't evaluate it."""
        return df.join(F.broadcast(per_bucket), F.col(BUCKET).eqNullSafe(F.col("__b"))).drop("__b")

    def index(self, name: str) -> Ordered:
        """Adds the row's place, from 0."""
        return self.running(name, F.lit(1).cast("long"), inclusive=False)

    def running(self, name: str, value: Column, inclusive: bool = True) -> Ordered:
        """Adds the sum of ``value`` over all rows up to this one, or up to the one before."""
        df = self.df.withColumn("__v", value)
        totals = df.groupBy(BUCKET).agg(F.sum("__v").alias("__t"))
        kind = df.schema["__v"].dataType
        here = F.sum("__v").over(self.inside.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn(name, here if inclusive else here - F.coalesce(F.col("__v"), F.lit(0).cast(kind)))
        df = self._joined(df, self._earlier(totals, "__t"))
        self.df = df.withColumn(name, (F.coalesce(F.col(name), F.lit(0)) + F.col("__before")).cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long")).drop("__v", "__before")
        return self

    def lag(self, name: str, value: Column) -> Ordered:
        """Adds ``value`` of the row before as a struct ``name.v``; the struct is null for the first row of all."""
        df = self.df.withColumn("__s", F.struct(value.alias("v")))
        last = df.groupBy(BUCKET).agg(F.max_by("__s", F.struct(*self.keys)).alias("__l"))
        before = last.select(F.col(BUCKET).alias("__b"), F.lag("__l").over(Window.orderBy(BUCKET)).alias("__lagged"))
        df = self._joined(df.withColumn(name, F.lag("__s").over(self.inside)), before)
        self.df = df.withColumn(name, F.coalesce(name, "__lagged")).drop("__s", "__lagged")
        return self
