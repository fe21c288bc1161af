"""Tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of this machine; on
    a cluster that is an error, as executors couldn't see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='flowspark-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/flowspark-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove_at_end(spark: SparkSession, folder: str) -> str:
    """Has ``folder``, which must exist, removed when the driver's JVM ends."""
    fs, path = _file_system(spark, folder)
    fs.deleteOnExit(path)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)
    fs.cancelDeleteOnExit(path)


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut in the lineage that outlives executors. The
    table goes when the driver's JVM ends."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.parquet(folder)
    remove_at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


class Scratch:
    """Written tables that go when the ``with`` block ends; what leaves the block must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        for folder in self.folders:
            remove(self.spark, folder)

    def folder(self) -> str:
        """A new path that goes with the block, whatever is written there."""
        self.folders.append(shared_folder(self.spark))
        return self.folders[-1]

    def written(self, df: DataFrame) -> DataFrame:
        return written(df, self.folder())
