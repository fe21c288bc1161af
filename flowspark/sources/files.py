"""Readers and writers of rows: NDJSON, CSV, Parquet, and golden files."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CompileError, ExpectationFailed
from ..lang.durations import parse_duration

FORMATS = ("json", "csv", "parquet")


def read_rows(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    kind = kind or {"csv": "csv", "parquet": "parquet"}.get(path.rstrip("/").rsplit(".", 1)[-1], "json")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", not schema).csv(path)
    return reader.parquet(path) if kind == "parquet" else reader.json(path)


def as_json(df: DataFrame) -> DataFrame:
    """One column ``value``, a JSON text per row; nulls are written."""
    return df.select(F.to_json(F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def write_rows(df: DataFrame, path: str, options: dict[str, Any] | None = None, rel: Any = None) -> None:
    """Writes rows in the order of ``rel``, if it has one. Options: ``mode`` append or overwrite, ``format`` json, csv or
    parquet, ``single_file`` for one local NDJSON file in exact order, with ``buffer_size_mb`` and ``fsync_every`` for
    that file, ``partition_by`` a column."""
    options = {"mode": "append", "format": "json"} | (options or {})
    if options["mode"] not in ("append", "overwrite"):
        raise CompileError("mode is append or overwrite")
    if options["format"] not in FORMATS:
        raise CompileError(f"format is one of {', '.join(FORMATS)}")
    if options.get("fsync_every") is not None:
        parse_duration(str(options["fsync_every"]))
    if options.get("single_file"):
        return write_one_file(rel.result(sort=True) if rel else df, path, options)
    writer = df.write.mode(options["mode"])
    if options.get("partition_by"):
        writer = writer.partitionBy(options["partition_by"])
    if options["format"] == "csv":
        writer.option("header", bool(options.get("headers", True))).csv(path)
    elif options["format"] == "parquet":
        writer.parquet(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def write_one_file(df: DataFrame, path: str, options: dict[str, Any]) -> None:
    """One NDJSON file through the driver, row by row in order, a partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    size = int(float(options.get("buffer_size_mb", 1.0)) * 1_000_000)
    with open(path, "w" if options["mode"] == "overwrite" else "a", buffering=max(size, 4096), encoding="utf-8") as f:
        for row in as_json(df).toLocalIterator():
            f.write(row.value + "\n")
        f.flush()
        os.fsync(f.fileno())


def canonical(value: Any) -> Any:
    """Keys sorted, nulls left out: missing and null aren't told apart in typed rows. Doubles count to 14 digits."""
    if isinstance(value, dict):
        return {k: canonical(v) for k, v in sorted(value.items()) if v is not None}
    if isinstance(value, list):
        return [canonical(v) for v in value]
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else float(f"{value:.14g}")
    return value


def assert_or_save(rel: Any, path: str) -> None:
    """Compares the rows, in order, with the file's, or writes the file if there is none. For tests: the rows come to
    the driver."""
    got = [canonical(json.loads(r.value)) for r in as_json(rel.result(sort=True)).toLocalIterator()]
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in got)
        return
    with open(path, encoding="utf-8") as f:
        want = [canonical(json.loads(line)) for line in f if line.strip()]
    for i, (g, w) in enumerate(zip(got, want, strict=False)):
        if g != w:
            raise ExpectationFailed(f"row {i + 1} of {path}: {g} instead of {w}")
    if len(got) != len(want):
        raise ExpectationFailed(f"{path}: {len(got)} rows instead of {len(want)}")
