"""An arbitrary Python function over rows, for what expressions can't say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .scan import fit


def map_rows(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str, keep: list[str] | None = None) -> DataFrame:
    """``fn`` of each row, in Arrow batches; a row for which it is None goes. ``keep`` names columns that ``fn`` doesn't
    see and that pass by it unchanged."""
    passed = keep or []
    made = T.StructType.fromDDL(schema)
    whole = T.StructType([*made.fields, *[df.schema[n] for n in passed]])
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in whole.fieldNames()}
            for row in batch.to_pylist():
                by = {n: row.pop(n) for n in passed}
                found = fn(row)
                if found is None:
                    continue
                for f in made.fields:
                    out[f.name].append(fit(found.get(f.name), f.dataType))
                for n in passed:
                    out[n].append(by[n])
            yield pa.RecordBatch.from_pydict(out, arrow)

    return df.mapInArrow(run, whole)
