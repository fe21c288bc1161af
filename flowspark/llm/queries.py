"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_streaming_bpe
from .licenses import OP5_SQL, op5_license_sentences
from .minhash import op3_weighted_minhash
from .mixing import OP6_SQL, op6_poisson_mix
from .quality import op4_robust_outliers
from .quality_sql import OP4_SQL
from .slots import op2_virtual_slots
from .topk import OP9_SQL, op9_exact_top_k
from .urls import OP8_SQL, op8_url_expressions
from .warc import op1_warc_transactions
from .weak_labels import op10_weak_label_quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_transactions": op1_warc_transactions,
    "op2_virtual_slots": op2_virtual_slots,
    "op3_weighted_minhash": op3_weighted_minhash,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_license_sentences": op5_license_sentences,
    "op6_poisson_mix": op6_poisson_mix,
    "op7_streaming_bpe": op7_streaming_bpe,
    "op8_url_expressions": op8_url_expressions,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_weak_label_quality": op10_weak_label_quality,
}

ORACLE_SQL: dict[str, str] = {"op4_robust_outliers": OP4_SQL, "op5_license_sentences": OP5_SQL, "op6_poisson_mix": OP6_SQL, "op8_url_expressions": OP8_SQL, "op9_exact_top_k": OP9_SQL}
