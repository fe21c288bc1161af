"""Exact top-k search by exhaustive term-at-a-time accumulation.

A block of candidates is stored as postings, one weight array per term. A block of queries is scored against it term
by term: each query that has the term scatters its weight times the term's postings into its own dense score array.
Partition selection takes each query's best of a block, and a merge over blocks the best of all.

Blocks lie on a grid: queries in bands, candidates in columns, each of GROUP_BYTES at most, and a cell scores a band
against a column block by block. So candidates are sent once for each band and queries once for each column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, table, written

#: Vectors in a block of queries and of candidates, which bound the score arrays.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Bytes of weights in a band of queries and in a column of candidates.
GROUP_BYTES = 32 << 20


def _sparse(ids: np.ndarray, vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero weights, ordered by term."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    weights = np.concatenate(vectors) if len(vectors) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(ids)), sizes)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((rows, terms))
    order = order[weights[order] != 0]
    return rows[order], terms[order], weights[order]


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Score arrays (queries by candidates) of the integer inner products, built up term by term."""
    q_rows, q_terms, q_weights = _sparse(np.arange(len(queries)), queries)
    c_rows, c_terms, c_weights = _sparse(np.arange(len(candidates)), candidates)
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in np.intersect1d(q_terms, c_terms):
        q = slice(*np.searchsorted(q_terms, [term, term + 1]))
        c = slice(*np.searchsorted(c_terms, [term, term + 1]))
        postings, weights = c_rows[c], c_weights[c]
        if len(postings) == len(candidates):  # a dense posting list needs no scatter
            for row, weight in zip(q_rows[q], q_weights[q], strict=True):
                scores[row] += weight * weights
        else:
            for row, weight in zip(q_rows[q], q_weights[q], strict=True):
                scores[row, postings] += weight * weights
    return scores


def best_of_block(query_ids: np.ndarray, candidate_ids: np.ndarray, scores: np.ndarray, k: int):
    """(query id, candidate id, score) of each query's k best, ties to the smaller id; a query's own id is no candidate."""
    for i, own in enumerate(query_ids):
        row, ids = scores[i], candidate_ids
        if (mine := ids == own).any():
            row, ids = row[~mine], ids[~mine]
        if len(ids) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= least)
        else:
            at = np.arange(len(ids))
        at = at[np.lexsort((ids[at], -row[at]))][:k]
        yield np.full(len(at), own), ids[at], row[at]


PACKED = "block long, ids binary, vectors binary, weights binary, bytes_each int, sizes binary"


def _pack(t: pa.Table) -> pa.Table:
    """A block as one row; weights in the fewest bytes that hold them all."""
    lists = t.column("__w").combine_chunks()
    weights = np.asarray(lists.flatten()).astype(np.int64)
    kind = next(k for k in (np.int16, np.int32, np.int64) if not len(weights) or (np.iinfo(k).min <= weights.min() and weights.max() <= np.iinfo(k).max))
    as_bytes = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.table(
        {
            "block": t.column("__block")[:1].cast(pa.int64()), "ids": as_bytes(np.asarray(t.column("__id")).astype(np.int64)), "vectors": as_bytes(np.asarray(t.column("__v")).astype(np.int64)),
            "weights": as_bytes(weights.astype(kind)), "bytes_each": pa.array([np.dtype(kind).itemsize], pa.int32()), "sizes": as_bytes(np.asarray(pc.list_value_length(lists)).astype(np.int32)),
        }
    )


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    flat = np.frombuffer(row["weights"], f"<i{row['bytes_each']}").astype(np.int64)
    cuts = np.cumsum(np.frombuffer(row["sizes"], np.int32))[:-1]
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64), np.split(flat, cuts)


def _score_cell(k: int):
    def score(cell: pa.Table) -> pa.Table:
        rows = cell.sort_by([("side", "ascending"), ("block", "ascending")]).to_pylist()
        columns = [_unpack(r) for r in rows if r["side"] == "c"]
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for row in rows:
            if row["side"] == "c":
                continue
            q_ids, q_vectors, queries = _unpack(row)
            best: list[list] = [[] for _ in q_ids]
            for c_ids, _, candidates in columns:
                scores = accumulate(queries, candidates)
                for held, found in zip(best, best_of_block(q_ids, c_ids, scores, k), strict=True):
                    held.append(found[1:])
            for own, vector, held in zip(q_ids, q_vectors, best, strict=True):
                if not held:
                    continue
                ids, scored = (np.concatenate(x) for x in zip(*held, strict=True))
                at = np.lexsort((ids, -scored))[:k]
                for out, x in zip(parts, (np.full(len(at), own), np.full(len(at), vector), ids[at], scored[at]), strict=True):
                    out.append(x)
        made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts]
        return pa.table([pa.array(x, pa.int64()) for x in made], ["query_id", "__v", "vec_id", "score"])

    return score


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024) -> DataFrame:
    """The ``k`` candidates of largest integer inner product for each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)`` as long integers, and sums must fit in 63 bits. Vectors of unequal length
    are compared on the terms they share. Ties go to the smaller id. Candidates with the query's id are its own and
    left out.

    Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part. Every candidate
    row counts, a repeated one as often as it comes. A repeated query row (same id, same vector) is answered once;
    query rows of one id with different vectors are answered each. Fewer than ``k`` candidates are all returned; an
    empty vector scores 0. Only the two named columns are read, so others can't clash. Empty tables give an empty result.
    """
    spark = candidates.sparkSession

    def integers(df: DataFrame) -> DataFrame:
        v = F.col(vector)
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
        return df.filter(F.col(id_col).isNotNull() & v.isNotNull() & good).select(F.col(id_col).cast("long").alias("__id"), whole.alias("__w"))

    with Scratch(spark) as scratch:

        def blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int, int]:
            """Packed blocks, their number and the bytes that they hold."""
            rows = scratch.written(rows.withColumn("__v", F.xxhash64("__w")))
            counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("__w")).alias("terms")).first()
            n = max(1, -(-counts.n // size))
            # Copies of a row lie in several blocks: their place is told by where they are read.
            keyed = rows.withColumn("__block", F.pmod(F.xxhash64("__id", F.monotonically_increasing_id()), F.lit(n)).cast("long"))
            packed = scratch.written(keyed.groupBy("__block").applyInArrow(_pack, PACKED))
            return packed, n, 2 * (counts.terms or 0)

        q, n_q, q_bytes = blocks(integers(queries).distinct(), QUERY_BLOCK)
        c, n_c, c_bytes = blocks(integers(candidates), CANDIDATE_BLOCK)
        bands = min(n_q, -(-q_bytes // GROUP_BYTES) or 1)
        # As many columns as their bytes need, or as keep all tasks busy.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        columns = min(n_c, max(-(-c_bytes // GROUP_BYTES), -(-tasks // bands), 1))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = q.withColumn("side", F.lit("q")).withColumn("band", F.pmod("block", F.lit(bands)).cast("int")).withColumn("column", every(columns))
        c = c.withColumn("side", F.lit("c")).withColumn("column", F.pmod("block", F.lit(columns)).cast("int")).withColumn("band", every(bands))
        partial = q.unionByName(c).groupBy("band", "column").applyInArrow(_score_cell(k), "query_id long, __v long, vec_id long, score long")
        w = Window.partitionBy("query_id", "__v").orderBy(F.desc("score"), "vec_id")
        ranked = partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return written(ranked.select("query_id", "rank", "vec_id", "score"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, 10)


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT row_number() OVER () AS n, * FROM (SELECT DISTINCT vec_id AS query_id, w FROM v WHERE vec_id % 100 = 0)),
q AS (SELECT n, query_id, unnest(w) AS x, generate_subscripts(w, 1) AS term FROM asked),
c AS (SELECT r, vec_id, unnest(w) AS y, generate_subscripts(w, 1) AS term FROM v),
s AS (SELECT n, query_id, r, vec_id, CAST(sum(x * y) AS BIGINT) AS score FROM q JOIN c USING (term) WHERE query_id <> vec_id GROUP BY ALL),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 10
"""
