"""Exact top-k by inner product: term-at-a-time accumulation over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from baroflow.llm.common import parts_for

_LEAST = np.iinfo(np.int64).min
_PARTIAL = "query_id long, vec_id long, score long, slice int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as float64, short rows filled up with zeros."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the smaller id: partition, then sort what is left."""
    n, m = scores.shape
    cut = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(n, _LEAST)
    row, col = np.nonzero(scores >= cut[:, None])
    value, name = scores[row, col], ids[row, col]
    order = np.lexsort((name, ~value, row))  # ~ reverses the order and cannot overflow
    row, value, name = row[order], value[order], name[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    out = np.full((n, k), _LEAST), np.zeros((n, k), np.int64)
    out[0][row[keep], rank[keep]] = value[keep]
    out[1][row[keep], rank[keep]] = name[keep]
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores, one term after the other: each query weight scatters over the term's postings."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        asked = np.flatnonzero(queries[:, term])
        postings = np.flatnonzero(candidates[:, term])
        weights = candidates[postings, term]
        if len(postings) == len(candidates):
            for q in asked:
                scores[q] += queries[q, term] * weights
        else:
            for q in asked:
                scores[q, postings] += queries[q, term] * weights
    return scores


def _searcher(k: int, cells: int):
    """Best ``k`` candidates of a slice for each query of a block, candidates in steps of bounded score arrays."""

    def search(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        query_ids = asked.column("id").to_numpy().astype(np.int64)
        weights = _matrix(asked.column("v").combine_chunks()).astype(np.int64)
        best = np.full((len(query_ids), k), _LEAST), np.zeros((len(query_ids), k), np.int64)
        step = max(64, cells // max(1, len(query_ids)))
        for at in range(0, rows.num_rows if len(query_ids) else 0, step):
            piece = rows.slice(at, step)
            ids = piece.column("id").to_numpy().astype(np.int64)
            scores = accumulate(weights, _matrix(piece.column("v").combine_chunks()).astype(np.int64))
            scores[query_ids[:, None] == ids[None, :]] = _LEAST
            best = _best(
                np.hstack([best[0], scores]), np.hstack([best[1], np.broadcast_to(ids, scores.shape)]), k
            )
        row, col = np.nonzero(best[0] != _LEAST)
        return pa.table(
            {
                "query_id": query_ids[row],
                "vec_id": best[1][row, col],
                "score": best[0][row, col],
                "slice": np.full(len(row), key[1].as_py(), np.int32),
            }
        )

    return search


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_chunk: int = 32_768,
    slice_rows: int = 65_536,
    cells: int = 1 << 22,
) -> DataFrame:
    """Each query's ``k`` highest integer inner products over all other rows, ties to the smaller id.

    A component x counts as floor(scale * x). Null vectors, vectors with a null or non-finite
    component and rows with a null id take no part, neither as query nor as candidate; an
    empty vector scores 0, a shorter one counts as filled up with zeros. A row with a query's
    own id is not its candidate. Queries that repeat an id count once; candidates that repeat
    an id each take a rank. Returns ``query_id, rank, vec_id, score``.

    Queries are packed into blocks of about ``query_chunk``, candidates into slices of about
    ``slice_rows`` (smaller while there are fewer slices than cores), and each block meets each
    slice in one task; no vector visits the driver. A task holds one block, one slice and score
    arrays of ``cells`` entries, and hands on ``k`` rows a query. Rows that repeat an id are
    spread by the partition they are read in, so that they do not share one slice.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.where(
        F.col(id_col).isNotNull()
        & F.col(vector_col).isNotNull()
        & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")).alias("v"),
    )
    asked = usable(queries).dropDuplicates(["id"])
    rows = usable(vectors)
    blocks = parts_for(asked.count(), query_chunk)
    # Rows that take no part only make the slices smaller.
    slices = max(parts_for(vectors.count(), slice_rows), spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    salt = F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.lit(slices)).cast("int")
    asked = asked.select("id", "v", block.alias("block"), every(slices).alias("slice"))
    rows = rows.withColumn("slice", salt).select("id", "v", every(blocks).alias("block"), "slice")
    cell = ["block", "slice"]
    found = asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(_searcher(k, cells), _PARTIAL)
    order = [F.col("score").desc(), F.col("vec_id")]
    # Merge in two steps, so that a query with parts from very many slices is not one task's work.
    found = found.withColumn("part", F.col("slice") % 64)
    near = Window.partitionBy("query_id", "part").orderBy(*order)
    all_of = Window.partitionBy("query_id").orderBy(*order)
    return (
        found.withColumn("rank", F.row_number().over(near))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(all_of))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
