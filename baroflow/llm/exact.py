"""Exact deduplication by a tree-merge of sorted digest runs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.llm.common import few
from baroflow.plans.staging import stage

#: Fixed value of the rule: characters that do not count.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
_KEY = ["text_sha256", "_check"]


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document, sorted by digest within its run; a run is an input partition.

    The rows are written once, so that texts are read and hashed once and a run's number
    is fixed from then on.
    """
    norm = without_space(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_len"),
        norm.alias("_norm"),
    ).select(
        "_id",
        "_len",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
        F.struct(F.octet_length("_norm").alias("n"), F.xxhash64("_norm").alias("x")).alias("_check"),
        F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return stage(rows.sortWithinPartitions(*_KEY), "digest-runs")


def merge_runs(runs: DataFrame, fan_in: int = 16) -> DataFrame:
    """Merge runs in rounds: run r goes to the run that has r's lowest base-``fan_in`` digit zero.

    Each round is one sorted exchange of one row per run and digest. The best row and the
    count of every digest are kept at each level; digests merge only if an independent
    hash and the length agree as well. Copies within one run meet before any exchange, so
    a text that makes up a third of all rows sends one row per run.
    """
    n = (runs.agg(F.max("_run").alias("n")).first()["n"] or 0) + 1
    best = F.struct(
        (-F.col("_len")).alias("len"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row")
    )
    level = runs.select("_run", *_KEY, best.alias("_best"), F.lit(1).cast("long").alias("group_size"))
    span = 1
    while True:
        span *= fan_in
        level = level.groupBy((F.col("_run") - F.col("_run") % span).alias("_run"), *_KEY).agg(
            F.min("_best").alias("_best"), F.sum("group_size").alias("group_size")
        )
        if span >= n:
            return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """For every row: the row that stays of those with equal text, and the size of that group.

    Texts are equal when identical without white space; null counts as empty, so null, empty
    and blank texts are one group. The longest original stays, then the smallest id (a null
    id last), then, among rows that repeat an id, the first read. Returns ``id_col``,
    ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; an empty table gives no rows.
    """
    runs = digest_runs(docs, id_col, text_col)
    roots = merge_runs(runs, fan_in).drop("_run")
    return runs.join(roots, _KEY).select(
        F.col("_id").alias(id_col),
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; all columns stay.

    Rows that repeat an id stay together if one of them stays.
    """
    rows = exact_dedup(docs, id_col, text_col).groupBy(F.col(id_col).alias("_gone_id")).agg(F.bool_or("kept").alias("any"))
    gone = few(stage(rows.where("not any").select("_gone_id"), "gone"), 1_000_000)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]), "left_anti")
