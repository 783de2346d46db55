"""A training corpus from raw documents: quality, copies, near copies, source weights, tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baroflow.llm.bpe import bpe
from baroflow.llm.exact import drop_exact_copies
from baroflow.llm.jaccard import keep_one_of_each
from baroflow.llm.mixing import mix
from baroflow.llm.quality import keep_good
from baroflow.llm.queries import table, vocabulary_path
from baroflow.plans.staging import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are scored too, null ids stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text stays; null and empty texts are one group, rows that repeat an id share their fate."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similar shingle sets stays; documents without words are linked with nothing and stay."""
    return keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their mixed weights: a row for each time a document is read; a null source is one of its own."""
    return mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, and whether they decode to the text; null is empty. No rows give none, in every stage."""
    coded = bpe(docs, vocabulary_path())
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: No SQL can express the classifier or the codec; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each one's result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
