"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        # Removed again when the Python process ends.
        _own_folder[app] = tempfile.TemporaryDirectory(prefix="baroflow-", ignore_cleanup_errors=True)
    return _own_folder[app].name


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result is read several times: the input is scanned once, each reader
    then prunes columns, and a lost executor costs nothing already written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
