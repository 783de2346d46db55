"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """``crc32`` of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column; one pass, one row back."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(total: int, each: int) -> int:
    """How many parts of about ``each`` make ``total``."""
    return max(1, -(-total // each))


def fresh_name(df: DataFrame, *names: str) -> list[str]:
    """Working column names that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast ``df`` only where its counted rows stay under ``limit``; else let Spark shuffle."""
    return F.broadcast(df) if df.count() <= limit else df
