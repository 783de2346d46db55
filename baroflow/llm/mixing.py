"""Temperature mixing of sources, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from baroflow.llm.common import few, fresh_name
from baroflow.plans.staging import stage

_ALL = (1 << 63) - 1
_PLAN = pa.schema(
    [("s", pa.string()), ("weight", pa.float64()), ("whole", pa.int32()), ("rest", pa.float64()), ("blocks", pa.int64())]
)


def weights(shares: dict, exponent: float) -> dict:
    """Normalised powers of the shares; a source without tokens keeps weight 0."""
    top = max(shares.values(), default=1.0) if exponent > 1 else 1.0  # so that not all powers vanish
    powers = {s: (p / top) ** exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(powers.values()) or 1.0
    return {s: v / total for s, v in powers.items()}


def entropy(w: dict) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def find_exponent(tokens: dict, budget: float, max_repetition: float | None, target_entropy: float | None) -> float:
    """The exponent, by bisection: the smallest (flattest) one at which no source is read more
    than ``max_repetition`` times, or the one at which the weights have the target entropy
    (which falls as the exponent grows, above 1 to less than that of the shares). A target
    that no exponent meets is an error."""
    total = sum(tokens.values()) or 1
    shares = {s: n / total for s, n in tokens.items()}
    if not any(tokens.values()):
        return 0.0
    if target_entropy is not None and entropy(weights(shares, 0.0)) < target_entropy - 1e-9:
        raise ValueError(f"no weights of these sources have an entropy of {target_entropy}")
    if target_entropy is None and budget > max_repetition * total * (1 + 1e-9):
        raise ValueError(f"{budget} tokens need more than {max_repetition} readings of {total}")

    def too_flat(exponent: float) -> bool:
        w = weights(shares, exponent)
        if target_entropy is not None:
            return entropy(w) > target_entropy + 1e-12
        return any(w[s] * budget > max_repetition * n for s, n in tokens.items() if n)

    if not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    while target_entropy is not None and too_flat(high):
        if high > 2.0**60:
            raise ValueError(f"no exponent gives an entropy of {target_entropy}")
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def _source(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\u0000"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: float | None = None,
    max_repetition: float | None = 1.25,
    target_entropy: float | None = None,
    block_rows: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """``docs`` in mixed proportions: a row for each time a document is read, with ``epoch``,
    ``block_order``, ``n_tokens`` and ``weight`` (clashing names get leading underscores).

    Tokens are words. A source's weight is its token share to a power, chosen by bisection;
    times ``budget`` (all tokens, unless given) it is the source's quota. A quota is read in
    whole epochs first. In the last epoch the source's blocks, of about ``block_rows``
    documents each, are taken in an order drawn by a hash until the quota is reached; in the
    block where that happens documents are taken in hash order, up to the one that reaches it.
    So decisions hang on a small table of blocks, one row for some thousand documents, and a
    source with a third of all rows is split over its blocks.

    Null is a source of its own; null and empty texts have no token and are kept as their
    hash falls; a source without any token has weight 0 and is left out. Rows that repeat an
    id and text share their fate. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n_col, s_col, h_col, b_col, e_col, o_col, w_col = fresh_name(
        docs, "n_tokens", "_source", "_hash", "_block", "epoch", "block_order", "weight"
    )
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    row_hash = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.withColumn(n_col, words).withColumn(s_col, _source(source_col)).withColumn(h_col, row_hash)
    sizes = stage(rows.select(F.col(s_col).alias("s"), F.col(h_col).alias("h"), F.col(n_col).alias("n")), "sizes")
    totals = sizes.groupBy("s").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).collect()
    tokens = {r["s"]: r["tokens"] for r in totals}
    spent = float(sum(tokens.values())) if budget is None else float(budget)
    exponent = find_exponent(tokens, spent, max_repetition, target_entropy)
    share = weights({s: n / (sum(tokens.values()) or 1) for s, n in tokens.items()}, exponent)
    plan = {"s": [], "weight": [], "whole": [], "rest": [], "blocks": []}
    for r in totals:
        times = share[r["s"]] * spent / r["tokens"] if r["tokens"] else 0.0
        whole = int(times + 1e-9)
        row = (r["s"], share[r["s"]], whole, max(0.0, (times - whole) * r["tokens"]), -(-r["rows"] // block_rows))
        for column, value in zip(plan.values(), row):
            column.append(value)
    # An Arrow table is read without Python; from a list of rows, every executor would start workers of another kind.
    sources = few(spark.createDataFrame(pa.table(plan, schema=_PLAN)), 200_000)
    drawn = (
        sizes.join(sources, "s")
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.col("blocks")))
    )
    order = [F.xxhash64(F.lit(seed + 2), "s", "block"), F.col("block")]
    before = F.sum("n").over(Window.partitionBy("s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    blocks = (
        drawn.groupBy("s", "block", "rest").agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .withColumn("block_order", F.row_number().over(Window.partitionBy("s").orderBy(*order)))
    )
    partly = blocks.where("before < rest and before + n > rest").select("s", "block", "before")
    inside = F.sum("n").over(Window.partitionBy("s", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    cuts = (
        drawn.join(partly, ["s", "block"])
        .withColumn("sum", F.col("before") + F.coalesce(inside, F.lit(0)))
        .where("sum < rest")
        .groupBy("s", "block").agg(F.max("h").alias("cut"))
    )
    decided = blocks.join(cuts, ["s", "block"], "left").select(
        F.col("s"), F.col("block"), "block_order",
        F.when(F.col("before") + F.col("n") <= F.col("rest"), F.lit(_ALL)).otherwise(F.col("cut")).alias("cut"),
    ).join(sources.select("s", "weight", "whole", "blocks"), "s")
    decided = few(decided, 200_000)
    own = rows.join(sources.select(F.col("s").alias(s_col), F.col("blocks").alias(b_col)), s_col)
    own = own.withColumn(b_col, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h_col)), F.col(b_col)))
    joined = own.join(decided, (own[s_col] == decided["s"]) & (own[b_col] == decided["block"]))
    times = decided["whole"] + F.coalesce(own[h_col] <= decided["cut"], F.lit(False)).cast("int")
    return joined.where(times > 0).select(
        *[docs[c] for c in docs.columns],
        F.explode(F.sequence(F.lit(0), times - 1)).alias(e_col),
        decided["block_order"].alias(o_col),
        own[n_col],
        decided["weight"].alias(w_col),
    )
