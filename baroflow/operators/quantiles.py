"""Exact quantiles (linear interpolation between order statistics), group size unbounded.

A group is never gathered in one task.  Equal values are counted first; counts per value
bin give the rank range of every bin; only the bins that hold a wanted rank are split again
into finer bins, and of those the ones that hold it are ranked value by value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Binary digits after the leading one that a bin keeps: first of all values, then of those in a wanted bin.
BIN_BITS = (8, 22)


def order_bin(v: Column, bits: int) -> Column:
    """Monotone bin of a finite double: exponent and leading digits, so that every size of values
    is split alike; depends on the value alone."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    # A logarithm rounded across a power of two gives the same bin: the fraction is then below 1 or 2.
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * float(1 << bits))
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(
        (F.signum(v) * ((exponent + 1100) * (1 << bits) + fraction)).cast("long")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; key columns come from ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )


def _place(bins: DataFrame, path: Sequence[str], name: str, tails: bool) -> DataFrame:
    """Per bin, the rows of its group before it (``_below``) and, for ``tails``, number and sum of those after it."""
    before = Window.partitionBy(*path).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    # Ordered the other way round, as a frame that begins at the row is added up anew for each row.
    after = Window.partitionBy(*path).orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, -1)
    out = bins.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    if tails:
        out = out.withColumns(
            {
                "_over_n": F.col("_over_n") + F.coalesce(F.sum("_bn").over(after), F.lit(0)),
                "_over_s": F.col("_over_s") + F.coalesce(F.sum("_bs").over(after), F.lit(0.0)),
            }
        )
    return out


def _wanted(bins: DataFrame) -> DataFrame:
    """Bins that hold a wanted rank, with those ranks alone."""
    end = F.col("_below") + F.col("_bn")
    held = F.filter("_ranks", lambda r: (r["pos"] >= F.col("_below")) & (r["pos"] < end))
    return bins.withColumn("_ranks", held).where(F.size("_ranks") > 0)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    probs: Sequence[float],
    names: Sequence[str],
    spread: Callable[[DataFrame], DataFrame] | None = None,
    tails: bool = False,
) -> DataFrame:
    """One row per group with a column per probability, from ``value_counts`` rows.

    ``spread`` copies rows to further groups by changing ``keys`` (a row may also reach groups
    that have no rows of their own); it is applied to the counts per value bin. Values follow
    only into the bins that hold a wanted rank of a group they reach. ``tails`` adds the group's
    ``_total`` and, for the i-th probability, number ``_n{i}`` and sum ``_s{i}`` of the values
    strictly above the quantile.
    """
    keys = list(keys)
    at = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(hi).alias("hi"), (F.ceil(h) if hi else F.floor(h)).cast("long").alias("pos"))
            for i, h in enumerate(at)
            for hi in (False, True)
        ]
    )
    weigh = [F.sum("_n").alias("_bn"), F.sum(F.col("_v") * F.col("_n")).alias("_bs")]
    carried = ["_total", "_below", "_over_n", "_over_s"]
    # Coarse bins, of all groups.
    coarse = counts.withColumn("_bin0", order_bin(F.col("_v"), BIN_BITS[0]))
    bins = coarse.groupBy(*keys, "_bin0").agg(*weigh)
    own = [f"_own_{k}" for k in keys] if spread else keys
    if spread:
        reached = spread(bins.withColumns({o: F.col(k) for o, k in zip(own, keys)}))
        bins = reached.groupBy(*keys, "_bin0").agg(
            F.sum("_bn").alias("_bn"), F.sum("_bs").alias("_bs"), F.collect_list(F.struct(*own)).alias("_from")
        )
    bins = bins.withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
    bins = bins.withColumns({"_ranks": ranks, "_below": F.lit(0), "_over_n": F.lit(0), "_over_s": F.lit(0.0)})
    wanted = _wanted(_place(bins, keys, "_bin0", tails))
    # Values of the wanted bins, under the group that wants them.
    path = [*keys, "_bin0"]
    if spread:
        wanted = wanted.withColumn("_from", F.explode("_from")).select(
            *path, *[F.col(f"_from.{o}").alias(o) for o in own], "_ranks", *carried
        )
        coarse = coarse.withColumnsRenamed(dict(zip(keys, own)))
        inside = join_null_safe(coarse, wanted, [*own, "_bin0"])
        if tails:  # Equal values of several sources are one value of the tail, or none.
            inside = inside.groupBy(*path, "_v").agg(
                F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_ranks", *carried)]
            )
    else:
        inside = join_null_safe(coarse, wanted.select(*path, "_ranks", *carried), path)
    # Fine bins inside the wanted ones.
    inside = inside.withColumn("_bin1", order_bin(F.col("_v"), BIN_BITS[1]))
    fine = inside.groupBy(*path, "_bin1").agg(*weigh, *[F.first(c).alias(c) for c in ("_ranks", *carried)])
    wanted = _wanted(_place(fine, path, "_bin1", tails))
    path = [*path, "_bin1"]
    inside = join_null_safe(inside.select(*path, "_v", "_n"), wanted.select(*path, "_ranks", *carried), path)
    # Values of the wanted fine bins, one by one.
    inside = inside.withColumns({"_bn": F.col("_n"), "_bs": F.col("_v") * F.col("_n")})
    hits = _wanted(_place(inside, path, "_v", tails)).withColumn("_hit", F.explode("_ranks"))
    hit = lambda i, hi, c: F.max(F.when((F.col("_hit.i") == i) & (F.col("_hit.hi") == hi), F.col(c)))
    n = range(len(probs))
    over = [hit(i, True, c).alias(f"{c}{i}") for c in ("_over_n", "_over_s", "_bn", "_bs") for i in n] if tails else []
    out = hits.groupBy(*keys).agg(
        F.max("_total").alias("_total"), *[hit(i, hi, "_v").alias(f"_{i}_{int(hi)}") for i in n for hi in (False, True)], *over
    )
    cols = []
    for i, (h, name) in enumerate(zip(at, names)):
        lo, hi = F.col(f"_{i}_0"), F.col(f"_{i}_1")
        quantile = lo + (hi - lo) * (h - F.floor(h))
        cols.append(quantile.alias(name))
        if tails:
            # No value lies between the two order statistics, so the upper one is in the tail or bounds it.
            above = lambda c: F.col(f"_over{c}{i}") + F.when(hi > quantile, F.col(f"_b{c[1:]}{i}")).otherwise(0)  # noqa: B023, E731
            cols += [above("_n").alias(f"_n{i}"), above("_s").alias(f"_s{i}")]
    return out.select(*keys, *cols, *(["_total"] if tails else []))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs, names, spread)


def tail_means(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    empty: str = "null",
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Mean of the values strictly above each group quantile.

    ``empty='null'`` averages those values only (NULL if there are none); ``'zero'``
    averages over the whole group with the other values counted as zero. ``spread`` as in
    ``quantiles_of_counts``.
    """
    if empty not in ("null", "zero"):
        raise ValueError(f"unknown mode {empty!r}")
    keys = list(keys)
    marks = [f"_q{i}" for i in range(len(probs))]
    tails = quantiles_of_counts(value_counts(df, keys, value), keys, probs, marks, spread, tails=True)
    means = []
    for i, name in enumerate(names):
        n, total = F.col(f"_n{i}"), F.col(f"_s{i}")
        means.append((F.when(n > 0, total / n) if empty == "null" else total / F.col("_total")).alias(name))
    return tails.select(*keys, *means)


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, group size and number of outliers."""
    keys = list(keys)
    counts = value_counts(df, keys, value)
    quart = quantiles_of_counts(counts, keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    both = join_null_safe(counts, quart, keys)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("_v") >= F.col("q1") - reach) & (F.col("_v") <= F.col("q3") + reach)
    return both.groupBy(*keys).agg(
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.sum("_n").alias("n"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
    )
