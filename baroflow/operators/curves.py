"""Smooth curves with confidence bands, one or many groups in one plan.

Rows are first added up per group and value of ``x``, which combines on the map side. Only
pairs of such values with evaluation points are formed after that, in the JVM, and at once
added up again; what Python gets is one row of sums per evaluation point or group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.plans.staging import stage

_BINS, _SUB_BINS = 512, 65536  # together they pin a radius down to 3e-8 of the range, or exactly
_VALUES_PER_PART = 100_000


def t_quantile(level: float, df: Column) -> Column:
    """Two-sided Student quantile by the expansion around the normal one; good to 1e-3 from 3 degrees on."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    out = F.lit(z)
    for power, term in enumerate(terms, 1):
        out = out + F.lit(term) / F.pow(df, F.lit(float(power)))
    return out


def _values(points: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``k, x, n, sy, syy`` per group and different ``x``; rows without ``x`` or ``y`` do not count."""
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("one"))
    known = points.select(key.alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    return stage(
        known.groupBy("k", (F.col("x") + 0.0).alias("x")).agg(
            F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")
        ),
        "values",
    )


def _ungrouped(df: DataFrame, by: Sequence[str], *columns: Column) -> DataFrame:
    return df.select(*[F.col("k")[c].alias(c) for c in by], *columns)


def _grid(ends: DataFrame, count: int) -> DataFrame:
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / max(count - 1, 1)
    return ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("at", at)


def _local_sums(values: DataFrame, at: DataFrame, span: float, degree: int) -> DataFrame:
    """Tricube-weighted sums around each point of ``at`` (``k, e, at, lo, hi, total``).

    Both sides meet on the group and a salt, so that one group's values are as many tasks'
    work as they fill. The radius is the distance of the ``floor(span * n)``-th nearest row:
    a first pass counts rows in bins of distance, a second one splits the bin in which it lies.
    """
    salts = max(1, -(-values.count() // _VALUES_PER_PART))
    salted = values.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(salts)))
    points = at.select("k", "e", "at", "total", F.greatest(F.col("at") - F.col("lo"), F.col("hi") - F.col("at")).alias("far"))
    points = points.withColumn("need", F.greatest(F.lit(1), F.floor(F.col("total") * min(span, 1.0) + 1e-9)))

    def pairs(eval_points: DataFrame) -> DataFrame:
        copies = eval_points.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return salted.join(copies, ["k", "salt"]).withColumn("d", F.abs(F.col("x") - F.col("at")))

    place = F.col("d") / F.nullif(F.col("far"), F.lit(0.0)) * _BINS
    bin_no = F.coalesce(F.least(F.floor(place), F.lit(_BINS - 1)), F.lit(0))
    upto = Window.partitionBy("k", "e").orderBy("bin")
    coarse = pairs(points).groupBy("k", "e", bin_no.alias("bin")).agg(F.sum("n").alias("n")).withColumn("cum", F.sum("n").over(upto))
    named = coarse.join(points, ["k", "e"]).where("cum >= need").groupBy("k", "e", "at", "far", "need").agg(
        F.min(F.struct("bin", (F.col("cum") - F.col("n")).alias("below"))).alias("b")
    )
    found = stage(named.select("k", "e", "at", "far", "need", "b.bin", "b.below"), "radius-bins")
    within = pairs(found).where(bin_no == F.col("bin"))
    fine = within.groupBy("k", "e", "at", "need", "below", F.coalesce(F.floor((place - F.col("bin")) * _SUB_BINS), F.lit(0)).alias("sub")).agg(
        F.sum("n").alias("n"), F.max("d").alias("d")
    )
    fine = fine.withColumn("cum", F.col("below") + F.sum("n").over(Window.partitionBy("k", "e").orderBy("sub")))
    radius = F.min(F.struct("sub", "d"))["d"] * max(span, 1.0)
    radii = stage(fine.where("cum >= need").groupBy("k", "e", "at").agg(radius.alias("r")), "radii")
    r = F.col("r")
    near = pairs(radii).where((F.col("d") < r) | (F.col("d") == 0))
    cube = F.coalesce(F.pow(F.col("d") / F.nullif(r, F.lit(0.0)), F.lit(3.0)), F.lit(0.0))
    w = F.pow(1 - cube, F.lit(3.0))
    u = F.coalesce((F.col("x") - F.col("at")) / F.nullif(r, F.lit(0.0)), F.lit(0.0))
    near = near.select("k", "e", "at", "r", "n", "sy", w.alias("w"), u.alias("u"))
    power = [F.lit(1.0)]
    for _ in range(2 * degree):
        power.append(power[-1] * F.col("u"))
    n, w = F.col("n"), F.col("w")
    sums = [F.sum(n * w * p).alias(f"s{j}") for j, p in enumerate(power)]
    sums += [F.sum(n * w * w * p).alias(f"v{j}") for j, p in enumerate(power)]
    sums += [F.sum(F.col("sy") * w * p).alias(f"t{j}") for j, p in enumerate(power[: degree + 1])]
    return near.groupBy("k", "e", "at", "r").agg(*sums)


def _local_fits(sums: DataFrame, degree: int) -> DataFrame:
    """``e, at`` and the fit there, its slope, the squared norm of its operator row, and one row's own weight."""
    m = degree + 1
    place = np.add.outer(np.arange(m), np.arange(m))
    key = sums.schema["k"].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, v = (pdf[[f"{c}{j}" for j in range(2 * degree + 1)]].to_numpy()[:, place] for c in "sv")
            row = np.linalg.pinv(s, rcond=1e-12, hermitian=True)[:, :2]  # of value and slope
            fit = np.einsum("gij,gj->gi", row, pdf[[f"t{j}" for j in range(m)]].to_numpy())
            value = row[:, 0]
            r = pdf["r"].to_numpy()
            yield pd.DataFrame(
                {
                    "key": pdf["key"], "e": pdf["e"], "at": pdf["at"], "fit": fit[:, 0],
                    "slope": np.where(r > 0, fit[:, 1] / np.where(r > 0, r, 1), 0.0) if m > 1 else 0.0,
                    "norm": np.einsum("gi,gij,gj->g", value, v, value), "own": value[:, 0],
                }
            )

    flat = sums.withColumn("key", F.to_json(F.struct("k"), {"ignoreNullFields": "false"})).drop("k")
    out = flat.mapInPandas(solve, "key string, e long, at double, fit double, slope double, norm double, own double")
    return out.withColumn("k", F.from_json("key", f"k {key}")["k"]).drop("key")


def local_curves(
    points: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    span: float = 0.75,
    degree: int = 2,
    count: int = 80,
    band: float | None = None,
    positions: int = 1024,
) -> DataFrame:
    """Locally weighted polynomials at ``count`` even positions over each group's range of ``x``.

    Returns ``by, x, fit``, with ``se, low, high`` if ``band`` gives a confidence level. The
    standard error is the residual deviation times the norm of the operator row. Residuals,
    trace and norm of the operator come from fits at the values of ``x`` themselves, or, where
    a group has over ``positions`` of them, at that many even positions, from which a value's
    fit is taken along the slope; degrees of freedom are ``n - 2 tr L + tr L L'``.

    Rows without ``x`` or ``y`` do not count; a null group is a group; a group with one value
    of ``x`` is flat; where no degrees of freedom are left, ``se`` is null. An empty table
    has no rows. No group is gathered in one task.
    """
    values = _values(points, x, y, by)
    ends = values.groupBy("k").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"), F.count("*").alias("different")
    )
    at = _grid(ends, count).withColumn("e", F.col("i").cast("long"))
    columns = ["k", "e", "at", "lo", "hi", "total"]
    step = (F.col("hi") - F.col("lo")) / positions
    lattice = F.round((F.col("x") - F.col("lo")) / F.nullif(step, F.lit(0.0))).cast("long")
    placed = values.join(ends, "k").select(
        "k", "x", "n", "sy", "syy", "lo", "hi", "total", step.alias("step"),
        F.when(F.col("different") > positions, lattice).alias("cell"),
    )
    position = F.coalesce(F.col("lo") + F.col("cell") * F.col("step"), F.col("x"))
    if band is not None:
        own = placed.select("k", position.alias("at"), "lo", "hi", "total").distinct()
        # Negative numbers, in the order of the positions, are those of the data.
        numbered = own.withColumn("e", (-F.row_number().over(Window.partitionBy("k").orderBy("at"))).cast("long"))
        at = at.select(*columns).unionByName(numbered.select(*columns))
    fits = _local_fits(_local_sums(values, stage(at.select(*columns), "positions"), span, degree), degree)
    if band is None:
        return _ungrouped(fits, by, F.col("at").alias(x), "fit")
    fits = stage(fits, "fits")
    there = fits.where("e < 0").select("k", F.col("at"), "fit", "slope", "norm", "own")
    met = placed.withColumn("at", position).join(there, ["k", "at"])
    fit = F.col("fit") + F.col("slope") * (F.col("x") - F.col("at"))
    total = met.groupBy("k").agg(
        F.sum(F.col("syy") - 2 * fit * F.col("sy") + F.col("n") * fit * fit).alias("rss"),
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("own")).alias("trace"), F.sum(F.col("n") * F.col("norm")).alias("norms"),
    )
    df = F.col("n") - 2 * F.col("trace") + F.col("norms")
    left = total.select("k", F.when(df > 1e-6, df).alias("df"), F.greatest(F.col("rss"), F.lit(0.0)).alias("rss"))
    se = F.sqrt(F.col("rss") / F.col("df") * F.greatest(F.col("norm"), F.lit(0.0)))
    out = fits.where("e >= 0").join(left, "k").withColumn("se", se).withColumn("reach", F.col("se") * t_quantile(band, F.col("df")))
    low, high = (F.col("fit") - F.col("reach")).alias("low"), (F.col("fit") + F.col("reach")).alias("high")
    return _ungrouped(out, by, F.col("at").alias(x), "fit", "se", low, high)


# -- smoother of large samples ----------------------------------------------------------------


def _knots(values: DataFrame, basis: int) -> DataFrame:
    """``k, knots``: ends and evenly spread quantiles of the different values of ``x``, per group.

    A value's rank is its number within a stretch of the range plus the number in all stretches
    before, so no group is numbered in one task.
    """
    ends = values.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("m"))
    part = F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 4096), F.lit(4095))
    placed = values.join(ends, "k").select("k", "x", "m", F.coalesce(part, F.lit(0)).alias("part"))
    sizes = placed.groupBy("k", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("k").orderBy("part")) - F.col("size")).drop("size")
    ranked = placed.join(before, ["k", "part"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("k", "part").orderBy("x")) - 1
    )
    # Knot j stands at place (m - 1) * j / (basis - 1) among the values, between two of them if need be.
    j = F.explode(F.sequence(F.lit(0), F.lit(basis - 1)))
    wanted = ends.select("k", "m", j.alias("j")).withColumn("place", (F.col("m") - 1) * F.col("j") / (basis - 1))
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    share = F.when(F.floor("place") == F.ceil("place"), F.lit(1.0)).otherwise(1 - F.abs(F.col("place") - F.col("rank")))
    at = ranked.join(wanted, ["k", "m", "rank"]).groupBy("k", "j").agg(F.sum(F.col("x") * share).alias("at"))
    listed = at.groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("knots"))
    return listed.where(F.size("knots") >= 3)


def _cubic_system(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From values at the knots to second derivatives of the natural cubic spline, and its roughness matrix."""
    h, m = np.diff(knots), len(knots)
    d, b = np.zeros((m - 2, m)), np.zeros((m - 2, m - 2))
    for i in range(m - 2):
        d[i, i : i + 3] = [1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            b[i, i - 1] = b[i - 1, i] = h[i] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(m), inner, np.zeros(m)]), d.T @ inner


def _basis_row(knots: np.ndarray, second: np.ndarray, x: np.ndarray) -> np.ndarray:
    j = np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)
    h, rows = knots[j + 1] - knots[j], np.arange(len(x))
    left, right = (knots[j + 1] - x) / h, (x - knots[j]) / h
    out = np.zeros((len(x), len(knots)))
    out[rows, j] += left
    out[rows, j + 1] += right
    out += ((left**3 - left) * h**2 / 6)[:, None] * second[j] + ((right**3 - right) * h**2 / 6)[:, None] * second[j + 1]
    return out


def choose_penalty(a: np.ndarray, b: np.ndarray, yy: float, n: float, rough: np.ndarray) -> float:
    """The penalty with the least generalised cross-validation score ``n RSS / (n - trace)^2``.

    One decomposition of the ``k x k`` system makes every score a sum over ``k`` numbers.
    """
    values, vectors = np.linalg.eigh(a + 1e-10 * np.trace(a) / len(a) * np.eye(len(a)))
    half = vectors / np.sqrt(values)
    s, q = np.linalg.eigh(half.T @ rough @ half)
    s, c = np.clip(s, 0, None), q.T @ (half.T @ b)

    def score(log: float) -> float:
        shrink = 1 / (1 + np.exp(log) * s)
        rss = yy - 2 * (c * c * shrink).sum() + (c * c * shrink * shrink).sum()
        return n * max(rss, 0.0) / max(n - shrink.sum(), 1e-9) ** 2

    size = np.log(np.trace(a) / max(np.trace(rough), 1e-300))
    logs = size + np.linspace(-25, 25, 201)
    best = int(np.argmin([score(v) for v in logs]))
    low, high = logs[max(best - 1, 0)], logs[min(best + 1, len(logs) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        first, second = high - ratio * (high - low), low + ratio * (high - low)
        if score(first) <= score(second):
            high = second
        else:
            low = first
    return float(np.exp((low + high) / 2))


def regression_spline(
    points: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    basis: int = 10,
    penalty: float | None = None,
    count: int = 80,
    band: float | None = None,
) -> DataFrame:
    """Penalised cubic regression spline per group, at ``count`` even positions over its range.

    The spline is given by its values at ``basis`` knots, spread evenly over the different
    values of ``x``, and natural at its ends; the integral of the squared second derivative times
    ``penalty`` is added to the squared residuals. Without a ``penalty``, generalised
    cross-validation chooses it. Rows enter as sums of products of the knots' local weights, one
    aggregate over all groups; per group a system as large as ``basis`` is solved.
    Returns ``by, x, fit`` and, with a ``band`` level, ``se, low, high`` (of the penalised fit,
    its variance the residual one times the inverse system).

    Rows without ``x`` or ``y`` do not count; a null group is a group; groups with fewer than
    three different values of ``x`` have no curve, an empty table has no rows.
    """
    values = _values(points, x, y, by)
    knots = stage(_knots(values, basis), "knots")
    # On a piece of the spline the four weights of x are fixed functions; the piece's sums suffice.
    piece = F.least(F.greatest(F.size(F.filter("knots", lambda v: v <= F.col("x"))) - 1, F.lit(0)), F.size("knots") - 2)
    at = values.join(knots, "k").withColumn("piece", piece)
    start, end = F.get("knots", F.col("piece")), F.get("knots", F.col("piece") + 1)
    right = (F.col("x") - start) / (end - start)
    left = (end - F.col("x")) / (end - start)
    terms = [left, right, left * left * left - left, right * right * right - right]
    at = at.select("k", "piece", "n", "sy", "syy", *[t.alias(f"f{i}") for i, t in enumerate(terms)])
    sums = [F.sum(F.col("n") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"a{i}{j}") for i in range(4) for j in range(i, 4)]
    sums += [F.sum(F.col("sy") * F.col(f"f{i}")).alias(f"b{i}") for i in range(4)]
    pieces = at.groupBy("k", "piece").agg(*sums, F.sum("n").alias("n"), F.sum("syy").alias("yy"))
    listed = pieces.groupBy("k").agg(F.collect_list(F.struct(*[c for c in pieces.columns if c != "k"])).alias("pieces"))
    flat = listed.join(knots, "k").select(F.to_json(F.struct("k"), {"ignoreNullFields": "false"}).alias("key"), "knots", "pieces")
    names = [c for c in pieces.columns if c not in ("k", "piece", "n", "yy")]
    extra = ["se", "low", "high"] if band is not None else []

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, at, parts in zip(pdf["key"], pdf["knots"], pdf["pieces"]):
                at = np.asarray(at, float)
                second, rough = _cubic_system(at)
                m = len(at)
                a, b, n, yy = np.zeros((m, m)), np.zeros(m), 0.0, 0.0
                for part in parts:
                    p = part["piece"]
                    h = at[p + 1] - at[p]
                    to = np.stack([np.eye(m)[p], np.eye(m)[p + 1], second[p] * h * h / 6, second[p + 1] * h * h / 6])
                    local = np.zeros((4, 4))
                    for name in names:
                        if name[0] == "a":
                            i, j = int(name[1]), int(name[2])
                            local[i, j] = local[j, i] = part[name]
                    a += to.T @ local @ to
                    b += to.T @ np.array([part[f"b{i}"] for i in range(4)])
                    n, yy = n + part["n"], yy + part["yy"]
                weight = choose_penalty(a, b, yy, n, rough) if penalty is None else penalty
                inverse = np.linalg.pinv(a + weight * rough, rcond=1e-13, hermitian=True)
                beta = inverse @ b
                grid = np.linspace(at[0], at[-1], count)
                row = _basis_row(at, second, grid)
                out = pd.DataFrame({"key": key, "at": grid, "fit": row @ beta, "penalty": weight})
                out["df"] = n - np.trace(inverse @ a)
                rss = max(yy - 2 * beta @ b + beta @ a @ beta, 0.0)
                variance = np.clip(np.einsum("gi,ij,gj->g", row, inverse, row), 0, None)
                out["se"] = np.sqrt(rss / out["df"] * variance) if out["df"].iloc[0] > 1e-6 else np.nan
                yield out

    fits = flat.mapInPandas(solve, "key string, at double, fit double, penalty double, df double, se double")
    kind = values.schema["k"].dataType.simpleString()
    fits = fits.withColumn("k", F.from_json("key", f"k {kind}")["k"]).withColumn("se", F.nanvl("se", F.lit(None).cast("double")))
    if band is None:
        return _ungrouped(fits, by, F.col("at").alias(x), "fit")
    reach = F.col("se") * t_quantile(band, F.col("df"))
    return _ungrouped(fits, by, F.col("at").alias(x), "fit", "se", (F.col("fit") - reach).alias(extra[1]), (F.col("fit") + reach).alias(extra[2]))
