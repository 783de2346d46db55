"""Kernel densities and local regression on a fixed evaluation grid.

Data never meet the grid row by row in a shuffle. Densities in one dimension count the data in
bins much narrower than the kernel and reach only the grid points that the kernel does; in two
dimensions, and in local regression, every task turns its rows into partial sums per grid
point, and only those sums are shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.operators.quantiles import quantiles_of_counts, value_counts
from baroflow.operators.surfaces import local_surfaces
from baroflow.plans.staging import stage

# -- kernel densities --------------------------------------------------------------------


def _spread(df: DataFrame, column: str, factor: float, p: str) -> DataFrame:
    """One row with the size, range and normal-reference bandwidth of a column."""
    known = df.where(F.col(column).isNotNull())
    counts = value_counts(known, [], column)
    q = quantiles_of_counts(counts, [], [0.25, 0.75], ["q1", "q3"])
    basic = known.agg(
        F.struct(
            F.count("*").alias("n"),
            F.min(column).alias("lo"),
            F.max(column).alias("hi"),
            F.stddev_samp(column).alias("sd"),
        ).alias("b")
    )
    row = q.withColumn("b", basic.scalar())
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    sd, size = F.nullif(F.col("b.sd"), F.lit(0.0)), F.nullif(F.abs(F.col("b.lo")), F.lit(0.0))
    narrow = F.coalesce(F.when(iqr > 0, F.least(sd, iqr)), sd, size.cast("double"), F.lit(1.0))
    h = narrow * factor * F.pow(F.col("b.n").cast("double"), F.lit(-0.2))
    return row.select(
        F.struct(F.col("b.n").alias(f"{p}n"), F.col("b.lo").alias(f"{p}lo"), F.col("b.hi").alias(f"{p}hi"), h.alias(f"{p}h")).alias("s")
    )


def _bell(u: Column) -> Column:
    return F.exp(u * u * -0.5) / math.sqrt(2.0 * math.pi)


_REACH = 9.0  # bandwidths; the kernel is below 1e-17 of its peak beyond
_FINE = 65536  # bins a bandwidth; with shared weights the error is below 1e-10 of the peak


def _shares(v: Column, lo: Column, h: Column) -> Column:
    """The two bins (at ``lo + bin * h / _FINE``) next to a value, each with its share of it."""
    at = (v - lo) / h * _FINE
    low = F.floor(at)
    part = at - low
    return F.array(
        F.struct(low.alias("bin"), (1 - part).alias("c")), F.struct((low + 1).alias("bin"), part.alias("c"))
    )


def _within_reach(v: Column, start: Column, step: Column, h: Column, points: int) -> Column:
    """Numbers of the grid points ``start + i * step`` that the kernel at ``v`` reaches."""
    first = F.greatest(F.lit(0.0), F.ceil((v - h * _REACH - start) / step).cast("double"))
    last = F.least(F.lit(points - 1.0), F.floor((v + h * _REACH - start) / step).cast("double"))
    every = F.sequence(F.lit(0), F.lit(points - 1))
    some = F.sequence(first.cast("int"), last.cast("int"))
    return F.when(~(step > 0), every).when(first > last, F.array().cast("array<int>")).otherwise(some)


def kde_1d(df: DataFrame, column: str, points: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian density on ``points`` positions from ``cut`` bandwidths below to above the range.

    The bandwidth is 0.9 min(sd, IQR/1.34) n^-1/5; for a constant column or a single row it
    takes the standard deviation, the value's size or 1 instead. Each value is shared between
    two neighbouring bins of a fixed part of the bandwidth, so accuracy depends neither on the
    range nor on outliers, and an occupied bin meets only the grid points within reach.
    """
    spread = _spread(df, column, 0.9, "")
    known = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    placed = known.select("v", spread.scalar().alias("s"))
    lo, h = F.col("s.lo").cast("double"), F.col("s.h")
    start = lo - h * cut
    step = (F.col("s.hi") - lo + h * (2 * cut)) / max(points - 1, 1)
    binned = (
        placed.select("s", F.explode(_shares(F.col("v"), lo, h)).alias("b"))
        .groupBy("s", "b.bin").agg(F.sum("b.c").alias("c"))
    )
    centre = lo + F.col("bin") * (h / _FINE)
    at = start + step * F.col("i")
    hits = binned.withColumn("i", F.explode(_within_reach(centre, start, step, h, points))).select(
        "s", "i", (F.col("c") * _bell((at - centre) / h) / (h * F.col("s.n"))).alias("part")
    )
    empty = spread.select("s", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    rows = hits.unionByName(empty.where("s.n > 0").withColumn("part", F.lit(0.0)))
    return rows.groupBy("i", at.alias("x")).agg(F.sum("part").alias("density"))


def _group_spread(known: DataFrame, column: str, factor: float) -> DataFrame:
    """``k``, range, number of rows and normal-reference bandwidth of a column, per group."""
    q = quantiles_of_counts(value_counts(known, ["k"], column), ["k"], [0.25, 0.75], ["q1", "q3"])
    basic = known.groupBy("k").agg(
        F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd")
    )
    iqr = (F.col("q3") - F.col("q1")) / 1.34
    sd, size = F.nullif(F.col("sd"), F.lit(0.0)), F.nullif(F.abs(F.col("lo")), F.lit(0.0))
    narrow = F.coalesce(F.when(iqr > 0, F.least(sd, iqr)), sd, size, F.lit(1.0))
    h = narrow * factor * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return basic.join(q, "k").select("k", *[c.alias(f"{n}_{column}") for n, c in (("n", F.col("n")), ("lo", F.col("lo")), ("hi", F.col("hi")), ("h", h))])


_GROUPS_HELD = 256


def kde_2d(df: DataFrame, x: str, y: str, points: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """Product-Gaussian density on a ``points`` by ``points`` grid over each group's range.

    Bandwidths are 1.06 min(sd, IQR/1.34) n^-1/5 per axis and group, with the same fallbacks as
    in one dimension. The kernel is a product, so a batch of rows gives two matrices, of grid
    columns by rows and rows by grid rows, whose product is the batch's part of the grid: two
    times ``points`` kernel values a row, no binning, and only sums are shuffled.
    Rows without a value do not count; a null group is a group; no rows give no grid.
    """
    known = df.select(
        F.struct(*[F.col(c) for c in by]).alias("k") if by else F.struct(F.lit(0).alias("one")).alias("k"),
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
    ).dropna(subset=["x", "y"])
    spread = _group_spread(known, "x", 1.06).join(_group_spread(known, "y", 1.06), "k")
    spread = stage(spread.withColumn("g", F.monotonically_increasing_id()), "spread")
    ends = [f"{e}_{v}" for v in "xy" for e in ("lo", "hi", "h")]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame({"g": list(held), "sums": [m.ravel() for m in held.values()]})
            held.clear()
            return out

        share = np.linspace(0.0, 1.0, points)[:, None]
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False):
                first = rows.iloc[0]
                sides = []
                for v in "xy":
                    lo, hi, h = first[f"lo_{v}"], first[f"hi_{v}"], first[f"h_{v}"]
                    u = (lo + (hi - lo) * share - rows[v].to_numpy()[None, :]) / h
                    sides.append(np.exp(-0.5 * u * u))
                held[g] = held.get(g, 0.0) + sides[0] @ sides[1].T
            if len(held) > _GROUPS_HELD:
                yield hand_on()
        if held:
            yield hand_on()

    rows = known.join(spread, "k").select("g", "x", "y", *ends)
    parts = rows.mapInPandas(part, "g long, sums array<double>").select("g", F.posexplode("sums").alias("cell", "part"))
    total = parts.groupBy("g", "cell").agg(F.sum("part").alias("sum")).join(spread, "g")
    i, j = F.floor(F.col("cell") / points).cast("int"), (F.col("cell") % points).cast("int")
    at = {v: F.col(f"lo_{v}") + (F.col(f"hi_{v}") - F.col(f"lo_{v}")) * n / max(points - 1, 1) for v, n in (("x", i), ("y", j))}
    density = F.col("sum") / (2 * math.pi) / (F.col("h_x") * F.col("h_y") * F.col("n_x"))
    return total.select(*[F.col("k")[c].alias(c) for c in by], i.alias("i"), j.alias("j"), at["x"].alias("x"), at["y"].alias("y"), density.alias("density"))


# -- local regression ------------------------------------------------------------------------

_BINS = 64  # distance bins per refinement pass
_PASSES = 5  # pins the radius down to one part in 10**9 of the range
_PAIRS_PER_TASK = 20_000_000


def grid_points(axes: Sequence[tuple[float, float, float]]) -> np.ndarray:
    """Cartesian grid from ``(first, last, step)`` per axis."""
    lines = [np.arange(int(math.floor((b - a) / s + 1e-9)) + 1) * s + a for a, b, s in axes]
    return np.array(list(itertools.product(*lines)), dtype=np.float64)


def expand_axis(df: DataFrame, name: str, first: Column, last: Column, step: float) -> DataFrame:
    """One copy of each row per value from ``first`` to ``last`` by ``step``."""
    count = F.floor((last - first) / float(step) + 1e-9).cast("int")
    out = df.withColumn("_i", F.explode(F.sequence(F.lit(0), count)))
    return out.withColumn(name, F.col("_i") * float(step) + first).drop("_i")


def grid_frame(spark, axes: Sequence[tuple[float, float, float]], names: Sequence[str]) -> DataFrame:
    """The same grid as rows, generated without a join."""
    out = spark.range(1)
    for (a, b, s), name in zip(axes, names):
        out = expand_axis(out, name, F.lit(float(a)), F.lit(float(b)), s)
    return out.select(*names)


def _powers(d: int, degree: int) -> list[tuple[int, ...]]:
    return [p for p in itertools.product(range(degree + 1), repeat=d) if sum(p) <= degree]


def local_regression(
    points: DataFrame,
    predictors: Sequence[str],
    response: str,
    grid: np.ndarray,
    alpha: float = 0.7,
    degree: int = 2,
) -> DataFrame:
    """Locally weighted polynomial evaluated directly at every grid point.

    Weights are tricube within the distance to the ``floor(alpha * n)``-th nearest row,
    in the units of the predictors.  That distance is found by counting rows in ever
    finer distance bins; the weighted normal equations are then summed per task and per
    grid point, so tasks hand on sums and never pairs.  ``points`` is read several times,
    so pass a staged table.
    """
    d, g = len(predictors), len(grid)
    cols = [f"p{i}" for i in range(d)]
    data = points.select(
        *[F.col(c).cast("double").alias(p) for c, p in zip(predictors, cols)],
        F.col(response).cast("double").alias("y"),
    ).dropna()
    head = data.agg(
        F.count("*").alias("n"), *[f(p).alias(f"{f.__name__}_{p}") for p in cols for f in (F.min, F.max)]
    ).first()
    ddl = ", ".join(f"`{c}` double" for c in [*predictors, "fit"])
    if head["n"] == 0:
        return points.sparkSession.createDataFrame([], ddl)
    k = max(1, int(math.floor(alpha * head["n"] + 1e-9)))
    # As many tasks as the number of distance evaluations calls for.
    data = data.repartition(max(1, math.ceil(head["n"] * g / _PAIRS_PER_TASK)))
    first = np.array([head[f"min_{p}"] for p in cols])
    last = np.array([head[f"max_{p}"] for p in cols])
    centre, scale = (first + last) / 2, np.where(last > first, (last - first) / 2, 1.0)

    def slices(it: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Coordinates, responses and distances (grid by row) of a bounded number of rows."""
        size = max(1, 1_000_000 // g)
        for pdf in it:
            for i in range(0, len(pdf), size):
                part = pdf.iloc[i : i + size]
                x = part[cols].to_numpy(np.float64)
                sq = np.zeros((g, len(x)))
                for j in range(d):
                    sq += (grid[:, j, None] - x[None, :, j]) ** 2
                yield x, part["y"].to_numpy(np.float64), np.sqrt(sq)

    # Radius: narrow [lo, lo + width) around the distance of the k-th nearest row.
    far = np.maximum(np.abs(grid - first), np.abs(grid - last))
    lo, width = np.zeros(g), np.sqrt((far**2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    for _ in range(_PASSES):

        def count(it: Iterator[pd.DataFrame], lo=lo, width=width) -> Iterator[pd.DataFrame]:
            # Bin 0 holds the rows nearer than the interval, the last bin those beyond it.
            per = _BINS + 2
            n = np.zeros(g * per, dtype=np.int64)
            base = np.arange(g)[:, None] * per
            for _, _, dist in slices(it):
                pos = np.floor((dist - lo[:, None]) * (_BINS / width)[:, None]) + 1
                cell = base + np.clip(pos, 0, _BINS + 1).astype(np.int64)
                n += np.bincount(cell.ravel(), minlength=g * per)
            used = np.flatnonzero(n)
            yield pd.DataFrame({"g": used // per, "b": used % per, "n": n[used]})

        upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        hit = (
            data.mapInPandas(count, "g long, b long, n long")
            .groupBy("g", "b")
            .agg(F.sum("n").alias("n"))
            .withColumn("cum", F.sum("n").over(upto))
            .where(F.col("cum") >= k)
            .groupBy("g")
            .agg(F.min("b").alias("b"))
            .toPandas()  # one row per grid point
        )
        gi = hit["g"].to_numpy()
        width = width / _BINS
        lo = lo.copy()
        lo[gi] += (np.clip(hit["b"].to_numpy(), 1, _BINS) - 1) * width[gi]
    radius = lo + width

    powers, moments = _powers(d, degree), _powers(d, 2 * degree)
    place = {p: j for j, p in enumerate(moments)}

    def basis(x: np.ndarray, exponents: list[tuple[int, ...]]) -> np.ndarray:
        u = (x - centre) / scale
        return np.stack([np.prod(u ** np.array(p), axis=1) for p in exponents], axis=1)

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((g, len(moments) + len(powers)))
        for x, y, dist in slices(it):
            r = dist / radius[:, None]
            w = np.clip(1.0 - r * r * r, 0.0, None)
            total += (w * w * w) @ np.hstack([basis(x, moments), basis(x, powers) * y[:, None]])
        yield pd.DataFrame({"g": np.arange(g), **{c: total[:, j] for j, c in enumerate(sums)}})

    sums = [f"s{j}" for j in range(len(moments))] + [f"t{j}" for j in range(len(powers))]
    totals = (
        data.mapInPandas(partial, "g long, " + ", ".join(f"{c} double" for c in sums))
        .groupBy("g")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )

    def solve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at = grid[pdf["g"].to_numpy()]
            fit = []
            for row, b in zip(pdf[sums].to_numpy(), basis(at, powers)):
                m = np.array([[row[place[tuple(np.add(p, q))]] for q in powers] for p in powers])
                t = row[len(moments) :]
                fit.append(b @ np.linalg.lstsq(m, t, rcond=1e-12)[0] if m[0, 0] > 0 else np.nan)
            yield pd.DataFrame({**{c: at[:, i] for i, c in enumerate(predictors)}, "fit": fit})

    return totals.mapInPandas(solve, ddl)


def local_curve(
    points: DataFrame, x: str, y: str, span: float = 0.75, degree: int = 2, count: int = 80
) -> DataFrame:
    """Smooth curve through ``points`` at ``count`` evenly spaced positions of its range."""
    ends = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if ends["a"] is None:
        return points.sparkSession.createDataFrame([], f"`{x}` double, fit double")
    grid = np.linspace(float(ends["a"]), float(ends["b"]), count)[:, None]
    return local_regression(points, [x], y, grid, span, degree)


# Prediction grids as (first, last, step) for temperature and pressure change.
SURFACE_GRID = [(0.0, 30.0, 0.5), (-1800.0, 2400.0, 100.0)]
EXTREME_GRID = [(6.0, 30.0, 0.5), (-800.0, 700.0, 100.0)]
OLDER_GRID = [(-6.0, 28.0, 0.5), (-1200.0, 1200.0, 100.0)]


def local_surface(
    surface: DataFrame, axes: Sequence[tuple[float, float, float]] = SURFACE_GRID, alpha: float = 0.7
) -> DataFrame:
    """POP over temperature and pressure change, fitted per half-year and predicted on a grid.

    ``surface`` is the output of ``pop_surface``. Fits are made at vertices and interpolated;
    ``local_regression`` evaluates every grid point directly.
    """
    fits = local_surfaces(surface, ["MonT", "Sum_Press_Delta"], "RainProb", axes, ["YrSide"], alpha)
    return fits.select("MonT", "Sum_Press_Delta", F.col("fit").alias("RainProb"), "YrSide")
