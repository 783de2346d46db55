"""Gap filling, centred mean and lagged difference on the regular series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.functions import numerics
from baroflow.functions.nulls import snap
from baroflow.operators.blocks import (
    add_block_offsets,
    block_window,
    neighbour_rows,
    owned,
    with_block,
    with_halo,
)
from baroflow.operators.grid import explode_steps
from baroflow.schema import BLOCK, BLOCK_STEPS, MEASURES, STATION, STEP

KNOT_CHUNK = 1024  # known points solved together
KNOT_HALO = 64  # extra known points on each side; their influence is below 2**-64


def fill_and_pad(
    buckets: DataFrame,
    method: str = "spline",
    measures: Sequence[str] = MEASURES,
    columns: dict[str, str] | None = None,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Pad to the full grid and fill missing values; known points keep their value.

    ``columns`` maps a measure to its filled column, by default the pressure to
    ``pressure_spl``.  ``method='spline'`` is the cubic with third-derivative end conditions
    taken from the first and last four points; beyond the ends the end cubics go on.
    ``'linear'`` fills between known points and leaves the ends empty.
    """
    if method not in ("spline", "linear"):
        raise ValueError(f"unknown method {method!r}")
    columns = columns or {"Pressure_hPa": "pressure_spl"}
    src = buckets.select(STATION, STEP, *measures)
    if method == "spline":
        src = _with_cubics(src, list(columns))
    knots = {}
    for c in columns:
        fields = [F.col(STEP).alias("s"), F.col(c).alias("y")]
        if method == "spline":
            fields += [F.col(f"_at_{c}.{k}").alias(k) for k in ("_b", "_c", "_d")]
        knots[c] = (F.struct(*fields), F.col(c).isNotNull())
    linked = neighbour_rows(
        src,
        previous={f"_prev_{c}": k for c, k in knots.items()},
        following={"next_step": (F.col(STEP), None), **{f"_next_{c}": k for c, k in knots.items()}},
        inclusive=[f"_prev_{c}" for c in knots],
        size=block_steps,
    )
    grid = explode_steps(linked.drop(*[f"_at_{c}" for c in columns]), measures)
    filled = {}
    for c, out in columns.items():
        p, n, s = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(STEP)
        if method == "linear":
            value = _line(p, n, s)
        else:
            value = F.when(p.isNotNull(), _cubic(p, s)).otherwise(_cubic(n, s))
        filled[out] = F.coalesce(F.col(c), value)
    return grid.withColumns(filled).drop(*[f"_{d}_{c}" for d in ("prev", "next") for c in columns])


def _with_cubics(src: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the cubic ``_at_<column>`` of every known value, where one is needed.

    Several columns are stacked as series of their own, so that one solve and one join back
    serve all of them.
    """
    if len(columns) == 1:
        known = src.where(F.col(columns[0]).isNotNull()).select(STATION, STEP, F.col(columns[0]).alias("y"))
        of = F.struct("_b", "_c", "_d")
        coef = spline_coefficients(known).select(STATION, STEP, of.alias(f"_at_{columns[0]}"))
        return src.join(coef, [STATION, STEP], "left")
    # The column's number leads the key of its series, at a fixed width.
    values = F.array(*[F.struct(F.lit(f"{i:04d}").alias("i"), F.col(c).alias("y")) for i, c in enumerate(columns)])
    stacked = src.select(STATION, STEP, F.inline(values)).where(F.col("y").isNotNull())
    coef = spline_coefficients(stacked.select(F.concat("i", STATION).alias(STATION), STEP, "y"))
    number = F.substring(STATION, 1, 4).cast("int")
    picks = [
        F.max(F.when(F.col("_i") == i, F.struct("_b", "_c", "_d"))).alias(f"_at_{c}") for i, c in enumerate(columns)
    ]
    wide = (
        coef.withColumn("_i", number)
        .withColumn(STATION, F.expr(f"substring({STATION}, 5)"))
        .groupBy(STATION, STEP)
        .agg(*picks)
    )
    return src.join(wide, [STATION, STEP], "left")


def _line(p: Column, n: Column, s: Column) -> Column:
    return p["y"] + (n["y"] - p["y"]) * (s - p["s"]).cast("double") / (n["s"] - p["s"]).cast("double")


def _cubic(k: Column, s: Column) -> Column:
    t = (s - k["s"]).cast("double")
    return k["y"] + t * (k["_b"] + t * (k["_c"] + t * k["_d"]))


def spline_coefficients(
    knots: DataFrame, chunk: int = KNOT_CHUNK, halo: int = KNOT_HALO, all_knots: bool = False
) -> DataFrame:
    """Cubic coefficients ``_b, _c, _d`` at the known points, solved in bounded chunks.

    The tridiagonal system has off-diagonals of at most half the diagonal, so a point
    ``k`` places away weighs less than 2**-k: solving a chunk together with ``halo`` extra
    points on each side agrees with the whole-series solve to rounding.  Chunks in which
    no step is missing are dropped before any Python runs.
    """
    w = block_window().rowsBetween(Window.unboundedPreceding, 0)
    # Order number of every known point, in two levels.
    numbered = with_block(knots).withColumn("_k", F.count("*").over(w))
    numbered = add_block_offsets(numbered, ["_k"]).drop(BLOCK)
    copies = with_halo(numbered, halo, halo, order="_k", size=chunk)
    if not all_knots:
        by_chunk = Window.partitionBy(STATION, BLOCK)
        # A hole anywhere in the chunk, or a series end: both may need a cubic.
        holes = (F.max(STEP).over(by_chunk) - F.min(STEP).over(by_chunk)) >= F.count("*").over(by_chunk)
        full = F.count("*").over(by_chunk) < chunk + 2 * halo
        copies = copies.withColumn("_need", holes | full).where("_need").drop("_need")

    def solve(knots: pa.Table) -> pa.Table:
        x, y, own = (knots.column(c).to_numpy() for c in (STEP, "y", "_own"))
        order = np.argsort(x)
        coef = numerics.cubic_coefficients(x[order].astype(np.float64), y[order])
        keep = own[order]
        return pa.table(
            {
                STATION: knots.column(STATION).take(pa.array(order[keep])),
                STEP: x[order][keep],
                **{n: pa.array(v[keep], from_pandas=True) for n, v in zip(("_b", "_c", "_d"), coef)},
            }
        )

    return copies.groupBy(STATION, BLOCK).applyInArrow(
        solve, f"{STATION} string, {STEP} long, _b double, _c double, _d double"
    )


# -- bounded frames over (station, block) ------------------------------------------
#
# Fixed-width sums are written as sums of shifted values.  A shift past the series end is
# NULL and makes the sum NULL, which is just the rule for a frame that is not full, and a
# shift costs one row access where a sliding frame would add up its whole width again.


def at(value, offset: int, w) -> Column:
    """The value ``offset`` rows ahead (behind if negative)."""
    if offset == 0:
        return F.col(value) if isinstance(value, str) else value
    return F.lead(value, offset).over(w) if offset > 0 else F.lag(value, -offset).over(w)


def shifted_sum(value, offsets, w) -> Column:
    return reduce(lambda a, b: a + b, [at(value, k, w) for k in offsets])


def mean_span(n: int) -> tuple[int, int]:
    """Rows before and after the current one in a centred mean; even widths lean ahead.

    A width of 24 covers 11 rows before and 12 after.
    """
    return (n - 1) // 2, n - 1 - (n - 1) // 2


def run_length(n: int) -> int:
    """A divisor of ``n`` near its square root: sums of ``n`` are built from shorter runs."""
    return max(d for d in range(1, int(n**0.5) + 1) if n % d == 0)


def run_sum(column: str, n: int, w) -> Column:
    """Sum of this row and the following ones, over the run length of ``n``."""
    return shifted_sum(column, range(run_length(n)), w)


def mean_of_runs(run: str, n: int, w, shift: int = 0) -> Column:
    """Centred mean over ``n`` rows from run sums, ``shift`` rows away; NULL where not full."""
    before, _ = mean_span(n)
    size = run_length(n)
    return shifted_sum(run, [shift - before + k for k in range(0, n, size)], w) / float(n)


def change_of_runs(run: str, n: int, lag: int, w) -> dict[str, Column]:
    """The centred mean and its change over ``lag`` rows."""
    mean = mean_of_runs(run, n, w)
    return {"pressure_av": mean, "pressure_chng_av": snap(mean - mean_of_runs(run, n, w, -lag))}


def rolling_means(
    df: DataFrame, columns: dict[str, str], n: int = 24, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Centred means of several columns; ``columns`` maps input to output."""
    before, after = mean_span(n)
    w = block_window()
    runs = {c: f"_run_{c}" for c in columns}
    h = with_halo(df, before, after, size=block_steps).withColumns({r: run_sum(c, n, w) for c, r in runs.items()})
    out = h.withColumns({o: mean_of_runs(runs[c], n, w) for c, o in columns.items()})
    return owned(out).drop(BLOCK, *runs.values())


def rolling_sums(
    df: DataFrame, column: str = "Rain", width: int = 5, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Left- and right-aligned rolling sums ``sum_left`` / ``sum_right``; partial windows are 0."""
    h = with_halo(df, width - 1, width - 1, size=block_steps)
    w = block_window()
    x, none = F.coalesce(F.col(column), F.lit(0.0)), F.lit(0.0)
    return owned(
        h.withColumns(
            {
                "sum_left": F.coalesce(shifted_sum(x, range(width), w), none),
                "sum_right": F.coalesce(shifted_sum(x, range(1 - width, 1), w), none),
            }
        )
    ).drop(BLOCK)


def pressure_change(df: DataFrame, n: int = 24, lag: int = 24, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Centred mean ``pressure_av`` and its change ``pressure_chng_av`` over ``lag`` steps."""
    before, after = mean_span(n)
    w = block_window()
    h = with_halo(df, before + lag, after, size=block_steps).withColumn("_run", run_sum("pressure_spl", n, w))
    return owned(h.withColumns(change_of_runs("_run", n, lag, w))).drop(BLOCK, "_run")


# -- harmonic regression ----------------------------------------------------------

HARMONICS = ["one", "s1", "c1", "s2", "c2"]


def hourly_change(series: DataFrame, column: str = "Temp_C", block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Change since the previous step, NULL when either value is missing."""
    h = with_halo(series, 1, 0, size=block_steps)
    out = h.withColumn("change", F.col(column) - F.lag(column, 1).over(block_window()))
    return owned(out).drop(BLOCK)


def harmonic_terms(hour: Column, period: float = 24.0) -> dict[str, Column]:
    a = hour * F.lit(2.0 * np.pi / period)
    return {"one": F.lit(1.0), "s1": F.sin(a), "c1": F.cos(a), "s2": F.sin(a * 2), "c2": F.cos(a * 2)}


def harmonic_normal_equations(changes: DataFrame, period: float = 24.0) -> DataFrame:
    """Cross products of the harmonic regressors and of each with the change, per station.

    The regressors depend on the hour only, so the data are first reduced to a count and
    a sum per hour.
    """
    by_hour = (
        changes.where(F.col("change").isNotNull())
        .groupBy(STATION, F.hour("Time").alias("hour"))
        .agg(F.count("*").alias("n"), F.sum("change").alias("t"))
        .withColumns(harmonic_terms(F.col("hour"), period))
    )
    sums = []
    for i, a in enumerate(HARMONICS):
        for b in HARMONICS[i:]:
            sums.append(F.sum(F.col("n") * F.col(a) * F.col(b)).alias(f"{a}_{b}"))
        sums.append(F.sum(F.col("t") * F.col(a)).alias(f"{a}_y"))
    return by_hour.groupBy(STATION).agg(*sums)


def harmonic_profile(changes: DataFrame, period: float = 24.0) -> DataFrame:
    """Fitted change per hour of day as ``profile`` (array of 24) for each station.

    ``period`` is in hours and divides a day.
    """
    if (24 / period) % 1:
        raise ValueError(f"a day is no multiple of {period} hours")
    eq = harmonic_normal_equations(changes, period)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hours = np.arange(24) * 2.0 * np.pi / period
        design = np.stack([np.ones(24), np.sin(hours), np.cos(hours), np.sin(2 * hours), np.cos(2 * hours)], axis=1)
        for pdf in batches:
            m = np.empty((len(pdf), 5, 5))
            for i, a in enumerate(HARMONICS):
                for j, b in enumerate(HARMONICS[i:], i):
                    m[:, i, j] = m[:, j, i] = pdf[f"{a}_{b}"]
            rhs = pdf[[f"{a}_y" for a in HARMONICS]].to_numpy(np.float64)
            # The least-norm solution where the hours seen cannot tell all terms apart.
            fitted = np.einsum("nij,nj->ni", np.linalg.pinv(m, rcond=1e-12, hermitian=True), rhs) @ design.T
            yield pd.DataFrame({STATION: pdf[STATION], "profile": list(fitted)})

    return eq.mapInPandas(solve, f"{STATION} string, profile array<double>")


def harmonic_fill(
    series: DataFrame,
    column: str = "Temp_C",
    out: str = "temp_cure",
    base: float | None = None,
    period: float = 24.0,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Fill missing stretches with a start value plus the accumulated hourly profile.

    The start value is the last known value before the stretch, or ``base``.  A stretch at
    the start of a series has no value before it: it stays empty, or starts from ``base``.
    As in a cure plot, ``out`` is set on missing rows and on their known neighbours only.  The
    accumulated profile over a stretch is whole days times the daily total plus a part
    of a day, so a stretch of any length needs no running window.
    """
    profile = harmonic_profile(hourly_change(series, column, block_steps), period)
    v = F.col(column)
    known = F.struct(F.col(STEP).alias("s"), v.alias("v"), F.hour("Time").alias("h"))
    if base is not None:
        # The step before a series begins, as if its value were known.
        first = F.struct((F.min(STEP) - 1).alias("s"), F.pmod(F.min_by(F.hour("Time"), STEP) - 1, F.lit(24)).alias("h"))
        profile = profile.join(series.groupBy(STATION).agg(first.alias("_first")), STATION)
    near = neighbour_rows(
        series,
        previous={"_known": (known, v.isNotNull()), "_before": (F.struct(v.alias("v")), None)},
        following={"_after": (F.struct(v.alias("v")), None)},
        inclusive=("_known",),
        size=block_steps,
    ).join(profile, STATION, "left")
    if base is not None:
        near = near.withColumn(
            "_known",
            F.when(F.col("_known").isNotNull(), F.col("_known")).otherwise(
                F.struct(F.col("_first.s").alias("s"), F.lit(float(base)).alias("v"), F.col("_first.h").alias("h"))
            ),
        )
    gap = F.col(STEP) - F.col("_known.s")
    # Hours h+1 .. h+gap after the last known hour h.
    total = F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)
    part = F.aggregate(
        F.when(F.pmod(gap, F.lit(24)) > 0, F.sequence(F.lit(1).cast("long"), F.pmod(gap, F.lit(24)))),
        F.lit(0.0),
        lambda a, i: a + F.element_at("profile", F.pmod(F.col("_known.h") + i, F.lit(24)).cast("int") + 1),
    )
    moved = F.floor(gap / 24) * total + F.coalesce(part, F.lit(0.0))
    start = F.col("_known.v") if base is None else F.lit(float(base))
    cured = F.when(v.isNull(), start + moved)
    beside = F.col("_before.v").isNull() & F.col("_before").isNotNull() | (
        F.col("_after.v").isNull() & F.col("_after").isNotNull()
    )
    return near.withColumn(out, F.coalesce(cured, F.when(beside, v))).drop(
        "_known", "_first", "_before", "_after", "profile"
    )

