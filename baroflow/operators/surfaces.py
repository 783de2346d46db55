"""Local regression surfaces, fitted at few vertices and interpolated in between.

How many fits are made depends on the bandwidth alone: a rectangle's sides are halved until
they are short against the bandwidth along them. Value, slopes and twist of the local
polynomials at the corners give a bicubic piece on every rectangle. Rows are read twice for
the radii: once into cells, from whose counts each radius is bracketed, and once to place it
within its bracket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from baroflow.functions.numerics import cubic_coefficients
from baroflow.plans.staging import stage

CELLS = 64  # per axis and group, for the brackets
_SUB_BINS = 65536
_PAIRS_PER_PART = 2_000_000
_MOST_PARTS = 8192
_MOST_HALVINGS = 12


def _bandwidth(cells: np.ndarray, need: float) -> Callable:
    """Estimate, lower or upper bound of the distance to the ``need``-th nearest row.

    ``cells`` has the rows ``x0, x1, y0, y1, n``.
    """
    x0, x1, y0, y1, n = cells

    def reach(distance: Callable, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i, (x, y) in enumerate(at):
            d = distance(x, y)
            order = np.argsort(d)
            out[i] = d[order[np.searchsorted(np.cumsum(n[order]), need - 1e-9)]]
        return out

    def bounds(at: np.ndarray, kind: str) -> np.ndarray:
        distance = {
            "estimate": lambda x, y: np.hypot((x0 + x1) / 2 - x, (y0 + y1) / 2 - y),
            "low": lambda x, y: np.hypot(np.maximum(np.maximum(x0 - x, x - x1), 0), np.maximum(np.maximum(y0 - y, y - y1), 0)),
            "high": lambda x, y: np.hypot(np.maximum(x - x0, x1 - x), np.maximum(y - y0, y1 - y)),
        }
        return reach(distance[kind], at)

    return bounds


def _breaks(axis: int, first: float, last: float, other: np.ndarray, bounds: Callable, cut: float) -> list[float]:
    """Ends of the intervals after halving those longer than ``cut`` bandwidths."""

    def width(v: float) -> float:
        at = np.stack([np.full(len(other), v), other] if axis == 0 else [other, np.full(len(other), v)], 1)
        return float(bounds(at, "estimate").min())

    known = {first: width(first), last: width(last)}
    out, waiting = [first], [(first, last, 0)]
    while waiting:
        a, b, depth = waiting.pop()
        if b - a > cut * min(known[a], known[b]) and depth < _MOST_HALVINGS:
            mid = (a + b) / 2
            known[mid] = width(mid)
            waiting += [(mid, b, depth + 1), (a, mid, depth + 1)]
        else:
            out.append(b)
    return out


def hermite(breaks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that turn values and slopes at the breaks into values at ``at``."""
    j = np.clip(np.searchsorted(breaks, at, "right") - 1, 0, max(len(breaks) - 2, 0))
    value, slope, rows = np.zeros((len(at), len(breaks))), np.zeros((len(at), len(breaks))), np.arange(len(at))
    if len(breaks) == 1:
        value[:, 0], slope[:, 0] = 1.0, at - breaks[0]
        return value, slope
    h = breaks[j + 1] - breaks[j]
    t = (at - breaks[j]) / h
    value[rows, j], value[rows, j + 1] = (1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)
    slope[rows, j], slope[rows, j + 1] = h * t * (1 - t) ** 2, h * t * t * (t - 1)
    return value, slope


def _slopes(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Slopes at ``at`` of the cubic splines through the columns of ``values``."""
    return np.stack([cubic_coefficients(at, column)[0] for column in values.T], 1)


def local_surfaces(
    points: DataFrame,
    predictors: Sequence[str],
    response: str,
    axes: Sequence[tuple[float, float, float]],
    by: Sequence[str] = (),
    alpha: float = 0.7,
    cut: float = 0.15,
) -> DataFrame:
    """Locally weighted quadratics of two predictors on a grid, for all groups in one plan.

    ``axes`` are ``(first, last, step)``. Weights are tricube within the distance to the
    ``floor(alpha * n)``-th nearest row, in the units of the predictors. The number of fits
    does not depend on the grid's steps. Returns ``by``, the predictors and ``fit``.

    Rows with a missing predictor or response do not count; a null group is a group; an
    empty table has no rows. No group is gathered in one task: Python gets at most
    ``CELLS ** 2`` counts, or the vertices, of a group.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("one"))
    known = points.select(
        key.alias("k"), *[F.col(c).cast("double").alias(v) for c, v in zip(predictors, "xy")], F.col(response).cast("double").alias("z")
    ).dropna(subset=["x", "y", "z"])
    values = stage(known.groupBy("k", "x", "y").agg(F.count("*").alias("n"), F.sum("z").alias("sz")), "values")
    kind = values.schema["k"].dataType.simpleString()
    to_json = F.to_json(F.struct("k"), {"ignoreNullFields": "false"}).alias("key")
    from_json = F.from_json("key", f"k {kind}")["k"]
    ends = values.groupBy("k").agg(
        *[f(v).alias(f"{f.__name__}_{v}") for v in "xy" for f in (F.min, F.max)], F.sum("n").alias("total")
    )

    def cell(v: str):
        span = F.nullif(F.col(f"max_{v}") - F.col(f"min_{v}"), F.lit(0.0))
        return F.coalesce(F.least(F.floor((F.col(v) - F.col(f"min_{v}")) / span * CELLS), F.lit(CELLS - 1)), F.lit(0)).cast("int")

    counts = values.join(ends, "k").groupBy("k", *[c for c in ends.columns if c != "k"], cell("x").alias("i"), cell("y").alias("j")).agg(
        F.sum("n").alias("n")
    )
    tables = counts.groupBy("k", *[c for c in ends.columns if c != "k"]).agg(F.collect_list(F.struct("i", "j", "n")).alias("cells"))
    lines = [np.arange(int(math.floor((b - a) / s + 1e-9)) + 1) * s + a for a, b, s in axes]

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                i, j, n = (np.array([c[name] for c in row.cells]) for name in "ijn")
                dx, dy = (row.max_x - row.min_x) / CELLS, (row.max_y - row.min_y) / CELLS
                slack = 1e-9 * (abs(row.max_x) + abs(row.min_x) + abs(row.max_y) + abs(row.min_y))
                x0, y0 = row.min_x + i * dx - slack, row.min_y + j * dy - slack
                need = max(1, math.floor(alpha * row.total + 1e-9))
                bounds = _bandwidth(np.stack([x0, x0 + dx + 2 * slack, y0, y0 + dy + 2 * slack, n]), need)
                across = [np.linspace(line[0], line[-1], 5) for line in lines]
                breaks = [
                    _breaks(axis, float(lines[axis][0]), float(lines[axis][-1]), across[1 - axis], bounds, cut)
                    if len(lines[axis]) > 1 else [float(lines[axis][0])]
                    for axis in (0, 1)
                ]
                at = np.array([(a, b) for a in breaks[0] for b in breaks[1]])
                low, high = bounds(at, "low"), bounds(at, "high")
                box = [("x", row.min_x, row.max_x), ("y", row.min_y, row.max_y)]
                yield pd.DataFrame({"key": row.key, "e": np.arange(len(at)), "ax": at[:, 0], "ay": at[:, 1], "low": low, "high": high, "need": need,
                                    **{f"c{v}": (b + a) / 2 for v, a, b in box}, **{f"h{v}": (b - a) / 2 or 1.0 for v, a, b in box}})

    flat = tables.select(to_json, *[c for c in tables.columns if c != "k"])
    at = flat.mapInPandas(vertices, "key string, e long, ax double, ay double, low double, high double, need long, cx double, cy double, hx double, hy double")
    at = stage(at.withColumn("k", from_json).drop("key"), "vertices")
    # As many parts as the pairs call for, not as the few bytes of the values would.
    salts = min(max(1, -(-values.count() * at.count() // _PAIRS_PER_PART)), _MOST_PARTS)
    salted = values.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(salts))).repartition(salts, "salt")

    def pairs(vertex: DataFrame) -> DataFrame:
        copies = vertex.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        dx, dy = F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
        return salted.join(copies, ["k", "salt"]).withColumn("d", F.sqrt(dx * dx + dy * dy))

    share = (F.col("d") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * _SUB_BINS
    sub = F.when(F.col("d") < F.col("low"), F.lit(-1)).otherwise(F.coalesce(F.floor(share), F.lit(0)))
    place = ["k", "e", "ax", "ay", "cx", "cy", "hx", "hy"]
    fine = pairs(at).where(F.col("d") <= F.col("high")).groupBy(*place, "need", sub.alias("sub")).agg(
        F.sum("n").alias("n"), F.max("d").alias("d")
    )
    fine = fine.withColumn("cum", F.sum("n").over(Window.partitionBy("k", "e").orderBy("sub"))).where("cum >= need")
    radii = stage(fine.groupBy(*place).agg(F.min(F.struct("sub", "d"))["d"].alias("r")), "radii")
    r = F.nullif("r", F.lit(0.0))
    w = F.pow(1 - F.coalesce(F.pow(F.col("d") / r, F.lit(3.0)), F.lit(0.0)), F.lit(3.0))
    near = pairs(radii).where("d < r OR d = 0").select(
        *place, "n", "sz", w.alias("w"), *[((F.col(v) - F.col(f"c{v}")) / F.col(f"h{v}")).alias(u) for v, u in zip("xy", "uv")]
    )
    power = {p: F.lit(1.0) for p in [(0, 0)]}
    moments = [(a, b) for a in range(5) for b in range(5 - a)]
    for a, b in moments[1:]:
        power[a, b] = power[a, b - 1] * F.col("v") if b else power[a - 1, b] * F.col("u")
    basis = [(0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)]
    sums = [F.sum(F.col("n") * F.col("w") * power[p]).alias(f"s{p[0]}{p[1]}") for p in moments]
    sums += [F.sum(F.col("sz") * F.col("w") * power[p]).alias(f"t{p[0]}{p[1]}") for p in basis]
    totals = near.groupBy(*place).agg(*sums)
    listed = totals.groupBy("k").agg(F.collect_list(F.struct(*[c for c in totals.columns if c != "k"])).alias("vertices"))

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, rows in zip(pdf["key"], pdf["vertices"]):
                v = pd.DataFrame([dict(zip(row, row.values())) if isinstance(row, dict) else row.asDict() for row in rows]).sort_values("e")
                m = np.stack([np.stack([v[f"s{p[0] + q[0]}{p[1] + q[1]}"] for q in basis], 1) for p in basis], 1)
                t = np.stack([v[f"t{p[0]}{p[1]}"] for p in basis], 1)
                beta = np.einsum("gij,gj->gi", np.linalg.pinv(m, rcond=1e-12, hermitian=True), t)
                hx, hy = v["hx"].to_numpy(), v["hy"].to_numpy()
                ux, uy = (v["ax"].to_numpy() - v["cx"]) / hx, (v["ay"].to_numpy() - v["cy"]) / hy
                b0, b1, b2, b11, b12, b22 = beta.T
                local = [
                    b0 + b1 * ux + b2 * uy + b11 * ux * ux + b12 * ux * uy + b22 * uy * uy,
                    (b1 + 2 * b11 * ux + b12 * uy) / hx, (b2 + b12 * ux + 2 * b22 * uy) / hy, b12 / (hx * hy),
                ]
                breaks = [np.unique(v["ax"]), np.unique(v["ay"])]
                shape = (len(breaks[0]), len(breaks[1]))
                f, fx, fy, fxy = (np.asarray(c).reshape(shape) for c in local)
                # Local slopes are not quite those of the fit; along enough vertices its own are better known.
                if shape[0] > 3:
                    fx, fxy = _slopes(breaks[0], f), _slopes(breaks[0], fy)
                if shape[1] > 3:
                    fy, fxy = _slopes(breaks[1], f.T).T, _slopes(breaks[1], fx.T).T
                vx, sx = hermite(breaks[0], lines[0])
                vy, sy = hermite(breaks[1], lines[1])
                fit = vx @ f @ vy.T + sx @ fx @ vy.T + vx @ fy @ sy.T + sx @ fxy @ sy.T
                yield pd.DataFrame(
                    {"key": key, "x": np.repeat(lines[0], len(lines[1])), "y": np.tile(lines[1], len(lines[0])), "fit": fit.ravel()}
                )

    out = listed.select(to_json, "vertices").mapInPandas(evaluate, "key string, x double, y double, fit double").withColumn("k", from_json)
    return out.select(*[F.col("k")[c].alias(c) for c in by], F.col("x").alias(predictors[0]), F.col("y").alias(predictors[1]), "fit")
