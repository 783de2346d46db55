"""Ordered operators that never need a whole series in one task.

A window over ``partitionBy(station)`` would send every row of a station to one
task, which fails when one station holds a large share of the data.  Here a series
is cut into blocks of consecutive order positions.  Look-back and look-ahead by a
fixed distance use a halo of neighbouring rows.  Unbounded look-back (running
totals, previous row, last known value) uses one summary row per block, a window
over those few summaries, and a join back on the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.functions.dates import floor_div
from baroflow.schema import BLOCK, BLOCK_STEPS, STATION, STEP

_EXPLODE_CHUNK = 4096


def block_of(order, size: int) -> Column:
    return floor_div(F.col(order) if isinstance(order, str) else order, size)


def with_block(df: DataFrame, order: str = STEP, size: int = BLOCK_STEPS) -> DataFrame:
    return df.withColumn(BLOCK, block_of(order, size))


def explode_range(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per integer in ``[first, last]``, without ever building a long array."""
    lead = df.withColumn("_hi", last).withColumn(
        "_lo", F.explode(F.when(first <= F.col("_hi"), F.sequence(first, F.col("_hi"), F.lit(_EXPLODE_CHUNK).cast("long"))))
    )
    return lead.withColumn(
        name,
        F.explode(F.sequence("_lo", F.least(F.col("_lo") + (_EXPLODE_CHUNK - 1), F.col("_hi")))),
    ).drop("_lo", "_hi")


def with_halo(
    df: DataFrame,
    before: int,
    after: int,
    order: str = STEP,
    size: int = BLOCK_STEPS,
) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block as well.

    Adds the target block and ``_own`` (true on the row's own block).  Bounded
    frames over ``(station, block)`` are then exact on the owned rows; drop the
    copies afterwards with ``owned``.
    """
    c = F.col(order)
    own = block_of(order, size)
    targets = F.sequence(block_of(c - F.lit(after), size), block_of(c + F.lit(before), size))
    return df.withColumn(BLOCK, F.explode(targets)).withColumn("_own", own == F.col(BLOCK))


def owned(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own")


def block_window(keys: Sequence[str] = (STATION,), order: str = STEP):
    return Window.partitionBy(*keys, BLOCK).orderBy(order)


# -- unbounded look-back in two levels ------------------------------------------


def add_block_offsets(
    df: DataFrame,
    running: Sequence[str],
    keys: Sequence[str] = (STATION,),
    totals: DataFrame | None = None,
) -> DataFrame:
    """Turn per-block running totals into running totals over the whole series.

    ``running`` holds non-decreasing per-block running counts, so their block maximum
    is the block total.  Only one row per block goes through the station window.
    """
    keys = list(keys)
    if totals is None:
        totals = df.groupBy(*keys, BLOCK).agg(*[F.max(c).alias(c) for c in running])
    prior = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, BLOCK, *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"_off_{c}") for c in running]
    )
    out = df.join(offsets, [*keys, BLOCK], "left")
    out = out.withColumns({c: F.col(c) + F.col(f"_off_{c}") for c in running})
    return out.drop(*[f"_off_{c}" for c in running])


def running_count(
    df: DataFrame,
    flags: dict[str, str],
    keys: Sequence[str] = (STATION,),
    order: str = STEP,
    size: int = BLOCK_STEPS,
) -> DataFrame:
    """Running sum of 0/1 flags over each series; ``flags`` maps output to input column."""
    w = block_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = with_block(df, order, size).withColumns(
        {out: F.sum(F.col(src).cast("long")).over(w) for out, src in flags.items()}
    )
    return add_block_offsets(local, list(flags), keys).drop(BLOCK)


def neighbour_rows(
    df: DataFrame,
    previous: dict[str, tuple[Column, Column | None]] | None = None,
    following: dict[str, tuple[Column, Column | None]] | None = None,
    keys: Sequence[str] = (STATION,),
    order: str = STEP,
    size: int = BLOCK_STEPS,
    inclusive: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Nearest earlier / later row of the same series, across block borders.

    Each entry maps an output column to ``(value, condition)``: the value (often a
    struct) of the nearest row where the condition holds, or of any row if it is
    None.  The row itself counts only for names in ``inclusive``.  Rows of equal ``order``
    are ranked by the ``ties`` columns.
    """
    previous, following = previous or {}, following or {}
    keys = list(keys)
    picks = {
        **{n: (F.when(c, v) if c is not None else v, False) for n, (v, c) in previous.items()},
        **{n: (F.when(c, v) if c is not None else v, True) for n, (v, c) in following.items()},
    }
    place = F.struct(order, *ties) if ties else F.col(order)
    base = with_block(df, order, size)
    summary = base.groupBy(*keys, BLOCK).agg(
        *[
            (F.min_by if later else F.max_by)(value, F.when(value.isNotNull(), place)).alias(f"_carry_{n}")
            for n, (value, later) in picks.items()
        ]
    )
    station_back = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    station_ahead = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys,
        BLOCK,
        *[
            F.last(F.col(f"_carry_{n}"), ignorenulls=True)
            .over(station_ahead if later else station_back)
            .alias(f"_carry_{n}")
            for n, (_, later) in picks.items()
        ],
    )
    back = Window.partitionBy(*keys, BLOCK).orderBy(order, *ties)
    ahead = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(order), *[F.desc(t) for t in ties])
    joined = base.join(carry, [*keys, BLOCK], "left")
    # Same ordering next to same ordering, so that each direction is sorted once.
    for names, w in ((previous, back), (following, ahead)):
        joined = joined.withColumns(
            {
                n: F.coalesce(
                    F.last(picks[n][0], ignorenulls=True).over(
                        w.rowsBetween(Window.unboundedPreceding, 0 if n in inclusive else -1)
                    ),
                    F.col(f"_carry_{n}"),
                )
                for n in names
            }
        )
    return joined.drop(BLOCK, *[f"_carry_{n}" for n in picks])
