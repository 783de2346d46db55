"""Binning and case labels."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from baroflow.functions.nulls import _col

# Season, band and label texts.
SEASONS = ["Spring (MAM)", "Summer (JJA)", "Fall (SON)"]
WINTER = "Winter (DJF)"
EPC_EDGES_300 = [-2000, -300, 0, 300, 2000]
EPC_EDGES_500 = [-2000, -500, 0, 500, 2000]
GAP_EDGES = [0, 1, 6, 24, float("inf")]


def round_step(x, step: float = 1.0) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.rint(_col(x) / float(step)) * float(step) + 0.0


def floor_step(x, step: float = 1.0) -> Column:
    """Largest multiple of ``step`` not above ``x``."""
    return F.floor(_col(x) / float(step)) * float(step) + 0.0


def log_step(x, step: float = 0.5) -> Column:
    """Floor-to-step bin of the natural logarithm; NULL unless ``x`` is positive."""
    c = _col(x)
    return F.when(c > 0, floor_step(F.log(c), step))


def ceil_cut(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed intervals ``(a, b]``; NULL outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval expected")
    c = _col(x)
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = c > F.lit(lo)
        if hi != float("inf"):
            cond = cond & (c <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def epc_band(x, edges: Sequence[int] = EPC_EDGES_300) -> Column:
    labels = [f"{a} hPa ~ {b} hPa" for a, b in zip(edges[:-1], edges[1:])]
    return ceil_cut(x, edges, labels)


def month_season(month) -> Column:
    return F.coalesce(ceil_cut(month, [2, 5, 8, 11], SEASONS), F.lit(WINTER))


def wet_dry(month, first: int = 6, last: int = 10) -> Column:
    return F.when(_col(month).between(first, last), F.lit("wet")).otherwise(F.lit("dry"))


def half_year(month, labels: Sequence[str] = ("Jan ~ Jun", "Jul ~ Dec")) -> Column:
    return F.when(_col(month) < 7, F.lit(labels[0])).otherwise(F.lit(labels[1]))


def pce_type(epc) -> Column:
    c = _col(epc)
    return F.when(c < 0, F.lit("DePCE")).when(c.isNotNull(), F.lit("InPCE"))
