"""Missing-value and rounding rules.  Missing is always SQL NULL, never NaN."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    """Cast to double with NaN turned into NULL."""
    c = _col(x).cast("double")
    return F.when(~F.isnan(c), c)


def _strict(agg, x) -> Column:
    c = _col(x)
    return F.when(F.count_if(c.isNull()) == 0, agg(c))


def strict_sum(x) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return _strict(F.sum, x)


def strict_avg(x) -> Column:
    return _strict(F.avg, x)


def strict_max(x) -> Column:
    return _strict(F.max, x)


def strict_min(x) -> Column:
    return _strict(F.min, x)


def snap(x, digits: int = 9) -> Column:
    """Round half to even at ``digits`` places and drop a negative zero.

    Floating sums depend on the order in which tasks are combined.  Sign tests,
    zero tests and bin edges are taken on snapped values, so that labels and bins
    do not change with the partitioning.
    """
    scale = float(10**digits)
    return F.rint(_col(x) * scale) / scale + F.lit(0.0)


def safe_ratio(num, den, at_zero=None) -> Column:
    """``num / den``; division by zero follows IEEE (signed infinity, 0/0 missing)."""
    n, d = _col(num), _col(den)
    if at_zero is not None:
        return F.when(d == 0, F.lit(at_zero)).otherwise(n / d)
    return (
        F.when(d != 0, n / d)
        .when(n > 0, F.lit(float("inf")))
        .when(n < 0, F.lit(float("-inf")))
    )
