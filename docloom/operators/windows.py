"""Window operators over a partition in order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(partition: list[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


#: Microseconds of the units that have a fixed length.
_MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}


def range_frame(partition: list[str], order: str, low: float | None, high: float | None, unit: str | None = None) -> WindowSpec:
    """Rows whose ``order`` lies within [low, high] of a row's own, either end open if None; for a date in ``unit``s."""
    at = F.unix_micros(F.col(order).cast("timestamp")) if unit else F.col(order)
    size = _MICROS[unit] if unit else 1
    edge = lambda x, open_: open_ if x is None else int(x * size) if unit else x
    return Window.partitionBy(*partition).orderBy(at).rangeBetween(edge(low, Window.unboundedPreceding), edge(high, Window.unboundedFollowing))


def rank(w: WindowSpec) -> Column:
    return F.rank().over(w)


def dense_rank(w: WindowSpec) -> Column:
    return F.dense_rank().over(w)


def document_number(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def shift(x: str, by: int, w: WindowSpec, default=None) -> Column:
    """The value ``by`` rows on, or back if negative."""
    return (F.lead(x, by, default) if by >= 0 else F.lag(x, -by, default)).over(w)


def locf(x: str, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def covariance_pop(x: str, y: str, w: WindowSpec) -> Column:
    return F.covar_pop(x, y).over(w)


def covariance_samp(x: str, y: str, w: WindowSpec) -> Column:
    return F.covar_samp(x, y).over(w)


def derivative(x: str, at: str, w: WindowSpec, unit: float = 1.0) -> Column:
    """Rate of change since the row before, per ``unit`` of ``at``."""
    return F.try_divide((F.col(x) - F.lag(x).over(w)) * unit, (F.col(at) - F.lag(at).over(w)).cast("double"))


def integral(x: str, at: str, w: WindowSpec, unit: float = 1.0) -> Column:
    """Trapezoids summed up to each row. Needs a column of ``integral_step`` first, as Spark does not nest windows."""
    return F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)) / unit


def integral_step(x: str, at: str, w: WindowSpec) -> Column:
    """The trapezoid between the row before and this one."""
    width = (F.col(at) - F.lag(at).over(w)).cast("double")
    return F.coalesce(width * (F.col(x) + F.lag(x).over(w)) / 2, F.lit(0.0))


def exp_moving_avg(x: str, alpha: float, w: WindowSpec) -> Column:
    """alpha times the value plus (1 - alpha) times the average before it, started by the first value.

    A frame reaches back to where weights fall below 2 ** -53 of the whole, so what is left out changes the average by
    less than a double's rounding does if values are of one size. It has about 37 / alpha rows for a small alpha.
    """
    back = max(1, math.ceil(-53 / math.log2(1 - alpha)) if alpha < 1 else 1)
    values = F.collect_list(F.col(x).cast("double")).over(w.rowsBetween(-back, 0))
    return F.reduce(F.slice(values, 2, 1_000_000), F.element_at(values, 1), lambda a, v: alpha * v + (1 - alpha) * a)
