"""Date, time and math functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(d) -> Column:
    return F.trunc(_c(d), "month")


def quarter_start(d) -> Column:
    return F.date_trunc("quarter", _c(d)).cast("date")


def year_start(d) -> Column:
    return F.trunc(_c(d), "year")


def ymd(d) -> Column:
    """Dates leave the engine as ISO text (identical in every engine)."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def temporal_weight(days, max_days) -> Column:
    """D3: log1p(days) / log1p(max days); 0 when the span is empty."""
    return F.coalesce(F.try_divide(F.log1p(_c(days)), F.log1p(_c(max_days))), F.lit(0.0))


def time_encoding(days, d_model: int = 32) -> Column:
    """Sinusoidal encoding; even i -> sin(t * w_k), odd i -> cos(t * w_k),
    w_k = 10000^(-2k/d), k = i // 2."""
    t = _c(days).cast("double")
    scale = -math.log(10000.0) / d_model
    return F.transform(
        F.sequence(F.lit(0), F.lit(d_model - 1)),
        lambda i: F.when(i % 2 == 0, F.sin(t * F.exp((i - i % 2) * F.lit(scale))))
        .otherwise(F.cos(t * F.exp((i - i % 2) * F.lit(scale)))))


def eps_velocity(n, prev, eps: float = 1.0) -> Column:
    """D8."""
    return (_c(n) - _c(prev)) / (_c(prev) + F.lit(eps))


def pct_change(n, prev) -> Column:
    """Growth against the previous present period, no epsilon (null when
    there is no previous period)."""
    return F.try_divide(_c(n) - _c(prev), _c(prev).cast("double"))


def clip(x, lo: float, hi: float) -> Column:
    """D11."""
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def spike_window(peak_date, year) -> Column:
    """Peak within [1 Jan - 6 months, 31 Dec + 6 months] of the year."""
    y = _c(year).cast("int")
    start = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), -6)
    end = F.add_months(F.make_date(y, F.lit(12), F.lit(31)), 6)
    return _c(peak_date).between(start, end)


def purity_band(p) -> Column:
    """D13."""
    return F.when(_c(p) >= 0.6, "high").when(_c(p) >= 0.4, "mid").otherwise("low")
