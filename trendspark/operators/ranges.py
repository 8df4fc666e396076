"""Interval join by time bins: points against the windows they lie in.

Each window is filed under every bin it meets, each point under its own bin, and
the two are joined on keys and bin with the exact bounds as a filter. A pair meets in
one bin only, so it comes once; a hot key is spread over its bins. Neither
side is broadcast. With bins about as long as a window, a window has two or three
copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(windows: DataFrame, points: DataFrame, keys: list[str], start: str, end: str, at: str,
                  bin_days: int = 180, how: str = "inner") -> DataFrame:
    """Pairs of ``windows`` (keys, start, end: dates, end excluded) and ``points`` (keys, at) of equal
    keys with start <= at < end; ``how`` "left_semi": the windows that hold a point, once each.
    Null dates and keys match nothing; an empty or reversed window holds nothing. Other columns must
    have different names on the two sides."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    of = lambda d: F.floor(d / bin_days)
    filed = windows.where(F.col(start) < F.col(end)).withColumn(
        "_bin", F.explode(F.sequence(of(day(F.col(start))), of(day(F.col(end)) - 1))))
    placed = points.where(F.col(at).isNotNull()).withColumn("_bin", of(day(F.col(at))))
    if how == "left_semi":
        placed = placed.select(*keys, "_bin", F.col(at).alias("_at"))
        inside = [filed[k] == placed[k] for k in [*keys, "_bin"]] + [placed["_at"] >= filed[start], placed["_at"] < filed[end]]
        test = inside[0]
        for c in inside[1:]:
            test = test & c
        return filed.join(placed, test, "left_semi").drop("_bin").distinct()
    return filed.join(placed, [*keys, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")
