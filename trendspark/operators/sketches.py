"""Mergeable sketches kept as plain rows: pure functions of the rows they stand for.

A profile of new days is computed from the new days only and added to what is
known: quantile sketches by adding counts, distinct counts by taking maxima. Both give
the same rows for the same data in any order, partitioning and grouping into days.

* Quantiles: counts of values per logarithmic bucket; a quantile is off by ``error`` of its
  value at most (default 0.5 %).
* Distinct counts: the highest rank (position of the first set bit) of the values' 64-bit
  hashes in each of 2^bits registers (HyperLogLog); the standard error is 1.04 / sqrt(2^bits),
  1.6 % at 12 bits, and small counts are corrected by linear counting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.005
BITS = 12


# ---------------------------------------------------------------- quantiles

def _growth(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def bucket(value: Column, error: float = ERROR) -> Column:
    """Bucket of a value's magnitude: 0 for 0, else k with growth^(k-1) < |value| <= growth^k."""
    k = F.ceil(F.log(F.abs(value)) / _growth(error))
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(k)


def quantile_sketch(df: DataFrame, keys: list[str], value: str, error: float = ERROR) -> DataFrame:
    """(keys, sign, bucket, n) of the values that are not null."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).select(*keys, F.signum(v).cast("int").alias("sign"), bucket(v, error).alias("bucket")) \
        .groupBy(*keys, "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles_of(sketch: DataFrame, keys: list[str], ranks: dict[str, float], error: float = ERROR) -> DataFrame:
    """(keys, total, and a column for each of ``ranks``): the value of the bucket that holds the row of
    rank ceil(p * total). A window orders one sketch's buckets, some thousand at most."""
    within = Window.partitionBy(*keys)
    value = F.col("sign") * (1 - error) * F.exp(F.col("bucket") * _growth(error))
    order = within.orderBy("sign", F.col("sign") * F.col("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = merged_quantiles(sketch, keys).select("*", F.sum("n").over(order).alias("upto"), F.sum("n").over(within).alias("total"))
    first = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(p) * F.col("total")), F.lit(1)), F.struct("upto", value.alias("v"))))
    return upto.groupBy(*keys).agg(F.max("total").alias("total"), *[first(p)["v"].alias(name) for name, p in ranks.items()])


# ---------------------------------------------------------------- distinct counts

def distinct_sketch(df: DataFrame, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(keys, register, rank) of the values that are not null."""
    h = F.xxhash64(F.col(value))
    rest = F.shiftrightunsigned(h, bits)  # 64 - bits bits
    # place of the rest's first set bit, counted from 1 at the top
    rank = F.when(rest == 0, 64 - bits + 1).otherwise(64 - bits + 1 - F.length(F.bin(rest))).cast("int")
    return df.where(F.col(value).isNotNull()).select(*keys, h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("register"), rank.alias("rank")) \
        .groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def merged_distinct(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def distinct_of(sketch: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """(keys, distinct): the estimated number of different values, a whole number."""
    m = 1 << bits
    sums = merged_distinct(sketch, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse"))
    empty = m - F.col("used")
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (F.col("inverse") + empty)
    linear = m * F.log(m / empty)
    return sums.select(*keys, F.round(F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw)).cast("long").alias("distinct"))
