"""Dense vector expressions on array<float|double> columns (JVM-side)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _per_row(v, s) -> Column:
    """A per-row scalar as an array aligned with ``v``: evaluated once per
    row (a scalar referenced inside a lambda is re-evaluated per element)."""
    return F.array_repeat(s, F.size(_c(v)))


def unit(v) -> Column:
    """V / ||v||; a zero vector stays zero. The norm is computed once per
    row and zipped in."""
    vd = as_double(v)
    return F.zip_with(vd, _per_row(vd, norm(vd)), lambda x, n: F.when(n == 0, x).otherwise(x / n))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """D10."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, s) -> Column:
    return F.zip_with(_c(a), _per_row(a, s), lambda x, k: x * k)


def md5_uniform(*parts) -> Column:
    """Uniform (0, 1) from md5 of the parts joined by ':' — the same value in
    any engine with md5, and stable under repartitioning."""
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / float(2 ** 32)


def gaussian(*parts) -> Column:
    """Standard normal by Box-Muller on two md5 uniforms."""
    u1 = md5_uniform(*parts, "u1")
    u2 = md5_uniform(*parts, "u2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
