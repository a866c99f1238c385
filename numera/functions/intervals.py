"""Interval arithmetic on struct<lo, hi> columns of doubles, rounded outward; null is unresolved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _down(x: Column) -> Column:
    """A double not above the neighbour below ``x``: one part in 2**52 off, and the least subnormal."""
    return x - F.abs(x) * F.lit(2.0**-52) - F.lit(5e-324)


def _up(x: Column) -> Column:
    return x + F.abs(x) * F.lit(2.0**-52) + F.lit(5e-324)


def interval(lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def _outward(lo: Column, hi: Column) -> Column:
    return F.struct(_down(lo).alias("lo"), _up(hi).alias("hi"))


def add(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _outward(a["lo"] + b["lo"], a["hi"] + b["hi"]))


def subtract(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), _outward(a["lo"] - b["hi"], a["hi"] - b["lo"]))


def negate(a: Column) -> Column:
    return F.when(a.isNotNull(), F.struct((-a["hi"]).alias("lo"), (-a["lo"]).alias("hi")))


def multiply(a: Column, b: Column) -> Column:
    p = [a[x] * b[y] for x in ("lo", "hi") for y in ("lo", "hi")]
    return F.when(a.isNotNull() & b.isNotNull(), _outward(F.least(*p), F.greatest(*p)))


def contains_zero(a: Column) -> Column:
    return (a["lo"] <= 0) & (a["hi"] >= 0)


def divide(a: Column, b: Column) -> Column:
    """Unresolved if the divisor contains zero."""
    safe = a.isNotNull() & b.isNotNull() & ~contains_zero(b)
    p = [F.try_divide(a[x], b[y]) for x in ("lo", "hi") for y in ("lo", "hi")]
    return F.when(safe, _outward(F.least(*p), F.greatest(*p)))


def power(a: Column, n: int) -> Column:
    """Integer powers; even powers reach down to zero where the interval holds it."""
    if n == 0:
        return F.when(a.isNotNull(), interval(1, 1))
    if n < 0:
        return divide(interval(1, 1), power(a, -n))
    lo, hi = F.pow(a["lo"], F.lit(float(n))), F.pow(a["hi"], F.lit(float(n)))
    if n % 2:
        return F.when(a.isNotNull(), _outward(lo, hi))
    return F.when(a.isNotNull(), F.when(contains_zero(a), F.struct(F.lit(0.0).alias("lo"), _up(F.greatest(lo, hi)).alias("hi"))).otherwise(_outward(F.least(lo, hi), F.greatest(lo, hi))))


def absolute(a: Column) -> Column:
    lo, hi = F.least(F.abs(a["lo"]), F.abs(a["hi"])), F.greatest(F.abs(a["lo"]), F.abs(a["hi"]))
    return F.when(a.isNotNull(), F.struct(F.when(contains_zero(a), F.lit(0.0)).otherwise(lo).alias("lo"), hi.alias("hi")))


def sqrt(a: Column) -> Column:
    return F.when(a["lo"] >= 0, F.struct(F.greatest(_down(F.sqrt(F.greatest(a["lo"], F.lit(0.0)))), F.lit(0.0)).alias("lo"), _up(F.sqrt(F.greatest(a["hi"], F.lit(0.0)))).alias("hi")))


def log(a: Column) -> Column:
    return F.when(a["lo"] > 0, _outward(F.log(a["lo"]), F.log(a["hi"])))


def exp(a: Column) -> Column:
    return F.when(a["hi"] < 709, _outward(F.exp(a["lo"]), F.exp(a["hi"])))


def _wave(a: Column, f, top: float) -> Column:
    """sin or cos: one over a period whose maximum lies at ``top``."""
    turn = 6.283185307179586
    holds = lambda at: F.ceil((a["lo"] - at) / turn) * turn + at <= a["hi"]
    lo, hi = F.least(f(a["lo"]), f(a["hi"])), F.greatest(f(a["lo"]), f(a["hi"]))
    return F.when(
        a.isNotNull(),
        F.struct(F.when(holds(top + turn / 2), F.lit(-1.0)).otherwise(F.greatest(_down(lo), F.lit(-1.0))).alias("lo"), F.when(holds(top), F.lit(1.0)).otherwise(F.least(_up(hi), F.lit(1.0))).alias("hi")),
    )


def sin(a: Column) -> Column:
    return _wave(a, F.sin, 1.5707963267948966)


def cos(a: Column) -> Column:
    return _wave(a, F.cos, 0.0)


def hull(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi")))


def compare(a: Column, op: str, b: float) -> Column:
    """Branch status of ``a op b`` for op in <, <=, >, >=: ALWAYS_TRUE, ALWAYS_FALSE, SPLIT or UNRESOLVED."""
    c = F.lit(float(b))
    yes, no = {"<": (a["hi"] < c, a["lo"] >= c), "<=": (a["hi"] <= c, a["lo"] > c), ">": (a["lo"] > c, a["hi"] <= c), ">=": (a["lo"] >= c, a["hi"] < c)}[op]
    return F.when(a.isNull(), "UNRESOLVED").when(yes, "ALWAYS_TRUE").when(no, "ALWAYS_FALSE").otherwise("SPLIT")


def sum_bound(a: Column, n: Column) -> Column:
    """The range of a sum of n values of ``a``."""
    return F.when(a.isNotNull() & (n >= 0), _outward(a["lo"] * n, a["hi"] * n))
