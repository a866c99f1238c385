"""Elementwise functions and predicates on double columns, with the domain rules of array libraries.

Spark's own functions differ in places: ``least`` skips nulls and loses NaN,
``log`` of a non-positive number is null, division by zero raises under ANSI.
The functions here keep NaN and infinities as array arithmetic does; null means
a missing value and stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def round_even(x, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(_c(x), digits)


def log(x) -> Column:
    """Natural logarithm: -Inf at zero, NaN below."""
    x = _c(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))


def log10(x) -> Column:
    x = _c(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log10(x))


def maximum(a, b) -> Column:
    """The larger value; null if either is null, NaN if either is NaN."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def minimum(a, b) -> Column:
    """The smaller value; null if either is null, NaN if either is NaN."""
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def divide(a, b) -> Column:
    """IEEE division: by zero gives signed infinity, zero by zero NaN."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a / b).when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def nan_to_num(x, fill: float = 0.0) -> Column:
    x = _c(x)
    big = 1.7976931348623157e308
    return F.when(F.isnan(x), F.lit(fill)).when(x == INF, F.lit(big)).when(x == -INF, F.lit(-big)).otherwise(x)


def clip(x, low=None, high=None) -> Column:
    """Bound ``x``; a null bound is no bound."""
    x = _c(x)
    out = x if low is None else F.greatest(x, _c(low))
    out = out if high is None else F.least(out, _c(high))
    return F.when(x.isNotNull(), out)


def is_finite(x) -> Column:
    x = _c(x)
    return ~F.isnan(x) & (F.abs(x) != INF)


def is_close(a, b, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = _c(a), _c(b)
    near = F.abs(a - b) <= atol + rtol * F.abs(b)
    both = F.isnan(a) & F.isnan(b)
    return F.when(F.isnan(a) | F.isnan(b), both if equal_nan else F.lit(False)).otherwise((a == b) | near)


def is_missing(x) -> Column:
    """Null, or NaN for a floating column."""
    return _c(x).isNull() | F.isnan(_c(x))


def nan_to_null(x) -> Column:
    """The load rule of table sources: NaN is missing."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def floor_mod(a, b) -> tuple[Column, Column]:
    """Quotient and remainder with the sign of the divisor; null for a zero divisor."""
    a, b = _c(a), _c(b)
    q = F.floor(F.try_divide(a, b))
    return q, a - b * q


def wrap(x, bits: int, signed: bool = True) -> Column:
    """An integer reduced to ``bits`` bits, as fixed-width arithmetic overflows."""
    x = _c(x).cast("decimal(38,0)")
    u = F.pmod(x, F.lit(2**bits).cast("decimal(38,0)"))
    out = F.when(u >= F.lit(2 ** (bits - 1)).cast("decimal(38,0)"), u - F.lit(2**bits).cast("decimal(38,0)")).otherwise(u) if signed else u
    return out.cast("long" if bits < 64 or signed else "decimal(20,0)")


def saturate(x, bits: int, signed: bool = True) -> Column:
    """An integer bounded to ``bits`` bits."""
    low, high = (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)
    return F.least(F.greatest(_c(x), F.lit(low).cast("long")), F.lit(high).cast("long"))


def rotate_left(x, by: int, bits: int) -> Column:
    """Rotate the lowest ``bits`` < 64 bits of a non-negative integer."""
    x, by = _c(x).cast("long"), by % bits
    mask = F.lit(2**bits - 1)
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, bits - by)).bitwiseAND(mask) if by else x.bitwiseAND(mask)


def bit_field(x, low: int, width: int) -> Column:
    return F.shiftrightunsigned(_c(x).cast("long"), low).bitwiseAND(F.lit(2**width - 1))


def set_bit_field(x, value, low: int, width: int) -> Column:
    mask = (2**width - 1) << low
    return _c(x).cast("long").bitwiseAND(F.lit(~mask)).bitwiseOR(F.shiftleft(_c(value).cast("long").bitwiseAND(F.lit(2**width - 1)), low))


def leading_zeros(x, bits: int = 64) -> Column:
    """Leading zero bits of a non-negative integer below 2**bits."""
    return F.when(_c(x) == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(_c(x).cast("long"))))


def trailing_zeros(x, bits: int = 64) -> Column:
    x = _c(x).cast("long")
    low = x.bitwiseAND(-x)
    return F.when(x == 0, F.lit(bits)).otherwise(F.length(F.bin(low)) - 1)


def classify_float(x) -> Column:
    """NAN, POSITIVE_INFINITY, NEGATIVE_INFINITY, ZERO, SUBNORMAL or NORMAL."""
    x = _c(x)
    return (
        F.when(x.isNull(), F.lit(None))
        .when(F.isnan(x), F.lit("NAN"))
        .when(x == INF, F.lit("POSITIVE_INFINITY"))
        .when(x == -INF, F.lit("NEGATIVE_INFINITY"))
        .when(x == 0, F.lit("ZERO"))
        .when(F.abs(x) < 2.2250738585072014e-308, F.lit("SUBNORMAL"))
        .otherwise(F.lit("NORMAL"))
    )
