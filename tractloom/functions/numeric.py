"""Small numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def rnd(c: Column, places: int = 6) -> Column:
    """Half-to-even rounding of a double by scaling, free of negative zero."""
    m = lit(10.0 ** places)
    return F.rint(c * m) / m + lit(0.0)


def ratio(num: Column, den: Column, otherwise: Column | float | None) -> Column:
    """num/den, or ``otherwise`` where den is 0 (NULL when ``otherwise`` is None)."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double")
    return F.when(den == 0, other).otherwise(F.try_divide(num.cast("double"), den.cast("double")))


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def finite_or_zero(c: Column) -> Column:
    """NaN and both infinities become 0.0."""
    return F.when(F.isnan(c) | (F.abs(c) == lit(float("inf"))), lit(0.0)).otherwise(c)
