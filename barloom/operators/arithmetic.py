"""Operators between columns: IEEE division, comparisons that are never missing, Kleene logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _whole(f: Callable[[Column], Column], c: Column) -> Column:
    c = c.cast("double")
    return F.when(F.abs(c) < 2.0**52, f(c).cast("double")).otherwise(c)


def floor(c: Column) -> Column:
    """The floor as a float: NaN, the infinities and floats too large for a fraction stay, where Spark's own makes longs of them."""
    return _whole(F.floor, c)


def ceil(c: Column) -> Column:
    return _whole(F.ceil, c)


def logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """IEEE: the logarithm of 0 is -infinity and that of a number below is NaN, where Spark's own are missing."""
    return lambda c: F.when(c == 0, F.lit(-INF)).when(c < 0, F.lit(float("nan"))).otherwise(f(c))


def true_divide(a: Column, b: Column) -> Column:
    """a / b as floats: x / 0 is an infinity, 0 / 0 is NaN, missing stays missing."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def floor_divide(a: Column, b: Column) -> Column:
    """The floor of a / b, always as a float, since a column's type cannot depend on its values."""
    a, b = a.cast("double"), b.cast("double")
    whole = F.try_divide(a, b)
    return F.when(b == 0, true_divide(a, b)).otherwise(F.when(F.abs(whole) < INF, F.floor(whole).cast("double")).otherwise(whole))


def compare(op: str, a: Column, b: Column) -> Column:
    """A truth that is never missing: with a missing side, != is true and the others are false."""
    a_nan, b_nan = a.isNull() | F.isnan(a.cast("double")), b.isNull() | F.isnan(b.cast("double"))
    made = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.when(a_nan | b_nan, F.lit(op == "!=")).otherwise(made)


def xor(a: Column, b: Column) -> Column:
    return a != b


def between(c: Column, low, high, inclusive: str = "both") -> Column:
    left = compare(">=" if inclusive in ("both", "left") else ">", c, F.lit(low))
    return left & compare("<=" if inclusive in ("both", "right") else "<", c, F.lit(high))
