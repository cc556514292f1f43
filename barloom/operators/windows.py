"""Rolling, expanding and exponentially weighted windows over rows: missing values are skipped, min_periods gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.compiler import Compiler, clean, correlation


class RowWindow:
    """Aggregates of a frame of rows. Methods take a column and give a column, for a projection over one window order."""

    def __init__(self, order: WindowSpec, window: int | None, min_periods: int | None = None, center: bool = False):
        self.order, self.size = order, window
        if window is None:
            self.frame, self.least = order.rowsBetween(Window.unboundedPreceding, 0), 1 if min_periods is None else min_periods
        else:
            back = window // 2 if center else window - 1
            self.frame, self.least = order.rowsBetween(-back, window - 1 - back), window if min_periods is None else min_periods

    def gate(self, x: Column, value: Column, least: int = 0) -> Column:
        return F.when(F.count(x).over(self.frame) >= max(self.least, least), value)

    def _of(self, f, least: int = 1):
        return lambda c: self.gate(clean(c), f(clean(c)).over(self.frame), least)

    def count(self, c: Column) -> Column:
        return F.when(F.count(F.lit(1)).over(self.frame) >= self.least, F.count(clean(c)).over(self.frame))

    def nunique(self, c: Column) -> Column:
        return self.gate(clean(c), F.size(F.collect_set(clean(c)).over(self.frame)))

    def sum(self, c: Column) -> Column:
        return self.gate(clean(c), F.coalesce(F.sum(clean(c)).over(self.frame), F.lit(0.0)))

    def mean(self, c):
        return self._of(F.avg)(c)

    def median(self, c):
        return self._of(lambda x: F.percentile(x, 0.5))(c)

    def min(self, c):
        return self._of(F.min)(c)

    def max(self, c):
        return self._of(F.max)(c)

    def first(self, c):
        return self._of(lambda x: F.first(x, ignorenulls=True))(c)

    def last(self, c):
        return self._of(lambda x: F.last(x, ignorenulls=True))(c)

    def var(self, c: Column, ddof: int = 1) -> Column:
        n = F.count(clean(c)).over(self.frame)
        return self.gate(clean(c), F.when(n > ddof, F.var_pop(clean(c)).over(self.frame) * n / (n - ddof)))

    def std(self, c: Column, ddof: int = 1) -> Column:
        return F.sqrt(self.var(c, ddof))

    def sem(self, c: Column, ddof: int = 1) -> Column:
        return self.std(c, ddof) / F.sqrt(F.count(clean(c)).over(self.frame))

    def skew(self, c: Column) -> Column:
        x = clean(c)
        n, v = F.count(x).over(self.frame), F.var_pop(x).over(self.frame)
        value = F.when(v == 0, 0.0).otherwise(F.skewness(x).over(self.frame) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))
        return self.gate(x, value, 3)

    def kurt(self, c: Column) -> Column:
        x = clean(c)
        n, v = F.count(x).over(self.frame), F.var_pop(x).over(self.frame)
        value = ((n + 1) * F.kurtosis(x).over(self.frame) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
        return self.gate(x, F.when(v == 0, -3.0).otherwise(value), 4)

    def quantile(self, c: Column, q: float, interpolation: str = "linear") -> Column:
        x = clean(c)
        if interpolation == "linear":
            return self.gate(x, F.percentile(x, q).over(self.frame), 1)
        values = F.array_sort(F.collect_list(x).over(self.frame))
        at = (F.size(values) - 1) * F.lit(q)
        low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
        value = {"lower": low, "higher": high, "midpoint": (low + high) / 2, "nearest": F.get(values, F.bround(at).cast("int"))}[interpolation]
        return self.gate(x, value, 1)

    def rank(self, c: Column, method: str = "average", ascending: bool = True, pct: bool = False) -> Column:
        x = clean(c)
        values = F.collect_list(x).over(self.frame)
        x = F.last(x).over(self.frame)  # the newest of the window, which a centred one has after the current row
        sign = 1 if ascending else -1
        less, same = F.size(F.filter(values, lambda v: v * sign < x * sign)), F.size(F.filter(values, lambda v: v == x))
        value = {"min": less + 1, "max": less + same, "average": less + (same + 1) / 2}[method].cast("double")
        return self.gate(x, F.when(x.isNotNull(), value / F.size(values) if pct else value))

    def _pair(self, x: Column, y: Column):
        both = clean(x).isNotNull() & clean(y).isNotNull()
        return F.when(both, clean(x)), F.when(both, clean(y))

    def cov(self, x: Column, y: Column, ddof: int = 1) -> Column:
        x, y = self._pair(x, y)
        n = F.count(x).over(self.frame)
        return self.gate(x, F.when(n > ddof, F.covar_pop(x, y).over(self.frame) * n / (n - ddof)))

    def corr(self, x: Column, y: Column) -> Column:
        x, y = self._pair(x, y)
        return self.gate(x, correlation(x, y, self.frame), 2)


def decay(com: float | None = None, span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    given = [v for v in (com, span, halflife, alpha) if v is not None]
    if len(given) != 1:
        raise ValueError("give one of com, span, halflife and alpha")
    if com is not None:
        return 1 / (1 + com)
    if span is not None:
        return 2 / (span + 1)
    return 1 - math.exp(-math.log(2) / halflife) if halflife is not None else alpha


def ewm(k: Compiler, c: Column, of: str, alpha: float, *, other: Column | None = None, min_periods: int = 0, adjust: bool = True, ignore_na: bool = False, bias: bool = False) -> Column:
    """mean, sum, var, std, cov or corr with weights that fall by alpha a row; a machine of the compiler's ordered pass."""
    out = {"mean": 0, "sum": 0, "var": 2, "std": 2, "cov": 2, "corr": 3}[of]
    if of == "sum" and not adjust:
        raise ValueError("sum needs adjust=True")
    x, y = clean(c), clean(other if other is not None else c)
    x, y = (F.coalesce(v, F.lit(float("nan"))) for v in (x, y))
    name, args, count = ("ewmsum", (alpha, ignore_na), 1) if of == "sum" else ("ewm", (alpha, adjust, ignore_na, bias), 4)
    value, seen = clean(k.machine(name, args, x, y, out=out)), k.machine(name, args, x, y, out=count)
    value = F.when(seen >= min_periods, value)
    return F.sqrt(value) if of == "std" else value


__all__ = ["RowWindow", "decay", "ewm"]
