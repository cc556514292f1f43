"""BarFrame: rows of one or many series with an explicit order, and the operators on them.

Every method describes a plan; only methods that say so run one. Missing is NULL; NaN and the infinities are read as
missing by indicators and reductions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import candles, machines, native  # noqa: F401  they register the commands
from ..plans import compiler as plans
from ..plans.compiler import Compiler, clean, correlation
from . import arithmetic as A
from . import timeframes
from .windows import RowWindow, decay, ewm

NUMBERS = ("byte", "short", "integer", "long", "float", "double")
MATH = {n: getattr(F, n) for n in "acos asin atan cos cosh exp sin sinh sqrt tan tanh".split()} | {"ceil": A.ceil, "floor": A.floor, "ln": A.logarithm(F.ln), "log10": A.logarithm(F.log10)}


@dataclass(frozen=True)
class BarFrame:
    """df's rows, in series by key (none: one series), ordered by ts and tiebreak. tz is the zone of instants."""

    df: DataFrame
    key: tuple[str, ...] = ()
    ts: str = "ts"
    tiebreak: tuple[str, ...] = ()
    tz: str | None = None
    computed: tuple[str, ...] = ()

    # Order and metadata

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tiebreak]

    @property
    def w(self):
        return Window.partitionBy(*self.key).orderBy(*self.order)

    @property
    def whole(self):
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return self.df.dtypes

    @property
    def numeric(self) -> list[str]:
        return [f.name for f in self.df.schema if f.dataType.typeName() in NUMBERS and f.name not in (*self.key, *self.tiebreak)]

    @property
    def shape(self) -> tuple[int, int]:
        """Counts the rows."""
        return self.df.count(), len(self.columns)

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, name: str) -> bool:
        return name in self.columns

    def __iter__(self):
        return iter(self.columns)

    def __bool__(self) -> bool:
        raise ValueError("the truth of a frame is not defined")

    def over(self, df: DataFrame, **changes) -> BarFrame:
        return replace(self, df=df, **changes)

    def is_computed(self, name: str) -> bool:
        return plans.stringify(name, self.columns) in self.computed

    def fulfill(self) -> BarFrame:
        """Plans are always fresh; nothing is stale."""
        return self

    # Directives and projections

    def indicators(self, directives: Mapping[str, str] | Sequence[str]) -> BarFrame:
        """The frame with a column for each directive."""
        named = dict(directives) if isinstance(directives, Mapping) else {plans.stringify(d, self.columns): d for d in directives}
        return self.over(plans.evaluate(self.df, named, self.key, self.order), computed=(*self.computed, *named))

    def exec(self, directive: str, name: str = "value") -> DataFrame:
        """Key, order and the directive's value."""
        return plans.evaluate(self.df, {name: directive}, self.key, self.order).select(*self.key, *self.order, F.col(f"`{name}`"))

    def __getitem__(self, item):
        """A column or directive by text, several by list, rows by a truth column or a slice of positions."""
        if isinstance(item, str):
            return self.df.select(*self.key, *self.order, item) if item in self.columns else self.exec(item, plans.stringify(item, self.columns))
        if isinstance(item, list):
            made = self.indicators([x for x in item if x not in self.columns])
            wanted = dict.fromkeys([*self.key, *self.order, *(x if x in self.columns else plans.stringify(x, self.columns) for x in item)])
            return self.over(made.df.select(*(F.col(f"`{c}`") for c in wanted)))
        if isinstance(item, slice):
            return self.iloc(item)
        return self.filter(item)

    def get_column(self, name: str) -> DataFrame:
        if name not in self.columns:
            raise KeyError(name)
        return self.df.select(*self.key, *self.order, name)

    def filter(self, mask: Column) -> BarFrame:
        """Rows where the mask is true; a missing truth raises when it is read."""
        checked = F.when(mask.isNull(), F.raise_error(F.lit("the mask has a missing truth"))).otherwise(mask)
        return self.over(self.df.filter(checked))

    def positions(self, name: str = "_position") -> DataFrame:
        return self.df.withColumn(name, F.row_number().over(self.w) - 1)

    def iloc(self, item: int | slice | Sequence[int]) -> BarFrame:
        """Rows by position in their series; negative positions count from the end."""
        rows = self.positions().withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*self.key)))

        def at(v: int) -> Column:
            return F.lit(v) if v >= 0 else F.col("_size") + v

        if isinstance(item, slice):
            test = F.col("_position") >= at(item.start or 0)
            test = test & (F.col("_position") < at(item.stop)) if item.stop is not None else test
            if item.step not in (None, 1):
                test = test & (F.pmod(F.col("_position") - F.greatest(at(item.start or 0), F.lit(0)), F.lit(item.step)) == 0)
        else:
            test = F.lit(False)
            for v in [item] if isinstance(item, int) else item:
                test = test | (F.col("_position") == at(v))
        return self.over(rows.filter(test).drop("_position", "_size"))

    def loc(self, start=None, stop=None) -> BarFrame:
        """Rows whose ts is between two labels, both included; one label alone is an exact one."""
        if stop is None and start is not None:
            return self.over(self.df.filter(F.col(self.ts) == start))
        test = F.lit(True) if start is None else F.col(self.ts) >= start
        return self.over(self.df.filter(test if stop is None else test & (F.col(self.ts) <= stop)))

    def head(self, n: int = 5) -> BarFrame:
        return self.iloc(slice(0, n))

    def tail(self, n: int = 5) -> BarFrame:
        back = self.df.withColumn("_back", F.row_number().over(Window.partitionBy(*self.key).orderBy(*(F.desc(c) for c in self.order))))
        test = F.col("_back") <= n if n >= 0 else F.lit(False)
        return self.over(back.filter(test).drop("_back")) if n >= 0 else self.iloc(slice(-n, None))

    # Column writes

    def assign(self, **columns: Column) -> BarFrame:
        return self.over(self.df.withColumns({n: c if isinstance(c, Column) else F.lit(c) for n, c in columns.items()}))

    def set_where(self, mask: Column, column: str, value) -> BarFrame:
        return self.assign(**{column: F.when(F.coalesce(mask, F.lit(False)), value).otherwise(F.col(column))})

    def where(self, mask: Column, other=None, columns: Sequence[str] | None = None) -> BarFrame:
        """Values where the mask holds, else other."""
        return self._map(lambda c: F.when(F.coalesce(mask, F.lit(False)), c).otherwise(F.lit(other)), columns)

    def mask(self, mask: Column, other=None, columns: Sequence[str] | None = None) -> BarFrame:
        return self.where(~F.coalesce(mask, F.lit(False)), other, columns)

    def _map(self, f, columns: Sequence[str] | None = None) -> BarFrame:
        return self.over(self.df.withColumns({c: f(F.col(c)) for c in columns or self.numeric}))

    def drop(self, *columns: str, errors: str = "raise") -> BarFrame:
        if errors == "raise" and set(columns) - set(self.columns):
            raise KeyError(sorted(set(columns) - set(self.columns)))
        return self.over(self.df.drop(*columns))

    def drop_rows(self, labels: Sequence) -> BarFrame:
        return self.over(self.df.filter(~F.col(self.ts).isin(list(labels))))

    def rename(self, columns: Mapping[str, str]) -> BarFrame:
        return self.over(self.df.withColumnsRenamed(dict(columns)), key=tuple(columns.get(c, c) for c in self.key), ts=columns.get(self.ts, self.ts), tiebreak=tuple(columns.get(c, c) for c in self.tiebreak))

    def set_index(self, ts: str) -> BarFrame:
        return replace(self, ts=ts)

    def reset_index(self, drop: bool = False) -> BarFrame:
        """Positions become the order; the old label column stays unless it is dropped."""
        rows = self.positions("position")
        return self.over(rows.drop(self.ts) if drop else rows, ts="position", tiebreak=())

    def astype(self, types: Mapping[str, str]) -> BarFrame:
        """Casts; a value that the type cannot hold exactly raises when it is read."""

        def strict(c: str, kind: str) -> Column:
            made = F.col(c).try_cast(kind)
            back = made.cast(self.df.schema[c].dataType)
            lost = F.col(c).isNotNull() & (made.isNull() | ~back.eqNullSafe(F.col(c)))
            return F.when(lost, F.raise_error(F.lit(f"{c} cannot be {kind} without loss"))).otherwise(made)

        return self.over(self.df.withColumns({c: strict(c, kind) for c, kind in types.items()}))

    # Missing values

    def isna(self, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: c.isNull() | F.isnan(c.cast("double")), columns)

    def notna(self, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: ~(c.isNull() | F.isnan(c.cast("double"))), columns)

    def dropna(self, how: str = "any", subset: Sequence[str] | None = None) -> BarFrame:
        return self.over(self.df.na.drop(how, subset=list(subset) if subset else None))

    def fillna(self, value, columns: Sequence[str] | None = None, limit: int | None = None) -> BarFrame:
        """Missing values become value, at most the first limit of a column."""

        def fill(c: Column) -> Column:
            gap = c.isNull() | F.isnan(c.cast("double"))
            if limit is not None:
                gap = gap & (F.sum(F.when(gap, 1).otherwise(0)).over(self.w.rowsBetween(Window.unboundedPreceding, 0)) <= limit)
            return F.when(gap, F.lit(value)).otherwise(c)

        return self._map(fill, columns)

    def ffill(self, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: F.last(c, ignorenulls=True).over(self.w.rowsBetween(Window.unboundedPreceding, 0)), columns)

    def bfill(self, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: F.first(c, ignorenulls=True).over(self.w.rowsBetween(0, Window.unboundedFollowing)), columns)

    def interpolate(self, columns: Sequence[str] | None = None) -> BarFrame:
        """Straight lines by position over inner gaps."""
        columns = list(columns or self.numeric)
        rows = self.positions()
        back, on = self.w.rowsBetween(Window.unboundedPreceding, 0), self.w.rowsBetween(0, Window.unboundedFollowing)
        here = F.col("_position")

        def line(name: str) -> Column:
            known = F.when(F.col(name).isNotNull(), F.struct(here.alias("at"), F.col(name).cast("double").alias("v")))
            a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
            inside = a["v"] + (b["v"] - a["v"]) * (here - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
            return F.coalesce(F.col(name).cast("double"), inside)

        return self.over(rows.withColumns({c: line(c) for c in columns}).drop("_position"))

    def replace(self, old, new, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: F.when(c == F.lit(old), F.lit(new)).otherwise(c), columns)

    def isin(self, values: Sequence, columns: Sequence[str] | None = None) -> BarFrame:
        return self._map(lambda c: F.coalesce(c.isin(list(values)), F.lit(False)), columns)

    # Elementwise

    def abs(self, columns=None) -> BarFrame:
        return self._map(F.abs, columns)

    def round(self, decimals: int = 0, columns=None) -> BarFrame:
        return self._map(lambda c: F.bround(c, decimals), columns)

    def clip(self, lower=None, upper=None, columns=None) -> BarFrame:
        def bound(c: Column) -> Column:
            made = c if lower is None else F.greatest(c, F.lit(lower))
            made = made if upper is None else F.least(made, F.lit(upper))
            return F.when(c.isNotNull(), made)

        return self._map(bound, columns)

    def math(self, name: str, columns=None) -> BarFrame:
        return self._map(lambda c: MATH[name](c.cast("double")).cast("double"), columns)

    # Offsets and running values

    def shift(self, n: int = 1, columns=None) -> BarFrame:
        return self._map(lambda c: F.lag(c, n).over(self.w) if n >= 0 else F.lead(c, -n).over(self.w), columns)

    def diff(self, n: int = 1, columns=None) -> BarFrame:
        return self._map(lambda c: c - (F.lag(c, n).over(self.w) if n >= 0 else F.lead(c, -n).over(self.w)), columns)

    def _running(self, f, columns) -> BarFrame:
        return self._map(lambda c: F.when(c.isNotNull(), f(c).over(self.w.rowsBetween(Window.unboundedPreceding, 0))), columns)

    def cumsum(self, columns=None) -> BarFrame:
        return self._running(F.sum, columns)

    def cumprod(self, columns=None) -> BarFrame:
        return self._running(F.product, columns)

    def cummax(self, columns=None) -> BarFrame:
        return self._running(F.max, columns)

    def cummin(self, columns=None) -> BarFrame:
        return self._running(F.min, columns)

    def rank(self, column: str, name: str = "rank", method: str = "average", ascending: bool = True, pct: bool = False, na_option: str = "keep") -> BarFrame:
        c = clean(F.col(column).cast("double"))
        nulls = {"keep": "last", "bottom": "last", "top": "first"}[na_option]
        by = getattr(c, f"{'asc' if ascending else 'desc'}_nulls_{nulls}")()
        part = Window.partitionBy(*self.key)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*self.key, column))
        low = F.rank().over(part.orderBy(by))
        value = {"average": low + (ties - 1) / 2, "min": low, "max": low + ties - 1, "first": F.row_number().over(part.orderBy(by, *self.order)), "dense": F.dense_rank().over(part.orderBy(by))}[method].cast("double")
        if pct:
            value = value / (F.count(c).over(part) if na_option == "keep" else F.count(F.lit(1)).over(part))
        return self.assign(**{name: F.when(c.isNotNull() | F.lit(na_option != "keep"), value)})

    # Windows

    def rolling(self, window: int, min_periods: int | None = None, center: bool = False) -> Windowed:
        return Windowed(self, RowWindow(self.w, window, min_periods, center))

    def expanding(self, min_periods: int = 1) -> Windowed:
        return Windowed(self, RowWindow(self.w, None, min_periods))

    def ewm(self, of: str, columns: Sequence[str] | None = None, *, other: str | None = None, min_periods: int = 0, adjust: bool = True, ignore_na: bool = False, bias: bool = False, **how: float) -> BarFrame:
        """Exponentially weighted mean, sum, var, std, cov or corr; one of com, span, halflife, alpha sets the decay."""
        k = Compiler(self.df, self.key, self.order)
        made = {c: ewm(k, F.col(c), of, decay(**how), other=F.col(other) if other else None, min_periods=min_periods, adjust=adjust, ignore_na=ignore_na, bias=bias) for c in columns or self.numeric}
        return self.over(k.finish(made))

    # Sorts, top rows and duplicates

    def sort_index(self, ascending: bool = True) -> DataFrame:
        return self.df.orderBy(*self.key, *(F.col(c).asc() if ascending else F.col(c).desc() for c in self.order))

    def sort_values(self, column: str, ascending: bool = True, na_position: str = "last") -> DataFrame:
        c = F.col(column)
        by = getattr(c, f"{'asc' if ascending else 'desc'}_nulls_{na_position}")()
        return self.df.orderBy(by, *self.key, *self.order)

    def nlargest(self, n: int, column: str) -> DataFrame:
        return self.df.filter(clean(F.col(column).cast("double")).isNotNull()).orderBy(F.desc(column), *self.key, *self.order).limit(n)

    def nsmallest(self, n: int, column: str) -> DataFrame:
        return self.df.filter(clean(F.col(column).cast("double")).isNotNull()).orderBy(F.asc(column), *self.key, *self.order).limit(n)

    def _repeats(self, columns: Sequence[str] | None, keep: str) -> Column:
        w = Window.partitionBy(*(columns or [c for c in self.columns if c not in self.order]))
        return F.row_number().over(w.orderBy(*((F.desc if keep == "last" else F.asc)(c) for c in self.order))) > 1

    def duplicated(self, columns: Sequence[str] | None = None, keep: str = "first", name: str = "duplicated") -> BarFrame:
        return self.assign(**{name: self._repeats(columns, keep)})

    def drop_duplicates(self, columns: Sequence[str] | None = None, keep: str = "first") -> BarFrame:
        return self.over(self.df.withColumn("_again", self._repeats(columns, keep)).filter(~F.col("_again")).drop("_again"))

    def append(self, rows: DataFrame) -> BarFrame:
        """Rows added by column name; a row of a key and ts that exists replaces it. Unknown columns raise."""
        if set(rows.columns) - set(self.columns):
            raise ValueError(f"unknown columns {sorted(set(rows.columns) - set(self.columns))}")
        both = self.df.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        last = Window.partitionBy(*self.key, self.ts).orderBy(F.desc("_new"), *(F.desc(c) for c in self.tiebreak))
        return self.over(both.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_new", "_nth"))

    # Time

    def cumulate(self, frame: str, cumulators: Mapping[str, str] | None = None) -> BarFrame:
        made = timeframes.cumulate(self.df, frame, key=self.key, ts=self.ts, tiebreak=self.tiebreak, tz=self.tz, cumulators=cumulators)
        return BarFrame(made, self.key, self.ts, (), self.tz)

    def tz_localize(self, tz: str) -> BarFrame:
        if self.tz is not None:
            raise TypeError("the times have a zone already")
        return self.over(self.df.withColumn(self.ts, F.to_utc_timestamp(F.col(self.ts).cast("timestamp"), tz)), tz=tz)

    def tz_convert(self, tz: str) -> BarFrame:
        if self.tz is None:
            raise TypeError("the times have no zone")
        return replace(self, tz=tz)

    # Reductions: one row a key

    def reduce(self, *kinds: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
        """A row per key with <column>_<kind> for each column and kind; one aggregation."""
        made = [reduction(kind, c, self.order, **options).alias(f"{c}_{kind}") for c in columns or self.numeric for kind in kinds]
        return self.df.groupBy(*self.key).agg(*made)

    def describe(self, columns: Sequence[str] | None = None) -> DataFrame:
        names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": "max"}
        made = [(reduction(how, c, self.order) if isinstance(how, str) else reduction("quantile", c, self.order, q=how)).alias(f"{c}_{n}") for c in columns or self.numeric for n, how in names.items()]
        return self.df.groupBy(*self.key).agg(*made)

    def corr(self, columns: Sequence[str] | None = None, of: str = "corr") -> DataFrame:
        """Pairs of columns with their correlation, or covariance."""
        names = list(columns or self.numeric)
        f = correlation if of == "corr" else F.covar_samp
        values = {c: clean(F.col(c).cast("double")) for c in names}

        def pair(a: str, b: str) -> Column:  # rows where both are present
            both = values[a].isNotNull() & values[b].isNotNull()
            return clean(f(F.when(both, values[a]), F.when(both, values[b])))

        pairs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), pair(a, b).alias(of)) for a in names for b in names]
        return self.df.groupBy(*self.key).agg(F.array(*pairs).alias("_pairs")).select(*self.key, F.inline("_pairs"))

    def cov(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self.corr(columns, "cov")

    def unique(self, column: str) -> DataFrame:
        """Values in the order of first appearance."""
        return self.df.groupBy(*self.key, column).agg(F.min(F.struct(*self.order)).alias("_first")).orderBy("_first").drop("_first")

    def value_counts(self, column: str, normalize: bool = False, ascending: bool = False) -> DataFrame:
        rows = self.df.filter(F.col(column).isNotNull()).groupBy(*self.key, column).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*self.order)).alias("_first"))
        if normalize:
            rows = rows.withColumn("count", F.col("count") / F.sum("count").over(Window.partitionBy(*self.key)))
        return rows.orderBy(F.asc("count") if ascending else F.desc("count"), "_first").drop("_first")

    def mode(self, column: str) -> DataFrame:
        """All most frequent values, ascending."""
        counts = self.df.filter(F.col(column).isNotNull()).groupBy(*self.key, column).count()
        top = counts.withColumn("_top", F.max("count").over(Window.partitionBy(*self.key)))
        return top.filter("count = _top").select(*self.key, column).orderBy(*self.key, column)

    def monotonic(self, column: str) -> DataFrame:
        """is_monotonic_increasing, is_monotonic_decreasing and is_unique of a column, per key."""
        before = F.lag(column).over(self.w)
        rows = self.df.select(*self.key, F.col(column).alias("_x"), (F.col(column) >= before).alias("_up"), (F.col(column) <= before).alias("_down"))
        return rows.groupBy(*self.key).agg(
            F.coalesce(F.bool_and("_up"), F.lit(True)).alias("is_monotonic_increasing"), F.coalesce(F.bool_and("_down"), F.lit(True)).alias("is_monotonic_decreasing"), (F.count(F.lit(1)) == F.count_distinct("_x")).alias("is_unique")
        )

    # Leaving Spark: these run the plan and bring its rows to the driver

    def to_pandas(self):
        return self.sort_index().toPandas()

    def to_arrow(self):
        return self.sort_index().toArrow()

    def to_numpy(self, columns: Sequence[str] | None = None):
        return self.sort_index().select(*(columns or self.numeric)).toPandas().to_numpy()

    def to_list(self, column: str) -> list:
        return [r[0] for r in self.sort_index().select(column).collect()]

    def to_dict(self, column: str) -> dict:
        """Labels of one series to values."""
        return {r[0]: r[1] for r in self.sort_index().select(self.ts, column).collect()}

    def items(self, column: str):
        return iter(self.to_dict(column).items())

    def fill_into(self, out, columns: Sequence[str] | None = None) -> None:
        """Write the rows into a caller's array."""
        out[...] = self.to_numpy(columns)

    def to_dlpack(self, column: str):
        """A numeric column without missing values for other array libraries."""
        return self.to_numpy([column])[:, 0].copy().__dlpack__()

    def to_string(self, n: int = 20) -> str:
        return self.sort_index().limit(n).toPandas().to_string(na_rep="<NA>", index=False)

    def _repr_html_(self) -> str:
        return self.sort_index().limit(20).toPandas().to_html(na_rep="<NA>", index=False)

    def ready(self, window: int) -> bool:
        """Whether every series has window rows."""
        least = self.df.groupBy(*self.key).count().agg(F.min("count")).first()[0]
        return least is not None and least >= window

    def equals(self, other: BarFrame) -> bool:
        """Counts the rows that one frame has and the other lacks."""
        if self.columns != other.columns:
            return False
        return not self.df.exceptAll(other.df).limit(1).count() and not other.df.exceptAll(self.df).limit(1).count()


@dataclass(frozen=True)
class Windowed:
    """A frame's rolling or expanding window; aggregates replace the numeric columns."""

    frame: BarFrame
    window: RowWindow

    def agg(self, of: str, columns: Sequence[str] | None = None, **options) -> BarFrame:
        return self.frame.over(self.frame.df.withColumns({c: getattr(self.window, of)(F.col(c).cast("double"), **options) for c in columns or self.frame.numeric}))

    def pair(self, of: str, x: str, y: str, name: str, **options) -> BarFrame:
        return self.frame.assign(**{name: getattr(self.window, of)(F.col(x).cast("double"), F.col(y).cast("double"), **options)})

    def __getattr__(self, of: str):
        if of.startswith("_") or not hasattr(RowWindow, of):
            raise AttributeError(of)
        return lambda columns=None, **options: self.agg(of, columns, **options)


def reduction(kind: str, column: str, order: Sequence[str], q: float = 0.5) -> Column:
    """A whole-column aggregate that skips missing values."""
    raw, x = F.col(column), clean(F.col(column).cast("double"))
    n = F.count(x)
    if kind in ("any", "all"):
        truth = raw.cast("boolean")
        return F.coalesce((F.bool_or if kind == "any" else F.bool_and)(truth), F.lit(kind == "all"))
    if kind in ("idxmax", "idxmin"):
        present = F.when(x.isNotNull(), F.col(order[0]))
        at = F.struct(x, *order) if kind == "idxmin" else F.struct(-x, *order)
        return F.min_by(present, F.when(x.isNotNull(), at))
    made = {
        "count": lambda: n, "sum": lambda: F.coalesce(F.sum(F.when(x.isNotNull(), raw)), F.lit(0)), "prod": lambda: F.coalesce(F.product(x), F.lit(1.0)),
        "mean": lambda: F.avg(x), "min": lambda: F.min(F.when(x.isNotNull(), raw)), "max": lambda: F.max(F.when(x.isNotNull(), raw)),
        "var": lambda: clean(F.var_samp(x)), "std": lambda: clean(F.stddev_samp(x)), "sem": lambda: clean(F.stddev_samp(x)) / F.sqrt(n),
        "median": lambda: F.percentile(x, 0.5), "quantile": lambda: F.percentile(x, q), "nunique": lambda: F.count_distinct(x),
        "skew": lambda: F.when(F.var_pop(x) == 0, 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)),
        "kurt": lambda: F.when(F.var_pop(x) == 0, 0.0).otherwise(((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.when(n > 3, (n - 2) * (n - 3))),
    }
    if kind not in made:
        raise ValueError(f"{kind} is no reduction")
    return made[kind]()
