"""Time frames: calendar and zone aware buckets, and the fold of finer bars into them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The frames and their seconds, or the calendar unit they follow.
SECONDS = {"1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200}
CALENDAR = {"1d": "day", "3d": "3 days", "1w": "week", "1M": "month", "1y": "year"}
FRAMES = (*SECONDS, *CALENDAR)
CUMULATORS = {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}
#: The same frames as attributes.
TimeFrame = type("TimeFrame", (), {f"{x[-1]}{x[:-1]}" if x != "1M" else "M1": x for x in FRAMES})


def can_coarsen(fine: str, coarse: str) -> bool:
    """Whether every bucket of fine lies in one bucket of coarse."""
    if fine == coarse:
        return True
    if fine in SECONDS:
        return coarse in CALENDAR or (SECONDS[coarse] > SECONDS[fine] and SECONDS[coarse] % SECONDS[fine] == 0)
    return coarse in {"1d": ("3d", "1w", "1M", "1y"), "1M": ("1y",)}.get(fine, ())


def bucket(ts: Column, frame: str, tz: str | None = None, naive: bool = True) -> Column:
    """The start of the time frame that ts is in.

    Frames under a day lie on the grid of the local day, days and longer follow the local calendar. tz is the zone of
    instants (TIMESTAMP); naive times (TIMESTAMP_NTZ) are their own calendar. A repeated hour keeps two buckets.
    """
    if frame not in FRAMES:
        raise ValueError(f"{frame} is no time frame")
    kind = "timestamp_ntz" if naive else "timestamp"
    if naive or tz is None:
        local, shift = ts, F.lit(0).cast("long")
        micros = F.unix_micros(ts.cast("timestamp")) if not naive else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    else:
        local = F.from_utc_timestamp(ts, tz)
        micros = F.unix_micros(ts)
        shift = F.unix_micros(local) - micros
    if frame in SECONDS:
        step = SECONDS[frame] * 1_000_000
        start = micros - F.pmod(micros + shift, F.lit(step))
        return F.timestamp_add("MICROSECOND", start, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) if naive else F.timestamp_micros(start)
    if frame == "3d":
        day = F.to_date(local)
        start = F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.lit(3)))
    else:
        start = F.date_trunc(CALENDAR[frame], local)
    start = start.cast(kind)
    return start if naive or tz is None else F.to_utc_timestamp(start, tz)


def fold(how: str, x: Column, order: Column) -> Column:
    if how in ("first", "last"):
        return (F.min_by if how == "first" else F.max_by)(x, order)
    if how not in ("max", "min", "sum"):
        raise ValueError(f"{how} is no cumulator")
    value = {"max": F.max, "min": F.min, "sum": F.sum}[how](x)
    return F.when(F.count(x) == F.count(F.lit(1)), value)  # a missing part makes the whole missing


def cumulate(df: DataFrame, frame: str, *, key: Sequence[str] = (), ts: str = "ts", tiebreak: Sequence[str] = (), tz: str | None = None, cumulators: Mapping[str, str] | None = None, keep_last: bool = True) -> DataFrame:
    """Bars of a coarser frame: key, ts (the start) and the folded columns.

    open is the first, high the largest, low the smallest, close the last, volume the sum; other columns keep their
    last value; cumulators changes that. Rows of one key and ts are the same bar sent again: the last by tiebreak
    counts, by partial aggregation; keep_last=False takes every row as a bar of its own. A missing part makes its
    fold missing. It is one aggregation with map-side combine after at most one more for the repeated bars.
    """
    naive = df.schema[ts].dataType.typeName() == "timestamp_ntz"
    how = {c: (cumulators or {}).get(c, CUMULATORS.get(c, "last")) for c in df.columns if c not in (*key, ts, *tiebreak)}
    clean = {c: F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c)) for c, kind in df.dtypes if c in how and kind in ("double", "float")}
    df = df.withColumns(clean) if clean else df
    if keep_last and how:
        latest = F.max_by(F.struct(*how), F.struct(ts, *tiebreak)).alias("_bar")
        df = df.groupBy(*key, ts).agg(latest).select(*key, ts, "_bar.*")
        order = F.struct(ts)
    else:
        order = F.struct(ts, *tiebreak)
    start = bucket(F.col(ts), frame, tz, naive)
    return df.groupBy(*key, start.alias("_start")).agg(*(fold(h, F.col(c), order).alias(c) for c, h in how.items())).withColumnRenamed("_start", ts)


def bars_of_ticks(df: DataFrame, frame: str, price: Column, *, key: Sequence[str] = (), ts: str = "ts", tiebreak: Sequence[str] = (), volume: Column | None = None, tz: str | None = None) -> DataFrame:
    """OHLCV bars of ticks in one aggregation; without a volume, ticks are counted."""
    naive = df.schema[ts].dataType.typeName() == "timestamp_ntz"
    rows = df.select(*(F.col(c) for c in key), bucket(F.col(ts), frame, tz, naive).alias("_start"), F.struct(ts, *tiebreak).alias("_order"), price.cast("double").alias("_p"), (volume if volume is not None else F.lit(1)).alias("_v"))
    return rows.groupBy(*key, F.col("_start").alias(ts)).agg(
        F.min_by("_p", "_order").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_order").alias("close"), F.sum("_v").alias("volume")
    )
