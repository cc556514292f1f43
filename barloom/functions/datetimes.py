"""Parts of times as columns, zones, and conversion to times."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _last_of(unit: str) -> Callable[[Column], Column]:
    return lambda c: F.date_trunc(unit, c) != F.date_trunc(unit, F.date_add(F.to_date(c), 1))


PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "microsecond": lambda c: F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000)).cast("int"),
    "nanosecond": lambda c: F.when(c.isNotNull(), F.lit(0)),
    "dayofweek": F.weekday, "day_of_week": F.weekday, "weekday": F.weekday, "isoweekday": lambda c: F.weekday(c) + 1,
    "dayofyear": F.dayofyear, "day_of_year": F.dayofyear, "quarter": F.quarter,
    "week": F.weekofyear, "weekofyear": F.weekofyear,
    "days_in_month": lambda c: F.dayofmonth(F.last_day(c)), "daysinmonth": lambda c: F.dayofmonth(F.last_day(c)),
    "is_month_start": lambda c: F.dayofmonth(c) == 1, "is_month_end": lambda c: F.to_date(c) == F.last_day(c),
    "is_quarter_start": lambda c: (F.dayofmonth(c) == 1) & (F.pmod(F.month(c), F.lit(3)) == 1), "is_quarter_end": _last_of("quarter"),
    "is_year_start": lambda c: F.dayofyear(c) == 1, "is_year_end": lambda c: (F.month(c) == 12) & (F.dayofmonth(c) == 31),
    "is_leap_year": lambda c: (F.pmod(F.year(c), F.lit(4)) == 0) & ((F.pmod(F.year(c), F.lit(100)) != 0) | (F.pmod(F.year(c), F.lit(400)) == 0)),
    "day_name": lambda c: F.date_format(c, "EEEE"), "month_name": lambda c: F.date_format(c, "MMMM"),
    "normalize": lambda c: F.date_trunc("day", c), "date": F.to_date, "time": lambda c: F.date_format(c, "HH:mm:ss.SSSSSS"),
    "isocalendar": lambda c: F.struct(F.extract(F.lit("YEAROFWEEK"), c).alias("year"), F.weekofyear(c).alias("week"), (F.weekday(c) + 1).alias("day")),
    "timestamp": lambda c: F.unix_micros(c.cast("timestamp")) / 1e6, "value": lambda c: F.unix_micros(c.cast("timestamp")) * 1000,
    "isoformat": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
}
#: The tokens of strftime as date_format patterns.
TOKENS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "p": "a", "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "%": "%", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}
UNIT_MICROS = {"D": 86_400_000_000, "d": 86_400_000_000, "h": 3_600_000_000, "H": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}


def part(name: str, c: Column) -> Column:
    return PARTS[name](c)


def strftime(c: Column, form: str) -> Column:
    pieces = re.split(r"%(.)", form)
    made = "".join(TOKENS[x] if i % 2 else "".join(f"'{w}'" if w.isalpha() else w for w in re.findall(r"[A-Za-z]+|[^A-Za-z]+", x)) for i, x in enumerate(pieces))
    return F.date_format(c, made)


def grid(c: Column, freq: str, how: str) -> Column:
    """floor, ceil, round (half to even) or away (the nearest, half away from 1970, as SQL's round) to a multiple of D, h, min, s, ms or us."""
    m = re.fullmatch(r"(\d*)\s*(D|d|h|H|min|s|ms|us|ns)", freq)
    if not m:
        raise ValueError(f"{freq} is no frequency")
    if m[2] == "ns":
        return c
    step = int(m[1] or 1) * UNIT_MICROS[m[2]]
    micros = F.unix_micros(c.cast("timestamp"))
    rest = F.pmod(micros, F.lit(step))
    low = micros - rest
    if how == "ceil":
        low = F.when(rest > 0, low + step).otherwise(low)
    elif how in ("round", "away"):
        up = F.pmod(F.floor(low / step), F.lit(2)) == 1 if how == "round" else micros > 0
        low = F.when((2 * rest > step) | ((2 * rest == step) & up), low + step).otherwise(low)
    return F.timestamp_micros(low)


def to_datetime(c: Column, unit: str = "ns", form: str | None = None, numeric: bool = False) -> Column:
    """Times from epochs in a unit or from text; blank or unreadable text is missing. Below a microsecond is cut."""
    if numeric:
        per = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 1, "m": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}[unit]
        return F.timestamp_micros(F.floor(c / 1000).cast("long") if unit == "ns" else F.round(c * per).cast("long"))
    text = F.nullif(F.trim(c), F.lit(""))
    if form is None:
        return F.try_to_timestamp(text)
    made = "".join(TOKENS[x] if i % 2 else "".join(f"'{w}'" if w.isalpha() else w for w in re.findall(r"[A-Za-z]+|[^A-Za-z]+", x)) for i, x in enumerate(re.split(r"%(.)", form)))
    return F.try_to_timestamp(text, F.lit(made))


def tz_localize(c: Column, tz: str) -> Column:
    """The instant of a wall clock time in a zone. A time that clocks skip has the offset after the skip, one they show twice the first."""
    c = c.cast("timestamp")
    at = F.to_utc_timestamp(c, tz)
    skipped = F.unix_micros(F.from_utc_timestamp(at, tz)) - F.unix_micros(c)
    return F.timestamp_micros(F.unix_micros(at) - skipped)


def tz_convert(c: Column, tz: str) -> Column:
    """The wall clock time of an instant in a zone."""
    return F.from_utc_timestamp(c, tz)
