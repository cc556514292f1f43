"""Timestamp: one instant or wall clock time on the driver, to the microsecond."""

from __future__ import annotations

import calendar
import functools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.datetimes import UNIT_MICROS

EPOCH = datetime(1970, 1, 1)


@functools.total_ordering
class Timestamp:
    """A time with an optional zone; comparisons and differences need both sides with a zone or both without."""

    unit = "us"

    def __init__(self, value: str | int | float | datetime | Timestamp, tz: str | None = None, unit: str = "ns"):
        if isinstance(value, Timestamp):
            value = value.to_pydatetime()
        elif isinstance(value, str):
            value = datetime.fromisoformat(value)
        elif isinstance(value, (int, float)):
            micros = value / 1000 if unit == "ns" else value * UNIT_MICROS[unit]
            value = EPOCH + timedelta(microseconds=int(micros // 1))
            value = value.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(tz)) if tz else value
        if tz and value.tzinfo is None:
            value = value.replace(tzinfo=ZoneInfo(tz))
        self._at = value.astimezone(ZoneInfo(tz)) if tz else value

    # year, month, day, hour, minute, second, microsecond, isoformat, strftime, utcoffset, dst, tzname, date, time ...
    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._at, name)

    @property
    def value(self) -> int:
        """Nanoseconds since the epoch."""
        at = self._at.astimezone(timezone.utc).replace(tzinfo=None) if self._at.tzinfo else self._at
        return ((at - EPOCH) // timedelta(microseconds=1)) * 1000

    @property
    def tz(self) -> str | None:
        return None if self._at.tzinfo is None else str(self._at.tzinfo)

    nanosecond = 0
    dayofweek = day_of_week = property(lambda self: self._at.weekday())
    dayofyear = day_of_year = property(lambda self: self._at.timetuple().tm_yday)
    week = weekofyear = property(lambda self: self._at.isocalendar()[1])
    quarter = property(lambda self: (self._at.month + 2) // 3)
    days_in_month = daysinmonth = property(lambda self: calendar.monthrange(self._at.year, self._at.month)[1])
    is_leap_year = property(lambda self: calendar.isleap(self._at.year))
    is_month_start = property(lambda self: self._at.day == 1)
    is_month_end = property(lambda self: self._at.day == self.days_in_month)
    is_quarter_start = property(lambda self: self.is_month_start and self._at.month % 3 == 1)
    is_quarter_end = property(lambda self: self.is_month_end and self._at.month % 3 == 0)
    is_year_start = property(lambda self: self.dayofyear == 1)
    is_year_end = property(lambda self: (self._at.month, self._at.day) == (12, 31))

    def day_name(self) -> str:
        return calendar.day_name[self._at.weekday()]

    def month_name(self) -> str:
        return calendar.month_name[self._at.month]

    def _grid(self, freq: str, how: str) -> Timestamp:
        number = freq.rstrip("DdhHminsu") or "1"
        step = int(number) * UNIT_MICROS[freq[len(number) if freq[0].isdigit() else 0 :]]
        wall = (self._at.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1)
        low, rest = wall - wall % step, wall % step
        up = rest > 0 if how == "ceil" else how == "round" and (2 * rest > step or (2 * rest == step and low // step % 2 == 1))
        return Timestamp((EPOCH + timedelta(microseconds=low + step * up)).replace(tzinfo=self._at.tzinfo))

    def floor(self, freq: str) -> Timestamp:
        return self._grid(freq, "floor")

    def ceil(self, freq: str) -> Timestamp:
        return self._grid(freq, "ceil")

    def round(self, freq: str) -> Timestamp:
        return self._grid(freq, "round")

    def normalize(self) -> Timestamp:
        return self.floor("D")

    def replace(self, **parts) -> Timestamp:
        return Timestamp(self._at.replace(**parts))

    def tz_localize(self, tz: str | None) -> Timestamp:
        if tz is not None and self._at.tzinfo is not None:
            raise TypeError("the time has a zone already")
        return Timestamp(self._at.replace(tzinfo=None if tz is None else ZoneInfo(tz)))

    def tz_convert(self, tz: str) -> Timestamp:
        if self._at.tzinfo is None:
            raise TypeError("the time has no zone")
        return Timestamp(self._at.astimezone(ZoneInfo(tz)))

    astimezone = tz_convert

    @classmethod
    def now(cls, tz: str | None = None) -> Timestamp:
        return cls(datetime.now(ZoneInfo(tz)) if tz else datetime.now())

    today = now

    def to_pydatetime(self) -> datetime:
        return self._at

    def to_numpy(self) -> np.datetime64:
        return np.datetime64(self.value, "ns")

    to_datetime64 = to_numpy

    def as_unit(self, unit: str) -> Timestamp:
        if unit not in ("s", "ms", "us", "ns"):
            raise ValueError(f"{unit} is no unit")
        return self if unit in ("us", "ns") else self.floor(unit)

    def lit(self) -> Column:
        """The time as a column: TIMESTAMP with a zone, TIMESTAMP_NTZ without."""
        if self._at.tzinfo is None:
            return F.lit(self._at.isoformat(" ")).cast("timestamp_ntz")
        return F.timestamp_micros(F.lit(self.value // 1000))

    def __add__(self, by: timedelta) -> Timestamp:
        if self._at.tzinfo is None:
            return Timestamp(self._at + by)
        return Timestamp((self._at.astimezone(timezone.utc) + by).astimezone(self._at.tzinfo))

    __radd__ = __add__

    def __sub__(self, other: timedelta | Timestamp | datetime):
        if isinstance(other, timedelta):
            return self + -other
        return self._at - (other._at if isinstance(other, Timestamp) else other)

    def __eq__(self, other) -> bool:
        return self._at == (other._at if isinstance(other, Timestamp) else other)

    def __lt__(self, other) -> bool:
        return self._at < (other._at if isinstance(other, Timestamp) else other)

    def __hash__(self) -> int:
        return hash(self._at)

    def __repr__(self) -> str:
        return f"Timestamp('{self._at.isoformat(' ')}'{f', tz={self.tz!r}' if self.tz else ''})"


def tz_database() -> str:
    """The version of the zone data that Spark's JVM has."""
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    return str(jvm.java.time.zone.ZoneRulesProvider.getVersions("UTC").lastEntry().getKey())
