from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.frame import BarFrame
from barloom.operators.scalars import Timestamp, tz_database

NAMES = "year month day hour minute second microsecond nanosecond quarter dayofweek day_of_week dayofyear day_of_year week weekofyear days_in_month daysinmonth is_month_start is_month_end is_quarter_start is_quarter_end is_year_start is_year_end is_leap_year value".split()


@pytest.mark.parametrize("text", ["2024-02-29 23:59:58.123456", "2023-12-31", "2021-01-01 12:00:00", "2024-03-31 01:30:00"])
@pytest.mark.parametrize("tz", [None, "America/New_York"])
def test_like_pandas(text, tz):
    mine, theirs = Timestamp(text, tz=tz), pd.Timestamp(text, tz=tz)
    assert [getattr(mine, n) for n in NAMES] == [getattr(theirs, n) for n in NAMES]
    assert (mine.day_name(), mine.month_name(), mine.isoweekday(), mine.isoformat()) == (theirs.day_name(), theirs.month_name(), theirs.isoweekday(), theirs.isoformat())
    assert mine.utcoffset() == theirs.utcoffset() and mine.date() == theirs.date() and mine.time() == theirs.time()
    for how in ("floor", "ceil", "round"):
        for freq in ("h", "15min", "D"):
            assert getattr(mine, how)(freq).isoformat() == getattr(theirs, how)(freq).isoformat()
    assert (mine + timedelta(hours=5)).isoformat() == (theirs + pd.Timedelta(hours=5)).isoformat()
    assert mine - timedelta(days=1) < mine and mine - Timestamp(text, tz=tz) == timedelta(0) and hash(mine) == hash(Timestamp(mine))


def test_zones_and_units(spark):
    t = Timestamp("2024-07-01 12:00", tz="Asia/Shanghai")
    assert t.tz_convert("UTC").hour == 4 and t.tz == "Asia/Shanghai" and t.tz_localize(None).tz is None
    with pytest.raises(TypeError):
        t.tz_localize("UTC")
    with pytest.raises(TypeError):
        Timestamp("2024-01-01").tz_convert("UTC")
    assert Timestamp(1_700_000_000, unit="s").isoformat() == "2023-11-14T22:13:20" and t.to_numpy() == np.datetime64("2024-07-01T04:00", "ns")
    assert spark.range(1).select(t.lit().cast("string"), Timestamp("2024-01-01").lit().cast("string")).first()[:] == ("2024-07-01 04:00:00", "2024-01-01 00:00:00")
    assert tz_database()[:2] == "20" and "tz=" in repr(t)


def test_leaving_spark(spark):
    f = BarFrame(spark.createDataFrame([(1, 2.0), (0, 1.0)], "ts long, x double"))
    out = np.zeros((2, 1))
    f.fill_into(out, ["x"])
    assert out.tolist() == [[1.0], [2.0]] and f.to_dict("x") == {0: 1.0, 1: 2.0} and dict(f.items("x")) == f.to_dict("x")
    assert "ts" in f.to_string() and "<table" in f._repr_html_() and f.ready(2) and not f.ready(3)
    assert f.equals(f.over(f.df.repartition(2))) and not f.equals(f.assign(x=F.lit(0.0)))
