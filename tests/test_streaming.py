from datetime import datetime

import pandas as pd
import pytest

from barloom.functions import candles, native  # noqa: F401
from barloom.operators.timeframes import bars_of_ticks, cumulate  # noqa: F401
from barloom.plans.compiler import evaluate
from barloom.streaming.live import Series, live_bars

from .bars import walk


def fine_bars(n=47):
    bars = walk(n, 9)[["k", "ts", "open", "high", "low", "close", "volume"]]
    bars["ts"] = [datetime(2024, 1, 1 + t // 1440, t // 60 % 24, t % 60) for t in bars.ts]
    return bars


def test_stream_equals_batch(spark, tmp_path):
    bars = fine_bars()
    (tmp_path / "in").mkdir()
    for i in range(0, 47, 12):
        bars.iloc[i : i + 12].to_parquet(tmp_path / "in" / f"{i:03d}.parquet", coerce_timestamps="us")
    schema = "k long, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).selectExpr("k", "cast(ts as timestamp) ts", "open", "high", "low", "close", "volume")
    made = live_bars(stream, "5m", key=["k"], indicators={"e": ("ema", (3,), ("close",), 0), "m": ("macd", (2, 4, 2), ("close",), 1)})
    query = made.writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT * FROM live WHERE closed").orderBy("ts").toPandas()
    batch = cumulate(spark.createDataFrame(bars), "5m", key=["k"])
    want = evaluate(batch, {"e": "ema:3", "m": "macd.signal:2,4,2"}, ["k"], ["ts"]).orderBy("ts").toPandas()
    assert len(rows) == len(want) - 1  # the last one still forms
    for c in ("open", "high", "low", "close", "volume", "e", "m"):
        pd.testing.assert_series_equal(rows[c], want[c][: len(rows)], check_exact=False, rtol=1e-12, check_dtype=False)


def test_resent_and_late_bars():
    s = Series([("ema", (1,), (3,), 0)])
    (first,) = s.push(0, 1, (1.0, 2.0, 0.5, 1.5, 10.0))
    assert first == (0, (1.0, 2.0, 0.5, 1.5, 10.0), False, False, [1.5])
    list(s.push(0, 2, (1.6, 9.0, 1.0, 8.0, 5.0)))
    (again,) = s.push(0, 2, (1.6, 3.0, 1.0, 2.5, 6.0))  # replaces what it sent before
    assert again[1] == (1.0, 3.0, 0.5, 2.5, 16.0) and again[4] == [2.5]
    (late,) = s.push(0, 1, (0.0, 0.0, 0.0, 0.0, 0.0))
    assert late[3] and s.forming() == (1.0, 3.0, 0.5, 2.5, 16.0)
    closed, forming = s.push(5, 6, (3.0, 3.0, 3.0, 3.0, 1.0))
    assert closed[2] and closed[1] == (1.0, 3.0, 0.5, 2.5, 16.0) and not forming[2]
    (gap,) = s.push(5, 7, (3.0, None, 3.0, 4.0, 1.0))
    assert gap[1] == (3.0, None, 3.0, 4.0, 2.0)


@pytest.mark.parametrize("n", [1, 2])
def test_empty_state(n):
    assert Series([]).period is None
