"""Queries against their SQL on small tables of odd events: domains left, ties, ends of summer time."""

import datetime as dt

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import datetimes
from barloom.operators.frame import BarFrame
from barloom.queries import QUERIES, SQL

from .test_frame import column, same


@pytest.fixture
def differences(spark, tmp_path):
    """Rows on one side only, of a query over events (user_id, ts, value)."""

    def run(name: str, rows: list[tuple[int, dt.datetime, float]]) -> list:
        con = duckdb.connect()
        con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', ?, '')", [(i, ts, user, value) for i, (user, ts, value) in enumerate(rows)])
        con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
        con.execute(f"CREATE TABLE want AS {SQL[name]}")
        listed = ", ".join(f'"{c}"' for c, *_ in con.execute("DESCRIBE want").fetchall())
        con.execute(f"CREATE TABLE got AS SELECT {listed} FROM '{tmp_path}/out/*.parquet'")
        assert con.execute("SELECT count(*) FROM got").fetchall() == [(len(rows),)]
        return [con.execute(f"FROM {a} EXCEPT ALL FROM {b}").fetchall() for a, b in (("want", "got"), ("got", "want"))]

    return run


AT = dt.datetime(2024, 1, 5)
#: The decayed sum by 0.3 lies on a tie of the digits shown.
TIES = [[18.93, 132.49, 31.88, 81.58, 16.34], [9.73, 114.83, 17.0, 7.58, 40.11], [39.93, 60.59, 3.26, 46.69, 30.54]]


def test_math_out_of_domain(differences):
    assert differences("frame_math", [(1, AT, 0.0), (1, AT, 560.21), (2, AT, -3.5), (2, AT, -560.21), (3, AT, 500.0), (3, AT, 12.25)]) == [[], []]


def test_math_of_odd_floats(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1e300, -2.5, 0.0, None]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, ts int, v double")
    frame = BarFrame(rows, ("k",)).assign(**{n: F.col("v") for n in ("floor", "ceil", "ln", "log10")})
    made = {n: [str(x) for x in column(frame.math(n, [n]), n)] for n in ("floor", "ceil", "ln", "log10")}
    assert made["floor"] == ["nan", "inf", "-inf", "1e+300", "-3.0", "0.0", "None"]
    assert made["ceil"] == ["nan", "inf", "-inf", "1e+300", "-2.0", "0.0", "None"]
    assert made["ln"][:3] + made["ln"][4:] == made["log10"][:3] + made["log10"][4:] == ["nan", "inf", "nan", "nan", "-inf", "None"]


@pytest.mark.parametrize("values", TIES)
def test_ewm_sum_on_ties(differences, values):
    assert differences("ewm_all", [(1, AT + dt.timedelta(hours=i), v) for i, v in enumerate(values)]) == [[], []]


@pytest.mark.parametrize("ignore_na", [True, False])
def test_ewm_sum_of_long_series(spark, ignore_na):
    values = [None if i in (0, 1, 7, 8, 90, 199) else round(i * 37.91 % 53, 2) for i in range(200)]
    frame = BarFrame(spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, ts int, v double"), ("k",))
    for alpha in (0.3, 0.01):
        want = pd.Series(values, dtype=float).ewm(alpha=alpha, ignore_na=ignore_na).sum().tolist()
        same(column(frame.ewm("sum", ["v"], alpha=alpha, ignore_na=ignore_na), "v"), want)


def test_times_on_ties_of_the_grid(differences):
    ties = [AT + dt.timedelta(seconds=5 * i, microseconds=d) for i in range(8) for d in (-1, 0, 1)]
    assert differences("datetime_more", [(1, ts, 1.0) for ts in ties]) == [[], []]


def test_times_about_changes_of_clocks(differences):
    changes = [dt.datetime(2024, 3, 10, 7), dt.datetime(2024, 3, 31, 2), dt.datetime(2024, 10, 27, 2), dt.datetime(2024, 11, 3, 6)]
    times = [c + dt.timedelta(minutes=15 * i, microseconds=d) for c in changes for i in range(-6, 8) for d in (-1, 0)]
    assert differences("datetime_more", [(1, ts, 1.0) for ts in times]) == [[], []]


@pytest.mark.parametrize(("how", "want"), [("round", ["1969-12-31 23:59:40", "1970-01-01 00:00:00", "1970-01-01 00:00:00", "1970-01-01 00:00:20"]), ("away", ["1969-12-31 23:59:40", "1969-12-31 23:59:50", "1970-01-01 00:00:10", "1970-01-01 00:00:20"])])
def test_grid_of_ties(spark, how, want):
    made = spark.createDataFrame([(i, x * 1_000_000) for i, x in enumerate((-15, -5, 5, 15))], "i int, us long").orderBy("i").select(datetimes.grid(F.timestamp_micros("us"), "10s", how).cast("string")).collect()
    assert [x for x, in made] == want
