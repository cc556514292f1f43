"""The registered queries over the driver's tables, with the DuckDB SQL that gives the same rows.

Bars: hourly bars of events for each user (price: value, volume: the number of events), and daily bars of lineitem for each
supplier bucket, so that several series run side by side, with whole prices, so that sums are exact. Floats
are cut to steps on both sides, off the halves that exact means often hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.arithmetic import floor
from .operators.frame import BarFrame
from .operators.timeframes import FRAMES, bars_of_ticks

STEPS = 1e5


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type", "value")


def hourly(spark: SparkSession, sf_dir: str, frame: str = "1h") -> BarFrame:
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return BarFrame(bars_of_ticks(rows, frame, F.col("value"), key=["user_id"], tiebreak=["event_id"]), ("user_id",))


def daily(spark: SparkSession, sf_dir: str) -> BarFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_suppkey") % 4).alias("sym"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    bars = bars_of_ticks(rows, "1d", F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.37).cast("double"), key=["sym"], tiebreak=["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], volume=F.col("l_quantity"))
    return BarFrame(bars, ("sym",))


def ticks(spark: SparkSession, sf_dir: str) -> BarFrame:
    return BarFrame(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ("user_id",), "ts", ("event_id",))


def cut(e: str, steps: float = STEPS) -> str:
    """SQL: e in steps."""
    return f"floor(CAST(({e}) AS DOUBLE) * {steps} + 0.37) / {steps}"


HOURLY = """h AS (SELECT user_id, time_bucket(INTERVAL 1 hour, CAST(ts AS TIMESTAMP)) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""
DAILY = """t AS (SELECT l_suppkey % 4 AS sym, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS ts, l_orderkey AS a, l_linenumber AS b, l_partkey AS c, l_extendedprice AS e, CAST(floor(l_extendedprice / l_quantity + 0.37) AS DOUBLE) AS p, l_quantity AS v FROM lineitem),
d AS (SELECT sym, ts, arg_min(p, (a, b, c, e)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (a, b, c, e)) AS close, sum(v) AS volume FROM t GROUP BY 1, 2)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, steps: float = STEPS) -> DataFrame:
    return df.select(*((floor(F.col(c) * steps + 0.37) / steps).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def daily_query(name: str, directives: dict[str, str], sql: dict[str, str] | None, with_: str = "", source: str = "d", steps: float = STEPS) -> None:
    """A query of directives over the daily bars; sql: the expression of each over window w (and names of with_)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = daily(spark, sf_dir).indicators(directives)
        return rounded(made.df.select("sym", "ts", *directives), steps)

    def cell(c: str, e: str) -> str:
        return f"{cut(e, steps)} AS {c}" if c[0] != "_" and not e.startswith("BOOL ") else f"{e.removeprefix('BOOL ')} AS {c}"

    text = None
    if sql:
        text = f"WITH {DAILY}{', ' + with_ if with_ else ''} SELECT sym, ts, {', '.join(cell(c, e) for c, e in sql.items())} FROM {source} WINDOW w AS (PARTITION BY sym ORDER BY ts)"
    query(name, text)(run)


def over(n: int) -> str:
    return f"OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(e: str, n: int) -> str:
    return f"CASE WHEN count(*) {over(n)} = {n} THEN {e} END"


def agg(f: str, x: str, n: int) -> str:
    return full(f"{f}({x}) {over(n)}", n)


# The minimum slice


@query(
    "bars_with_average",
    f"WITH {HOURLY} SELECT user_id, ts, {cut('CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END')} AS ma5, {cut('CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 + 2 * stddev_pop(close) OVER w20 END')} AS upper, "
    "close > CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END AS above FROM h "
    "WINDOW w5 AS (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING), w20 AS (PARTITION BY user_id ORDER BY ts ROWS 19 PRECEDING)",
)
def bars_with_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hourly(spark, sf_dir).indicators({"ma5": "ma:5", "upper": "boll.upper", "above": "close > ma:5"})
    return rounded(made.df.select("user_id", "ts", "ma5", "upper", "above"))


# Time frames

_BUCKET = {
    "1w": "date_trunc('week', CAST(ts AS TIMESTAMP))", "1M": "date_trunc('month', CAST(ts AS TIMESTAMP))", "1y": "date_trunc('year', CAST(ts AS TIMESTAMP))", "1d": "date_trunc('day', CAST(ts AS TIMESTAMP))",
    "3d": "time_bucket(INTERVAL 3 day, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01')",
}
_INTERVAL = {"s": "second", "m": "minute", "h": "hour"}


def _cumulated(frame: str) -> None:
    start = _BUCKET.get(frame) or f"time_bucket(INTERVAL {frame[:-1]} {_INTERVAL[frame[-1]]}, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01')"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hourly(spark, sf_dir, frame).df

    query(
        f"cumulate_{frame}" if frame != "1M" else "cumulate_1month",
        f"SELECT user_id, {start} AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2",
    )(run)


for _frame in FRAMES:
    _cumulated(_frame)


@query("cumulate_bars", f"WITH {HOURLY} SELECT user_id, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM h GROUP BY 1, 2")
def cumulate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).cumulate("1d").df


# Windowed commands

daily_query(
    "averages",
    {"ma5": "ma:5", "wma5": "wma:5", "trima5": "trima:5", "swma4": "swma", "vwma5": "vwma:5", "bbi4": "bbi", "bias6": "bias", "dma2": "dma:5,10", "mid5": "midpoint:5", "mid6": "midprice:5"},
    {
        "ma5": agg("avg", "close", 5),
        "wma5": "(5 * close + 4 * lag(close, 1) OVER w + 3 * lag(close, 2) OVER w + 2 * lag(close, 3) OVER w + lag(close, 4) OVER w) / 15",
        "trima5": "(close + 2 * lag(close, 1) OVER w + 3 * lag(close, 2) OVER w + 2 * lag(close, 3) OVER w + lag(close, 4) OVER w) / 9",
        "swma4": "(close + 2 * lag(close, 1) OVER w + 2 * lag(close, 2) OVER w + lag(close, 3) OVER w) / 6",
        "vwma5": full(f"sum(close * volume) {over(5)} / sum(volume) {over(5)}", 5),
        "bbi4": f"({agg('avg', 'close', 3)} + {agg('avg', 'close', 6)} + {agg('avg', 'close', 12)} + {agg('avg', 'close', 24)}) / 4",
        "bias6": f"(close - {agg('avg', 'close', 6)}) / {agg('avg', 'close', 6)} * 100",
        "dma2": f"{agg('avg', 'close', 5)} - {agg('avg', 'close', 10)}",
        "mid5": f"({agg('max', 'close', 5)} + {agg('min', 'close', 5)}) / 2",
        "mid6": f"({agg('max', 'high', 5)} + {agg('min', 'low', 5)}) / 2",
    },
)
_SD = agg("stddev_pop", "close", 20)
_M20 = agg("avg", "close", 20)
daily_query(
    "bands",
    {"mid": "boll", "up": "boll.upper", "down": "boll.lower", "width": "bbw", "dc": "donchian:20", "dcu": "donchian.upper:20", "dcl": "donchian.lower:20", "acc": "accbands.upper", "accl": "accbands.lower"},
    {
        "mid": _M20, "up": f"{_M20} + 2 * {_SD}", "down": f"{_M20} - 2 * {_SD}", "width": f"4 * {_SD} / {_M20}",
        "dc": f"({agg('max', 'high', 20)} + {agg('min', 'low', 20)}) / 2", "dcu": agg("max", "high", 20), "dcl": agg("min", "low", 20),
        "acc": agg("avg", "high * (1 + 4 * (high - low) / (high + low))", 20), "accl": agg("avg", "low * (1 - 4 * (high - low) / (high + low))", 20),
    },
)
daily_query(
    "ichimoku",
    {"t": "ichimoku.tenkan", "k": "ichimoku.kijun", "a": "ichimoku.senkou_a", "b": "ichimoku.senkou_b", "c": "ichimoku.chikou"},
    {"t": "t", "k": "k", "a": "lag((t + k) / 2, 26) OVER w", "b": "lag(s, 26) OVER w", "c": "close"},
    f"i AS (SELECT *, ({agg('max', 'high', 9)} + {agg('min', 'low', 9)}) / 2 AS t, ({agg('max', 'high', 26)} + {agg('min', 'low', 26)}) / 2 AS k, ({agg('max', 'high', 52)} + {agg('min', 'low', 52)}) / 2 AS s FROM d)",
    "i",
)
daily_query(
    "price_levels",
    {"p": "pivot_points", "r1": "pivot_points.r1", "s3": "pivot_points.s3", "cdp": "cdp", "ah": "cdp.ah", "nl": "cdp.nl", "wr": "mike.weakr:10", "sr": "mike.strongr:10", "ms": "mike.mids:10"},
    {
        "p": "lag((high + low + close) / 3) OVER w", "r1": "lag(2 * (high + low + close) / 3 - low) OVER w", "s3": "lag(low - 2 * (high - (high + low + close) / 3)) OVER w",
        "cdp": "lag((high + low + 2 * close) / 4) OVER w", "ah": "lag((high + low + 2 * close) / 4 + high - low) OVER w", "nl": "lag((high + low + 2 * close) / 2 - high) OVER w",
        "wr": f"2 * (high + low + close) / 3 - {agg('min', 'low', 10)}", "sr": f"2 * {agg('max', 'high', 10)} - {agg('min', 'low', 10)}",
        "ms": f"(high + low + close) / 3 - ({agg('max', 'high', 10)} - {agg('min', 'low', 10)})",
    },
)
_HH, _LL = agg("max", "high", 14), agg("min", "low", 14)
daily_query(
    "momentum",
    {"mom": "mom:5", "roc": "roc:5", "rocp": "rocp:5", "rocr": "rocr:5", "change": "change:5", "dpo": "dpo:20", "willr": "willr:14", "rsv": "rsv:14", "stochf": "stochf.k:14", "bop": "bop", "psy": "psy:12", "apo": "apo:5,10"},
    {
        "mom": "close - lag(close, 5) OVER w", "roc": "100 * (close / lag(close, 5) OVER w - 1)", "rocp": "close / lag(close, 5) OVER w - 1", "rocr": "close / lag(close, 5) OVER w",
        "change": "close / lag(close, 4) OVER w - 1", "dpo": f"lag(close, 11) OVER w - {_M20}",
        "willr": f"CASE WHEN {_HH} = {_LL} THEN 0 ELSE -100 * ({_HH} - close) / ({_HH} - {_LL}) END", "rsv": f"CASE WHEN {_HH} = {_LL} THEN 0 ELSE 100 * (close - {_LL}) / ({_HH} - {_LL}) END",
        "stochf": f"CASE WHEN {_HH} = {_LL} THEN 0 ELSE 100 * (close - {_LL}) / ({_HH} - {_LL}) END", "bop": "CASE WHEN high - low < 1e-14 THEN 0 ELSE (close - open) / (high - low) END",
        "psy": f"CASE WHEN count(before) {over(12)} = 12 THEN 100 * avg(CASE WHEN close > before THEN 1.0 ELSE 0.0 END) {over(12)} END", "apo": f"{agg('avg', 'close', 5)} - {agg('avg', 'close', 10)}",
    },
    "e AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY ts) AS before FROM d)", "e",
)
daily_query(
    "statistics",
    {"total": "sum:10", "v": "var:10", "sd": "stddev:10", "med": "median:10", "q": "quantile:10,0.25", "hi": "hhv:10", "lo": "llv:10", "err": "sem:10", "slope": "linearreg_slope:10", "reg": "linearreg:10", "fore": "tsf:10"},
    {
        "total": agg("sum", "close", 10), "v": agg("var_pop", "close", 10), "sd": agg("stddev_pop", "close", 10), "med": agg("median", "close", 10), "q": full(f"quantile_cont(close, 0.25) {over(10)}", 10),
        "hi": agg("max", "high", 10), "lo": agg("min", "low", 10), "err": f"{agg('stddev_samp', 'close', 10)} / sqrt(10)",
        "slope": full(f"regr_slope(close, n) {over(10)}", 10), "reg": full(f"regr_intercept(close, n) {over(10)} + regr_slope(close, n) {over(10)} * n", 10), "fore": full(f"regr_intercept(close, n) {over(10)} + regr_slope(close, n) {over(10)} * (n + 1)", 10),
    },
    "r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts) AS n FROM d)", "r",
)
_FLOW = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END"
_CUM = "OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)"
daily_query(
    "volume_studies",
    {"obv": "obv", "ad": "ad", "pvt": "pvt", "cmf": "cmf", "iii": "iii", "wvad": "wvad", "wad": "wad", "vr": "vr"},
    {
        "obv": f"sum(CASE WHEN b IS NULL OR close > b THEN volume WHEN close < b THEN -volume ELSE 0 END) {_CUM}", "ad": f"sum({_FLOW}) {_CUM}", "pvt": f"sum(coalesce((close - b) / b * volume, 0)) {_CUM}",
        "cmf": full(f"sum({_FLOW}) {over(20)} / sum(volume) {over(20)}", 20), "iii": "CASE WHEN high <> low THEN (2 * close - high - low) / (high - low) * volume ELSE 0 END",
        "wvad": full(f"sum(CASE WHEN high <> low THEN (close - open) / (high - low) * volume ELSE 0 END) {over(24)}", 24),
        "wad": f"sum(CASE WHEN close > b THEN close - least(b, low) WHEN close < b THEN close - greatest(b, high) ELSE 0 END) {_CUM}",
        "vr": f"CASE WHEN count(b) {over(26)} = 26 THEN 100 * (sum(CASE WHEN close > b THEN volume ELSE 0 END) {over(26)} + sum(CASE WHEN close = b THEN volume ELSE 0 END) {over(26)} / 2) / (sum(CASE WHEN close < b THEN volume ELSE 0 END) {over(26)} + sum(CASE WHEN close = b THEN volume ELSE 0 END) {over(26)} / 2) END",
    },
    "e AS (SELECT *, lag(close) OVER (PARTITION BY sym ORDER BY ts) AS b FROM d)", "e", 1e2,
)
daily_query(
    "ranges",
    {"tr": "tr", "vp": "vortex.plus", "chop": "chop:14", "hv": "hv:20", "mfi": "mfi:14", "ult": "ultosc"},
    {
        "tr": "tr", "vp": f"CASE WHEN count(b) {over(14)} = 14 THEN sum(abs(high - bl)) {over(14)} / sum(tr) {over(14)} END",
        "chop": f"CASE WHEN count(b) {over(14)} = 14 THEN 100 * log10(sum(tr) {over(14)} / (max(high) {over(14)} - min(low) {over(14)})) / log10(14) END",
        "hv": f"CASE WHEN count(b) {over(20)} = 20 THEN stddev_samp(ln(close / b)) {over(20)} * sqrt(252) END",
        "mfi": f"CASE WHEN count(b) {over(14)} = 14 THEN 100 * sum(CASE WHEN tp > btp THEN tp * volume ELSE 0 END) {over(14)} / sum(CASE WHEN tp <> btp THEN tp * volume ELSE 0 END) {over(14)} END",
        "ult": f"CASE WHEN count(b) {over(28)} = 28 THEN 100 * (4 * sum(bp) {over(7)} / sum(tr2) {over(7)} + 2 * sum(bp) {over(14)} / sum(tr2) {over(14)} + sum(bp) {over(28)} / sum(tr2) {over(28)}) / 7 END",
    },
    "e0 AS (SELECT *, lag(close) OVER o AS b, lag(low) OVER o AS bl, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER o AS btp FROM d WINDOW o AS (PARTITION BY sym ORDER BY ts)), "
    "e AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(high - low, abs(b - high), abs(b - low)) END AS tr, close - least(low, b) AS bp, greatest(high, b) - least(low, b) AS tr2 FROM e0)", "e",
)
daily_query(
    "prices",
    {"a": "avgprice", "m": "medprice", "t": "typprice", "w_": "wclprice", "up": "close // ma:5", "down": "close \\ ma:5", "both": "close > ma:5 & close < hhv:10", "bull": "style.bullish", "inc": "increase:2"},
    {
        "a": "(open + high + low + close) / 4", "m": "(high + low) / 2", "t": "(high + low + close) / 3", "w_": "(high + low + 2 * close) / 4",
        "up": "BOOL lag(close) OVER w <= lag(m5) OVER w AND close > m5", "down": "BOOL lag(close) OVER w >= lag(m5) OVER w AND close < m5", "both": f"BOOL close > m5 AND close < {agg('max', 'high', 10)}", "bull": "BOOL close > open",
        "inc": "BOOL CASE WHEN lag(close, 2) OVER w IS NOT NULL THEN close > lag(close) OVER w AND lag(close) OVER w > lag(close, 2) OVER w END",
    },
    f"e AS (SELECT *, {agg('avg', 'close', 5)} AS m5 FROM d)", "e",
)

_BODY, _RANGE = "abs(close - open)", "(high - low)"
_P10 = "OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
daily_query(
    "candles",
    {"doji": "cdl.doji", "marubozu": "cdl.marubozu", "spin": "cdl.spinningtop", "engulf": "cdl.engulfing"},
    {
        "doji": "CASE WHEN n > 10 THEN CASE WHEN body <= rng * 0.1 THEN 100.0 ELSE 0.0 END END",
        "marubozu": "CASE WHEN n > 10 THEN CASE WHEN body > bod AND high - greatest(open, close) < rng * 0.1 AND least(open, close) - low < rng * 0.1 THEN CASE WHEN close >= open THEN 100.0 ELSE -100.0 END ELSE 0.0 END END",
        "spin": "CASE WHEN n > 10 THEN CASE WHEN body < bod AND high - greatest(open, close) > body AND least(open, close) - low > body THEN CASE WHEN close >= open THEN 100.0 ELSE -100.0 END ELSE 0.0 END END",
        "engulf": "CASE WHEN n > 2 THEN CASE WHEN (close >= open) <> (c1 >= o1) AND greatest(open, close) >= greatest(o1, c1) AND least(open, close) <= least(o1, c1) AND (greatest(open, close) > greatest(o1, c1) OR least(open, close) < least(o1, c1)) "
        "THEN CASE WHEN close >= open THEN 1 ELSE -1 END * CASE WHEN greatest(open, close) > greatest(o1, c1) AND least(open, close) < least(o1, c1) THEN 100.0 ELSE 80.0 END ELSE 0.0 END END",
    },
    f"e AS (SELECT *, {_BODY} AS body, avg({_BODY}) {_P10} AS bod, avg({_RANGE}) {_P10} AS rng, row_number() OVER o AS n, lag(open) OVER o AS o1, lag(close) OVER o AS c1 FROM d WINDOW o AS (PARTITION BY sym ORDER BY ts))", "e",
)

# Recursive commands: SQL by a fold over each series' list


@query(
    "recursive_averages",
    f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts) AS n FROM d),
s AS (SELECT sym, list(close ORDER BY ts) AS xs FROM d GROUP BY sym),
rec AS (SELECT sym, 10 AS n, list_avg(xs[1:10]) AS e, list_avg(xs[1:10]) AS m FROM s WHERE len(xs) >= 10
  UNION ALL SELECT r.sym, r.n, rec.e + (r.close - rec.e) * 2 / 11, (rec.m * 9 + r.close) / 10 FROM rec JOIN r ON r.sym = rec.sym AND r.n = rec.n + 1)
SELECT r.sym, r.ts, {cut('rec.e')} AS ema10, {cut('rec.m')} AS smma10 FROM r LEFT JOIN rec USING (sym, n)""".replace("WITH t AS", "WITH RECURSIVE t AS"),
)
def recursive_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = daily(spark, sf_dir).indicators({"ema10": "ema:10", "smma10": "smma:10"})
    return rounded(made.df.select("sym", "ts", "ema10", "smma10"))


@query(
    "rsi_atr",
    f"""WITH {DAILY}, r AS (SELECT *, row_number() OVER o AS n, close - lag(close) OVER o AS x, greatest(high - low, abs(lag(close) OVER o - high), abs(lag(close) OVER o - low)) AS tr FROM d WINDOW o AS (PARTITION BY sym ORDER BY ts)),
rec AS (SELECT sym, 15 AS n, avg(greatest(x, 0)) AS u, avg(greatest(-x, 0)) AS v, avg(tr) AS a FROM r WHERE n BETWEEN 2 AND 15 GROUP BY sym HAVING count(*) = 14
  UNION ALL SELECT r.sym, r.n, (rec.u * 13 + greatest(r.x, 0)) / 14, (rec.v * 13 + greatest(-r.x, 0)) / 14, (rec.a * 13 + r.tr) / 14 FROM rec JOIN r ON r.sym = rec.sym AND r.n = rec.n + 1)
SELECT r.sym, r.ts, {cut('CASE WHEN u + v = 0 THEN 0 ELSE 100 * u / (u + v) END')} AS rsi14, {cut('a')} AS atr14, {cut('100 * a / close')} AS natr14 FROM r LEFT JOIN rec USING (sym, n)""".replace("WITH t AS", "WITH RECURSIVE t AS"),
)
def rsi_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = daily(spark, sf_dir).indicators({"rsi14": "rsi:14", "atr14": "atr:14", "natr14": "natr:14"})
    return rounded(made.df.select("sym", "ts", "rsi14", "atr14", "natr14"))


def _unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines without SQL: the cycles of Hilbert's transform, and hikkake."""
    titles = ("mama", "mama.fama", "ht_dcperiod", "ht_dcphase", "ht_phasor", "ht_phasor.quadrature", "ht_sine", "ht_sine.leadsine", "ht_trendline", "ht_trendmode", "cdl.hikkake", "cdl.hikkakemod")
    named = {t.replace(".", "_"): t for t in titles}
    return daily(spark, sf_dir).indicators(named).df.select("sym", "ts", *named)


query("cycles_and_hikkakes")(_unpaired)


# The pandas-like surface

_W = "PARTITION BY user_id ORDER BY ts, event_id"


@query("shift_diff", f"SELECT user_id, ts, event_id, lag(value) OVER w AS shifted, {cut('value - lag(value, 2) OVER w')} AS differed, lead(value) OVER w AS led FROM events WINDOW w AS ({_W})")
def shift_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ticks(spark, sf_dir).assign(shifted=F.col("value"), differed=F.col("value"), led=F.col("value"))
    rows = f.shift(1, ["shifted"]).diff(2, ["differed"]).shift(-1, ["led"])
    return rows.df.select("user_id", "ts", "event_id", "shifted", (F.floor(F.col("differed") * STEPS + 0.37) / STEPS).alias("differed"), "led")


def _surface(name: str, columns: Callable[[BarFrame], dict], sql: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = ticks(spark, sf_dir)
        return rounded(f.df.select("user_id", "ts", "event_id", *(c.alias(n) for n, c in columns(f).items())))

    cells = ", ".join(f"{cut(e)} AS {n}" for n, e in sql.items())
    query(name, f"SELECT user_id, ts, event_id, {cells} FROM events WINDOW w AS ({_W}), r AS ({_W} ROWS 6 PRECEDING), c AS ({_W} ROWS UNBOUNDED PRECEDING)")(run)


def _rolling(f: BarFrame) -> dict:
    w, v = f.rolling(7, min_periods=3).window, F.col("value")
    return {"n": w.count(v).cast("double"), "s": w.sum(v), "m": w.mean(v), "lo": w.min(v), "hi": w.max(v), "va": w.var(v), "sd": w.std(v), "se": w.sem(v), "me": w.median(v), "q": w.quantile(v, 0.3), "fi": w.first(v), "la": w.last(v), "u": w.nunique(v).cast("double")}


def _gate(e: str, least: int = 3) -> str:
    return f"CASE WHEN count(*) OVER r >= {least} THEN {e} END"


_surface(
    "rolling_aggregates", _rolling,
    {"n": _gate("count(value) OVER r") + "::DOUBLE", "s": _gate("sum(value) OVER r"), "m": _gate("avg(value) OVER r"), "lo": _gate("min(value) OVER r"), "hi": _gate("max(value) OVER r"), "va": _gate("var_samp(value) OVER r"), "sd": _gate("stddev_samp(value) OVER r"),
     "se": _gate("stddev_samp(value) OVER r / sqrt(count(*) OVER r)"), "me": _gate("median(value) OVER r"), "q": _gate("quantile_cont(value, 0.3) OVER r"), "fi": _gate("first_value(value) OVER r"), "la": _gate("last_value(value) OVER r"), "u": _gate("len(list_distinct(list(value) OVER r))") + "::DOUBLE"},
)


def _expanding(f: BarFrame) -> dict:
    w, v = f.expanding(2).window, F.col("value")
    return {"s": w.sum(v), "m": w.mean(v), "hi": w.max(v), "sd": w.std(v)}


def _gate_c(e: str) -> str:
    return f"CASE WHEN count(*) OVER c >= 2 THEN {e} END"


_surface("expanding_aggregates", _expanding, {"s": _gate_c("sum(value) OVER c"), "m": _gate_c("avg(value) OVER c"), "hi": _gate_c("max(value) OVER c"), "sd": _gate_c("stddev_samp(value) OVER c")})


@query("running_values", f"SELECT user_id, ts, event_id, {cut('sum(value) OVER c')} AS total, max(value) OVER c AS top, min(value) OVER c AS bottom FROM events WINDOW c AS ({_W} ROWS UNBOUNDED PRECEDING)")
def running_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ticks(spark, sf_dir).assign(total=F.col("value"), top=F.col("value"), bottom=F.col("value"))
    rows = f.cumsum(["total"]).cummax(["top"]).cummin(["bottom"])
    return rows.df.select("user_id", "ts", "event_id", (F.floor(F.col("total") * STEPS + 0.37) / STEPS).alias("total"), "top", "bottom")


@query(
    "ranks",
    "SELECT user_id, ts, event_id, CAST(rank() OVER v + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS DOUBLE) AS average, CAST(dense_rank() OVER v AS DOUBLE) AS dense FROM events WINDOW v AS (PARTITION BY user_id ORDER BY value)",
)
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ticks(spark, sf_dir).rank("value", "average").rank("value", "dense", "dense")
    return f.df.select("user_id", "ts", "event_id", "average", "dense")


@query(
    "reductions",
    f"""SELECT user_id, count(value) AS value_count, {cut('sum(value)')} AS value_sum, {cut('avg(value)')} AS value_mean, min(value) AS value_min, max(value) AS value_max, {cut('var_samp(value)')} AS value_var,
{cut('stddev_samp(value)')} AS value_std, {cut('median(value)')} AS value_median, {cut('stddev_samp(value) / sqrt(count(value))')} AS value_sem, count(DISTINCT value) AS value_nunique, arg_max(ts, (value, -epoch_us(ts))) AS value_idxmax FROM events GROUP BY user_id""",
)
def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ticks(spark, sf_dir).reduce("count", "sum", "mean", "min", "max", "var", "std", "median", "sem", "nunique", "idxmax", columns=["value"]))


@query("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "event_id")
    return BarFrame(rows, (), "ts", ("event_id",)).value_counts("event_type")


@query("top_rows", "SELECT user_id, ts, event_id, value FROM events ORDER BY value DESC, user_id, ts, event_id LIMIT 20")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).nlargest(20, "value").select("user_id", "ts", "event_id", "value")


@query("first_of_duplicates", "SELECT user_id, min_by(ts, (ts, event_id)) AS ts, value FROM events GROUP BY user_id, value")
def first_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).drop_duplicates(["user_id", "value"]).df.select("user_id", "ts", "value")


@query(
    "filled_gaps",
    f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)
SELECT user_id, ts, event_id, last_value(v IGNORE NULLS) OVER b AS forward, first_value(v IGNORE NULLS) OVER f AS backward FROM g WINDOW b AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ticks(spark, sf_dir).mask(F.col("event_id") % 3 == 0, columns=["value"])
    rows = f.assign(forward=F.col("value"), backward=F.col("value")).ffill(["forward"]).bfill(["backward"])
    return rows.df.select("user_id", "ts", "event_id", "forward", "backward")


@query(
    "datetime_parts",
    "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, second(ts) AS second, isodow(ts) - 1 AS weekday, dayofyear(ts) AS dayofyear, quarter(ts) AS quarter, weekofyear(ts) AS week, "
    "day(last_day(ts)) AS days_in_month, day(ts) = 1 AS is_month_start, CAST(ts AS DATE) = last_day(ts) AS is_month_end, dayname(ts) AS day_name, monthname(ts) AS month_name FROM events",
)
def datetime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.datetimes import part

    rows = events(spark, sf_dir)
    names = ("year", "month", "day", "hour", "minute", "second", "weekday", "dayofyear", "quarter", "week", "days_in_month", "is_month_start", "is_month_end", "day_name", "month_name")
    kinds = {"is_month_start": None, "is_month_end": None, "day_name": None, "month_name": None}
    return rows.select("event_id", *((part(n, F.col("ts")) if n in kinds else part(n, F.col("ts")).cast("long")).alias(n) for n in names))


@query(
    "elementwise",
    f"SELECT event_id, {cut('abs(value - 50)')} AS a, {cut('least(greatest(value, 20), 80)')} AS c, {cut('sqrt(abs(value))')} AS s, {cut('ln(abs(value) + 1)')} AS l, {cut('sin(value)')} AS i, value BETWEEN 20 AND 80 AS b FROM events",
)
def elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.arithmetic import between

    v = F.col("value")
    f = ticks(spark, sf_dir).assign(a=v - 50, c=v, s=F.abs(v), l=F.abs(v) + 1, i=v, b=between(v, 20, 80))
    f = f.abs(["a"]).clip(20.0, 80.0, ["c"]).math("sqrt", ["s"]).math("ln", ["l"]).math("sin", ["i"])
    return rounded(f.df.select("event_id", "a", "c", "s", "l", "i", "b"))


from . import catalog  # noqa: E402, F401  registers the queries of all other lines and methods
