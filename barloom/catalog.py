"""Registered queries that go through the command lines and the frame's methods group by group, with their DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arithmetic as A
from .operators.frame import BarFrame
from .operators.timeframes import bars_of_ticks
from .queries import DAILY, HOURLY, STEPS, agg, cut, daily, full, over, query, rounded, ticks

_O = "OVER (PARTITION BY sym ORDER BY ts)"
_ALL = "OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def lines(name: str, cells: dict[str, tuple[str, str]], with_: str, source: str, steps: float = STEPS) -> None:
    """A query of command lines over the daily bars; cells: column -> (directive, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = daily(spark, sf_dir).indicators({c: d for c, (d, _) in cells.items()})
        return rounded(made.df.select("sym", "ts", *(F.col(c).cast("double").alias(c) for c in cells)), steps)

    shown = ", ".join(f"{cut(e, steps)} AS {c}" for c, (_, e) in cells.items())
    query(name, f"WITH {DAILY}, {with_} SELECT sym, ts, {shown} FROM {source}")(run)


# Candlesticks: each pattern as a truth of the bars a, b, c ... (the last one is the row's own) and its value

_SETTINGS = {
    "body_long": ("body", 10, 1.0), "body_short": ("body", 10, 1.0), "body_doji": ("rng", 10, 0.1), "shadow_short": ("shadows", 10, 0.5), "shadow_very_short": ("rng", 10, 0.1),
    "near": ("rng", 5, 0.2), "far": ("rng", 5, 0.6), "equal": ("rng", 5, 0.05),
}
_PARTS = (
    "parts AS (SELECT sym, ts, open, high, low, close, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS upper, least(open, close) - low AS lower, "
    "(high - greatest(open, close)) + (least(open, close) - low) AS shadows, greatest(open, close) AS top, least(open, close) AS bottom, CASE WHEN close >= open THEN 1 ELSE -1 END AS color, "
    f"low + (high - low) / 2 AS middle, row_number() {_O} AS n FROM d), "
    "bars AS (SELECT *, body AS shadow_long, 2 * body AS shadow_very_long, "
    + ", ".join(f"{k} * avg({x}) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {s}" for s, (x, n, k) in _SETTINGS.items())
    + " FROM parts)"
)
_WORDS = {"white": "{0}.color = 1", "black": "{0}.color = -1", "long": "{0}.body > {0}.body_long", "short": "{0}.body <= {0}.body_short", "doji": "{0}.body <= {0}.body_doji"}


def _gap_up(x: str, y: str) -> str:
    return f"{x}.bottom > {y}.top"


def _gap_down(x: str, y: str) -> str:
    return f"{x}.top < {y}.bottom"


def _close_to(x: str, y: str, room: str) -> str:
    return f"{x} BETWEEN {y} - {room} AND {y} + {room}"


def _maru(x: str) -> str:
    return f"{x}.long AND {x}.upper < {x}.shadow_very_short AND {x}.lower < {x}.shadow_very_short"


def _each(form: str, bars: str) -> str:
    return " AND ".join(form.replace("#", x) for x in bars)


def _next(form: str, bars: str) -> str:
    """form of each pair of neighbours: @ is the earlier one and # the later."""
    return " AND ".join(form.replace("@", x).replace("#", y) for x, y in zip(bars, bars[1:], strict=False))


_HAMMER = "b.body < b.body_short AND b.lower > b.shadow_long AND b.upper < b.shadow_very_short"
_INVERTED = "b.body < b.body_short AND b.upper > b.shadow_long AND b.lower < b.shadow_very_short"
_INSIDE = "b.top <= a.top AND b.bottom >= a.bottom"
_INSIDE_VALUE = "-a.color * (CASE WHEN b.top < a.top AND b.bottom > a.bottom THEN 100 ELSE 80 END)"
_NECK = "a.black AND a.long AND b.white AND b.open < a.low"
_KICK = f"a.color <> b.color AND {_maru('a')} AND {_maru('b')} AND (CASE WHEN a.black THEN b.low > a.high ELSE b.high < a.low END)"
_MORNING = f"a.long AND a.black AND {_gap_down('b', 'a')} AND c.body > c.body_short AND c.white AND c.close > a.close + a.body * 0.3"
_EVENING = f"a.long AND a.white AND {_gap_up('b', 'a')} AND c.body > c.body_short AND c.black AND c.close < a.close - a.body * 0.3"
_RISING = "c.close > b.close AND b.close > a.close"
_BELT = "CASE WHEN #.white THEN #.lower < #.shadow_very_short ELSE #.upper < #.shadow_very_short END"
#: pattern -> (bars, rows before the first value, truth, value)
_PATTERNS: dict[str, tuple[int, int, str, str]] = {
    "doji": (1, 10, "a.doji", "100"),
    "marubozu": (1, 10, _maru("a"), "100 * a.color"),
    "closingmarubozu": (1, 10, "a.long AND (CASE WHEN a.white THEN a.upper < a.shadow_very_short ELSE a.lower < a.shadow_very_short END)", "100 * a.color"),
    "longline": (1, 10, "a.long AND a.upper < a.shadow_short AND a.lower < a.shadow_short", "100 * a.color"),
    "shortline": (1, 10, "a.body < a.body_short AND a.upper < a.shadow_short AND a.lower < a.shadow_short", "100 * a.color"),
    "highwave": (1, 10, "a.body < a.body_short AND a.upper > a.shadow_very_long AND a.lower > a.shadow_very_long", "100 * a.color"),
    "spinningtop": (1, 10, "a.body < a.body_short AND a.upper > a.body AND a.lower > a.body", "100 * a.color"),
    "dragonflydoji": (1, 10, "a.doji AND a.upper < a.shadow_very_short AND a.lower > a.shadow_very_short", "100"),
    "gravestonedoji": (1, 10, "a.doji AND a.lower < a.shadow_very_short AND a.upper > a.shadow_very_short", "100"),
    "longleggeddoji": (1, 10, "a.doji AND (a.lower > a.shadow_long OR a.upper > a.shadow_long)", "100"),
    "rickshawman": (1, 10, "a.doji AND a.lower > a.shadow_long AND a.upper > a.shadow_long AND a.bottom <= a.middle + a.near AND a.top >= a.middle - a.near", "100"),
    "belthold": (1, 10, f"a.long AND ({_BELT.replace('#', 'a')})", "100 * a.color"),
    "takuri": (1, 10, "a.doji AND a.upper < a.shadow_very_short AND a.lower > a.shadow_very_long", "100"),
    "hammer": (2, 11, f"{_HAMMER} AND b.bottom <= a.low + a.near", "100"),
    "hangingman": (2, 11, f"{_HAMMER} AND b.bottom >= a.high - a.near", "-100"),
    "invertedhammer": (2, 11, f"{_INVERTED} AND {_gap_down('b', 'a')}", "100"),
    "shootingstar": (2, 11, f"{_INVERTED} AND {_gap_up('b', 'a')}", "-100"),
    "engulfing": (2, 2, "a.color <> b.color AND b.top >= a.top AND b.bottom <= a.bottom AND (b.top > a.top OR b.bottom < a.bottom)", "b.color * (CASE WHEN b.top > a.top AND b.bottom < a.bottom THEN 100 ELSE 80 END)"),
    "harami": (2, 11, f"a.long AND b.short AND {_INSIDE}", _INSIDE_VALUE),
    "haramicross": (2, 11, f"a.long AND b.doji AND {_INSIDE}", _INSIDE_VALUE),
    "piercing": (2, 11, "a.black AND a.long AND b.white AND b.long AND b.open < a.low AND b.close < a.open AND b.close > a.close + a.body * 0.5", "100"),
    "darkcloudcover": (2, 11, "a.white AND a.long AND b.black AND b.open > a.high AND b.close > a.open AND b.close < a.close - a.body * 0.5", "-100"),
    "dojistar": (2, 11, f"a.long AND b.doji AND (CASE WHEN a.white THEN {_gap_up('b', 'a')} ELSE {_gap_down('b', 'a')} END)", "-100 * a.color"),
    "homingpigeon": (2, 11, "a.black AND a.long AND b.black AND b.short AND b.open < a.open AND b.close > a.close", "100"),
    "matchinglow": (2, 6, f"a.black AND b.black AND {_close_to('b.close', 'a.close', 'a.equal')}", "100"),
    "inneck": (2, 11, f"{_NECK} AND b.close <= a.close + a.equal AND b.close >= a.close", "-100"),
    "onneck": (2, 11, f"{_NECK} AND {_close_to('b.close', 'a.low', 'a.equal')}", "-100"),
    "thrusting": (2, 11, f"{_NECK} AND b.close > a.close + a.equal AND b.close <= a.close + a.body * 0.5", "-100"),
    "kicking": (2, 11, _KICK, "100 * b.color"),
    "kickingbylength": (2, 11, _KICK, "100 * (CASE WHEN b.body > a.body THEN b.color ELSE a.color END)"),
    "separatinglines": (2, 11, f"a.color <> b.color AND {_close_to('b.open', 'a.open', 'a.equal')} AND b.long AND ({_BELT.replace('#', 'b')})", "100 * b.color"),
    "counterattack": (2, 11, f"a.color <> b.color AND a.long AND b.long AND {_close_to('b.close', 'a.close', 'a.equal')}", "100 * b.color"),
    "morningstar": (3, 12, f"{_MORNING} AND b.short", "100"),
    "eveningstar": (3, 12, f"{_EVENING} AND b.short", "-100"),
    "morningdojistar": (3, 12, f"{_MORNING} AND b.doji", "100"),
    "eveningdojistar": (3, 12, f"{_EVENING} AND b.doji", "-100"),
    "abandonedbaby": (3, 12, "a.long AND b.doji AND c.body > c.body_short AND ((a.white AND c.black AND c.close < a.close - a.body * 0.3 AND b.low > a.high AND c.high < b.low) OR (a.black AND c.white AND c.close > a.close + a.body * 0.3 AND b.high < a.low AND c.low > b.high))", "100 * c.color"),
    "3inside": (3, 12, "a.long AND b.short AND b.top < a.top AND b.bottom > a.bottom AND ((a.white AND c.black AND c.close < a.open) OR (a.black AND c.white AND c.close > a.open))", "-100 * a.color"),
    "3outside": (3, 3, "(b.white AND a.black AND b.close > a.open AND b.open < a.close AND c.close > b.close) OR (b.black AND a.white AND b.open > a.close AND b.close < a.open AND c.close < b.close)", "100 * b.color"),
    "3whitesoldiers": (3, 12, f"{_each('#.white AND #.upper < #.shadow_very_short', 'abc')} AND {_RISING} AND c.body > c.body_short AND {_next('#.open > @.open AND #.open <= @.close + @.near AND #.body > @.body - @.far', 'abc')}", "100"),
    "3blackcrows": (4, 13, f"a.white AND a.high > b.close AND {_each('#.black AND #.lower < #.shadow_very_short', 'bcd')} AND {_next('#.close < @.close AND #.open < @.open AND #.open > @.close', 'bcd')}", "-100"),
    "identical3crows": (3, 12, f"{_each('#.black AND #.lower < #.shadow_very_short', 'abc')} AND {_next('#.close < @.close AND #.open BETWEEN @.close - @.equal AND @.close + @.equal', 'abc')}", "-100"),
    "2crows": (3, 12, f"a.white AND a.long AND b.black AND {_gap_up('b', 'a')} AND c.black AND c.open < b.open AND c.open > b.close AND c.close > a.open AND c.close < a.close", "-100"),
    "upsidegap2crows": (3, 12, f"a.white AND a.long AND b.black AND b.short AND {_gap_up('b', 'a')} AND c.black AND c.open > b.open AND c.close < b.close AND c.close > a.close", "-100"),
    "advanceblock": (3, 12, f"{_each('#.white', 'abc')} AND {_RISING} AND a.long AND a.upper < a.shadow_short AND {_next('#.open > @.open AND #.open <= @.close + @.near', 'abc')} AND ((b.body < a.body - a.far AND c.body < b.body + b.near) OR c.body < b.body - b.far "
                    "OR (c.body < b.body AND b.body < a.body AND (c.upper > c.shadow_short OR b.upper > b.shadow_short)) OR (c.body < b.body AND c.upper > c.shadow_long))", "-100"),
    "stalledpattern": (3, 12, f"{_each('#.white', 'abc')} AND {_RISING} AND a.long AND b.long AND b.upper < b.shadow_very_short AND b.open > a.open AND b.open <= a.close + a.near AND c.body < c.body_short AND c.open >= b.close - c.body - b.near", "-100"),
    "sticksandwich": (3, 7, f"a.black AND b.white AND c.black AND b.low > a.close AND {_close_to('c.close', 'a.close', 'a.equal')}", "100"),
    "tristar": (3, 12, f"{_each('#.body <= a.body_doji', 'abc')} AND (({_gap_up('b', 'a')} AND c.top < b.top) OR ({_gap_down('b', 'a')} AND c.bottom > b.bottom))", f"CASE WHEN {_gap_up('b', 'a')} THEN -100 ELSE 100 END"),
    "unique3river": (3, 12, "a.long AND a.black AND b.black AND b.close > a.close AND b.open <= a.open AND b.low < a.low AND c.body < c.body_short AND c.white AND c.open > b.low", "100"),
    "gapsidesidewhite": (3, 7, f"b.white AND c.white AND {_close_to('c.body', 'b.body', 'b.near')} AND {_close_to('c.open', 'b.open', 'b.equal')} AND (({_gap_up('b', 'a')} AND {_gap_up('c', 'a')}) OR ({_gap_down('b', 'a')} AND {_gap_down('c', 'a')}))", f"CASE WHEN {_gap_up('b', 'a')} THEN 100 ELSE -100 END"),
    "tasukigap": (3, 7, f"abs(b.body - c.body) < b.near AND (({_gap_up('b', 'a')} AND b.white AND c.black AND c.open < b.close AND c.open > b.open AND c.close < b.open AND c.close > a.top) OR ({_gap_down('b', 'a')} AND b.black AND c.white AND c.open < b.open AND c.open > b.close AND c.close > b.open AND c.close < a.bottom))", "100 * b.color"),
    "3starsinsouth": (3, 12, f"{_each('#.black', 'abc')} AND a.long AND a.lower > a.shadow_long AND b.body < a.body AND b.open > a.close AND b.open <= a.high AND b.low < a.close AND b.low >= a.low AND b.lower > b.shadow_very_short "
                     "AND c.body < c.body_short AND c.lower < c.shadow_very_short AND c.upper < c.shadow_very_short AND c.low > b.low AND c.high < b.high", "100"),
    "xsidegap3methods": (3, 2, f"a.color = b.color AND b.color = -c.color AND c.open < b.top AND c.open > b.bottom AND c.close < a.top AND c.close > a.bottom AND (CASE WHEN a.white THEN {_gap_up('b', 'a')} ELSE {_gap_down('b', 'a')} END)", "100 * a.color"),
    "3linestrike": (4, 8, f"a.color = b.color AND b.color = c.color AND d.color = -c.color AND {_next('#.open BETWEEN @.bottom - @.near AND @.top + @.near', 'abc')} AND ((c.white AND {_RISING} AND d.open > c.close AND d.close < a.open) OR (c.black AND c.close < b.close AND b.close < a.close AND d.open < c.close AND d.close > a.open))", "100 * c.color"),
    "concealbabyswall": (4, 13, f"{_each('#.black', 'abcd')} AND {_each('#.lower < #.shadow_very_short AND #.upper < #.shadow_very_short', 'ab')} AND {_gap_down('c', 'b')} AND c.upper > c.shadow_very_short AND c.high > b.close AND d.high > c.high AND d.low < c.low", "100"),
    "breakaway": (5, 14, f"a.long AND a.color = b.color AND b.color = d.color AND d.color = -e.color AND ((a.black AND {_gap_down('b', 'a')} AND {_next('#.high < @.high AND #.low < @.low', 'bcd')} AND e.close > b.open AND e.close < a.close) "
                  f"OR (a.white AND {_gap_up('b', 'a')} AND {_next('#.high > @.high AND #.low > @.low', 'bcd')} AND e.close < b.open AND e.close > a.close))", "100 * e.color"),
    "ladderbottom": (5, 14, f"{_each('#.black', 'abcd')} AND e.white AND {_next('#.open < @.open AND #.close < @.close', 'abc')} AND d.upper > d.shadow_very_short AND e.open > d.open AND e.close > d.high", "100"),
    "mathold": (5, 14, f"a.long AND b.short AND c.short AND d.short AND a.white AND b.black AND e.white AND {_gap_up('b', 'a')} AND {_each('#.bottom < a.close AND #.bottom > a.close - a.body * 0.5', 'cd')} AND c.top < b.open AND d.top < c.top AND e.open > d.close AND e.close > greatest(b.high, c.high, d.high)", "100"),
    "risefall3methods": (5, 14, f"a.long AND b.short AND c.short AND d.short AND e.long AND a.color = -b.color AND b.color = c.color AND c.color = d.color AND d.color = -e.color AND {_each('#.bottom < a.high AND #.top > a.low', 'bcd')} "
                         f"AND {_next('#.close * a.color < @.close * a.color', 'bcd')} AND e.open * a.color > d.close * a.color AND e.close * a.color > a.close * a.color", "100 * a.color"),
}


def _candle(name: str) -> tuple[str, str, set[tuple[str, int]]]:
    """The column's name, its SQL, and which part of which earlier bar it reads."""
    bars, rows, truth, value = _PATTERNS[name]
    read: set[tuple[str, int]] = set()

    def part(m: re.Match) -> str:
        bar, what = m.groups()
        if what in _WORDS:
            return "(" + re.sub(r"\b([a-e])\.(\w+)", part, _WORDS[what].format(bar)) + ")"
        back = bars - 1 - "abcde".index(bar)
        read.add((what, back))
        return f"{what}_{back}"

    truth, value = (re.sub(r"\b([a-e])\.(\w+)", part, x) for x in (truth, value))
    column = "cdl_" + name.replace("2", "two").replace("3", "three")
    return column, f"CASE WHEN n > {rows} THEN CASE WHEN {truth} THEN ({value}) ELSE 0 END END", read


def _candles(part: int, names: list[str]) -> None:
    made = {name: _candle(name) for name in names}
    read = sorted(set().union(*(r for _, _, r in made.values())))
    lags = ", ".join(f"lag({x}, {k}) {_O} AS {x}_{k}" if k else f"{x} AS {x}_0" for x, k in read)
    lines(f"candlesticks_{part}", {column: (f"cdl.{name}", sql) for name, (column, sql, _) in made.items()}, f"{_PARTS}, e AS (SELECT sym, ts, n, {lags} FROM bars)", "e")


for _part in range(6):
    _candles(_part, list(_PATTERNS)[_part * 10 : _part * 10 + 10])


# Window lines


def _weighted(x: str, n: int, weights: str) -> str:
    """The sum of the last n values of x, each by its weight: an expression of i, 1 for the oldest."""
    return full(f"list_sum(list_transform(list({x}) {over(n)}, lambda v, i: v * ({weights})))", n)


def _wma(x: str, n: int) -> str:
    return f"({_weighted(x, n, 'i')} / {n * (n + 1) // 2})"


def _known(x: str, e: str, n: int) -> str:
    """e where the last n values of x are all there."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {e} END"


def _mean(x: str, n: int) -> str:
    return _known(x, f"avg({x}) {over(n)}", n)


def _total(x: str, n: int) -> str:
    return _known(x, f"sum({x}) {over(n)}", n)


def _before(x: str, n: int) -> str:
    return f"lag({x}, {n}) {_O}"


_BASE = f"f AS (SELECT *, row_number() {_O} AS n, {_before('close', 1)} AS c1, {_before('high', 1)} AS h1, {_before('low', 1)} AS l1, (high + low + close) / 3 AS tp, (high + low) / 2 AS mid FROM d)"
_GAUSS = "exp(-pow(i - 1 - 0.85 * 8, 2) / (2 * pow(9 / 6.0, 2)))"
lines(
    "averages_more",
    {
        "alma9": ("alma:9", full(f"list_sum(list_transform(list(close) {over(9)}, lambda v, i: v * {_GAUSS})) / list_sum(list_transform(range(1, 10), lambda i: {_GAUSS}))", 9)),
        "hma9": ("hma:9", f"CASE WHEN n >= 11 THEN {_wma('hull', 3)} END"),
        "ama": ("dma.ama:5,10,4", _mean("dma", 4)),
        "dkx": ("dkx", "dkx"),
        "dkxma": ("dkx.ma:5", _mean("dkx", 5)),
        "acc": ("accbands", agg("avg", "close", 20)),
        "mavp": ("mavp:2,6@close,volume", "CASE WHEN n >= 6 THEN CASE least(greatest(CAST(floor(volume) AS INT), 2), 6) " + " ".join(f"WHEN {k} THEN avg(close) {over(k)}" for k in range(2, 7)) + " END END"),
        "squeeze": ("ttm_squeeze:10", f"CASE WHEN n >= 19 THEN regr_intercept(away, n) {over(10)} + regr_slope(away, n) {over(10)} * n END"),
        "squeezed": ("ttm_squeeze.on:10", f"CASE WHEN n > 10 THEN CASE WHEN 2 * stddev_pop(close) {over(10)} < 1.5 * avg(tr) {over(10)} THEN 1 ELSE 0 END END"),
    },
    f"{_BASE}, g AS (SELECT *, 2 * {_wma('close', 4)} - {_wma('close', 9)} AS hull, {agg('avg', 'close', 5)} - {agg('avg', 'close', 10)} AS dma, {_wma('(3 * close + low + open + high) / 6', 20)} AS dkx, "
    f"close - (({agg('max', 'high', 10)} + {agg('min', 'low', 10)}) / 2 + {agg('avg', 'close', 10)}) / 2 AS away, CASE WHEN n > 1 THEN greatest(high - low, abs(c1 - high), abs(c1 - low)) END AS tr FROM f)", "g", 1e4,
)
_CDP, _PP = "((h1 + l1 + 2 * c1) / 4)", "((h1 + l1 + c1) / 3)"
_TOP, _LOW = agg("max", "high", 10), agg("min", "low", 10)
lines(
    "price_levels_more",
    {
        "midr": ("mike.midr:10", f"tp + ({_TOP} - {_LOW})"), "weaks": ("mike.weaks:10", f"tp - ({_TOP} - tp)"), "strongs": ("mike.strongs:10", f"2 * {_LOW} - {_TOP}"),
        "weakr": ("mike.weakr:10", f"tp + (tp - {_LOW})"), "mids": ("mike.mids:10", f"tp - ({_TOP} - {_LOW})"), "strongr": ("mike.strongr:10", f"2 * {_TOP} - {_LOW}"),
        "nh": ("cdp.nh", f"2 * {_CDP} - l1"), "al": ("cdp.al", f"{_CDP} - (h1 - l1)"), "r2": ("pivot_points.r2", f"{_PP} + (h1 - l1)"), "r3": ("pivot_points.r3", f"h1 + 2 * ({_PP} - l1)"),
        "s1": ("pivot_points.s1", f"2 * {_PP} - h1"), "s2": ("pivot_points.s2", f"{_PP} - (h1 - l1)"),
        "ph": ("pivothigh:3,2", f"CASE WHEN n >= 6 AND {_before('high', 2)} > max(high) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AND {_before('high', 2)} > max(high) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) THEN {_before('high', 2)} END"),
        "pl": ("pivotlow:3,2", f"CASE WHEN n >= 6 AND {_before('low', 2)} < min(low) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AND {_before('low', 2)} < min(low) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) THEN {_before('low', 2)} END"),
    },
    _BASE, "f",
)


def _roc(n: int) -> str:
    return f"100 * (close / {_before('close', n)} - 1)"


_SW = "({0} + 2 * lag({0}, 1) " + _O + " + 2 * lag({0}, 2) " + _O + " + lag({0}, 3) " + _O + ") / 6"
_RAW = f"CASE WHEN {agg('max', 'high', 5)} = {agg('min', 'low', 5)} THEN 0 ELSE 100 * (close - {agg('min', 'low', 5)}) / ({agg('max', 'high', 5)} - {agg('min', 'low', 5)}) END"
lines(
    "oscillators",
    {
        "ext": ("macdext:5,0,9,0", "ext"), "exts": ("macdext.signal:5,0,9,0,4,0", _mean("ext", 4)), "exth": ("macdext.histogram:5,0,9,0,4,0", f"ext - {_mean('ext', 4)}"),
        "ppo": ("ppo:5,9", f"100 * ext / {agg('avg', 'close', 9)}"), "apo": ("apo:9,5", "ext"),
        "kst": ("kst", f"{_mean('r10', 10)} + 2 * {_mean('r15', 10)} + 3 * {_mean('r20', 10)} + 4 * {_mean('r30', 15)}"),
        "coppock": ("coppock:5,10,15", f"CASE WHEN n >= 20 THEN {_wma('r10 + r15', 5)} END"),
        "rvi": ("relative_vigor:5", "rvi"), "rvis": ("relative_vigor.signal:5", _SW.format("rvi")), "rocr": ("rocr100:5", f"100 * close / {_before('close', 5)}"),
        "cci": ("cci:5", "CASE WHEN md = 0 THEN 0 ELSE (tp - mt) / (0.015 * md) END"),
        "imi": ("imi:5", full(f"CASE WHEN sum(abs(close - open)) {over(5)} > 0 THEN 100 * sum(greatest(close - open, 0)) {over(5)} / sum(abs(close - open)) {over(5)} END", 5)),
        "fastd": ("stochf.d:5,3", _mean("raw", 3)), "slowk": ("stoch.k:5,3", _mean("raw", 3)), "slowd": ("stoch.d:5,3,0,3", f"CASE WHEN n >= 9 THEN avg(slow) {over(3)} END"),
        "up": ("aroon.up:7", "100 * (7 - high_age) / 7.0"), "down": ("aroon.down:7", "100 * (7 - low_age) / 7.0"), "osc": ("aroonosc:7", "100 * (low_age - high_age) / 7.0"),
        "cog": ("cog:6", f"-{_weighted('close', 6, '7 - i')} / {agg('sum', 'close', 6)}"),
        "minus": ("vortex.minus:5", f"{_total('abs(low - h1)', 5)} / {_total('tr', 5)}"), "plus": ("vortex.plus:5", f"{_total('abs(high - l1)', 5)} / {_total('tr', 5)}"),
        "ar": ("brar.ar:9", full(f"CASE WHEN sum(open - low) {over(9)} > 0 THEN 100 * sum(high - open) {over(9)} / sum(open - low) {over(9)} END", 9)),
        "br": ("brar.br:9", f"CASE WHEN n > 9 AND sum(greatest(c1 - low, 0)) {over(9)} > 0 THEN 100 * sum(greatest(high - c1, 0)) {over(9)} / sum(greatest(c1 - low, 0)) {over(9)} END"),
    },
    f"{_BASE}, g AS (SELECT *, {agg('avg', 'close', 5)} - {agg('avg', 'close', 9)} AS ext, {_roc(10)} AS r10, {_roc(15)} AS r15, {_roc(20)} AS r20, {_roc(30)} AS r30, {_SW.format('(close - open)')} AS body4, {_SW.format('(high - low)')} AS span4, "
    f"CASE WHEN n > 1 THEN greatest(high - low, abs(c1 - high), abs(c1 - low)) END AS tr, {_RAW} AS raw, {agg('avg', 'tp', 5)} AS mt, list(tp) {over(5)} AS tps, "
    f"CASE WHEN n >= 8 THEN n - arg_max(n, (high, n)) {over(8)} END AS high_age, CASE WHEN n >= 8 THEN n - arg_max(n, (-low, n)) {over(8)} END AS low_age FROM f), "
    f"h AS (SELECT *, {_known('span4', f'sum(body4) {over(5)} / nullif(sum(span4) {over(5)}, 0)', 5)} AS rvi, list_sum(list_transform(tps, lambda v: abs(v - mt))) / 5 AS md, {_mean('raw', 3)} AS slow FROM g)", "h", 1e4,
)
lines("ease_of_movement", {"emv": ("emv:3", _mean("ease", 3))}, f"{_BASE}, g AS (SELECT *, CASE WHEN high > low THEN (mid - {_before('mid', 1)}) / (volume / 1e8 / (high - low)) END AS ease FROM f)", "g", 1e-6)
_SK = f"list_sum(list_transform(xs, lambda v: pow(v - m8, {{}})))"
lines(
    "statistics_more",
    {
        "imax": ("maxindex:8", full(f"arg_max(n - 1, (close, n)) {over(8)}", 8)), "imin": ("minindex:8", full(f"arg_max(n - 1, (-close, n)) {over(8)}", 8)),
        "jmax": ("minmaxindex.max:8", full(f"arg_max(n - 1, (close, n)) {over(8)}", 8)), "jmin": ("minmaxindex.min:8", full(f"arg_max(n - 1, (-close, n)) {over(8)}", 8)),
        "least": ("minmax.min:8", agg("min", "close", 8)), "most": ("minmax.max:8", agg("max", "close", 8)),
        "cut8": ("linearreg_intercept:8", full(f"regr_intercept(close, n) {over(8)} + regr_slope(close, n) {over(8)} * (n - 7)", 8)), "angle": ("linearreg_angle:8", full(f"degrees(atan(regr_slope(close, n) {over(8)}))", 8)),
        "correl": ("correl:8@close,volume", full(f"CASE WHEN var_pop(close) {over(8)} = 0 OR var_pop(volume) {over(8)} = 0 THEN 0 ELSE corr(close, volume) {over(8)} END", 8)),
        "beta": ("beta:8@close,volume", f"CASE WHEN n > 8 THEN CASE WHEN var_pop(rc) {over(8)} = 0 THEN 0 ELSE covar_pop(rc, rv) {over(8)} / var_pop(rc) {over(8)} END END"),
        "place": ("rank:8", full("(len(list_filter(xs, lambda v: v < close)) + (len(list_filter(xs, lambda v: v = close)) + 1) / 2) / 8", 8)),
        "skew": ("skew:8", full(f"CASE WHEN {_SK.format(2)} = 0 THEN 0 ELSE 8 * sqrt(7) / 6 * {_SK.format(3)} / pow({_SK.format(2)}, 1.5) END", 8)),
        "kurt": ("kurt:8", full(f"CASE WHEN {_SK.format(2)} = 0 THEN -3 ELSE 8 * 9 * 7 / 30.0 * {_SK.format(4)} / pow({_SK.format(2)}, 2) - 3 * 49 / 30.0 END", 8)),
        "dev": ("dev:8", full("list_sum(list_transform(xs, lambda v: abs(v - m8))) / 8", 8)),
        "mode": ("mode:8", full("list_sort(list_transform(list_distinct(xs), lambda u: {'k': -len(list_filter(xs, lambda v: v = u)), 'u': u}))[1].u", 8)),
        "rci": ("rci:8", full("CASE WHEN own > 0 THEN 100 * list_sum(list_transform(rs, lambda r, i: (r - 4.5) * (i - 4.5))) / sqrt(own * 42) END", 8)),
        "again": ("repeat:3@(close > open)", "CASE WHEN n >= 3 THEN CAST(min(CASE WHEN close > open THEN 1 ELSE 0 END) " + over(3) + " AS INT) END"),
        "falls": ("increase:2,-1", f"CASE WHEN n > 2 THEN CAST(close < c1 AND c1 < {_before('close', 2)} AS INT) END"),
    },
    f"{_BASE}, g AS (SELECT *, list(close) {over(8)} AS xs, {agg('avg', 'close', 8)} AS m8, close / c1 - 1 AS rc, volume / {_before('volume', 1)} - 1 AS rv FROM f), "
    "g1 AS (SELECT *, list_transform(xs, lambda u: len(list_filter(xs, lambda v: v < u)) + (len(list_filter(xs, lambda v: v = u)) + 1) / 2) AS rs FROM g), g2 AS (SELECT *, list_sum(list_transform(rs, lambda r: pow(r - 4.5, 2))) AS own FROM g1)", "g2", 1e3,
)


_UP = "(close > open)"
_M5 = agg("avg", "close", 5)
lines(
    "language",
    {
        "total": ("close + open", "close + open"), "rest": ("close - open * 2", "close - open * 2"), "share": ("(close - open) / open", "(close - open) / open"), "minus": ("-close", "-close"),
        "cross": ("close >< ma:5", f"(lag(close) {_O} <= lag(m5) {_O} AND close > m5) OR (lag(close) {_O} >= lag(m5) {_O} AND close < m5)"),
        "either": ("close > open | high > 20000", f"{_UP} OR high > 20000"), "one": ("close > open ^ high > 20000", f"{_UP} <> (high > 20000)"), "not_": ("~(close > open)", f"NOT {_UP}"),
        "nested": ("ma:3@(high - low)", agg("avg", "high - low", 3)), "deep": ("hhv:4@(wma:3)", f"CASE WHEN n > 5 THEN max(w3) {over(4)} END"), "least": ("close <= open", "close <= open"), "most": ("close >= open", "close >= open"), "same": ("close == open", "close = open"),
        "other": ("close != open", "close <> open"), "below": ("close < open", "close < open"), "bull": ("cdl.bullish", "close > open"), "bear": ("cdl.bearish", "close < open"), "alias": ("boll.u:10", f"{agg('avg', 'close', 10)} + 2 * {agg('stddev_pop', 'close', 10)}"),
        "kept": ("ichimoku.chikou", "close"), "number": ("close > 5000", "close > 5000"),
    },
    f"{_BASE}, g AS (SELECT *, {_M5} AS m5, {_wma('close', 3)} AS w3 FROM f)", "g", 1e4,
)


# Recursive lines: SQL by one fold over the rows of all series at once


class Fold:
    """A recursive query over the rows of r: what a row makes of the states is said in steps, each over those before it."""

    def __init__(self):
        self.states: dict[str, tuple[str, str]] = {}
        self.steps: list[dict[str, str]] = []
        self.level: dict[str, int] = {}

    def let(self, name: str, e: str) -> str:
        level = 1 + max((self.level[w] for w in re.findall(r"\w+", e) if w in self.level), default=-1)
        while len(self.steps) <= level:
            self.steps.append({})
        self.steps[level][name] = e
        self.level[name] = level
        return name

    def state(self, name: str, start: str, e: str) -> str:
        """A state and its next value, whose name it returns."""
        self.states[name] = (start, self.let(f"{name}_next", e))
        return f"{name}_next"

    def average(self, name: str, x: str, p: int, move: str) -> str:
        """The mean of the first p values that are there, then moved by each; null before."""
        n = self.state(f"{name}_n", "0", f"{name}_n + CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END")
        v = self.state(name, "0.0::DOUBLE", f"CASE WHEN ({x}) IS NULL THEN {name} WHEN {name}_n < {p} - 1 THEN {name} + ({x}) WHEN {name}_n = {p} - 1 THEN ({name} + ({x})) / {p} ELSE {move} END")
        return self.let(f"{name}_out", f"CASE WHEN {n} >= {p} THEN {v} END")

    def ema(self, name: str, x: str, p: int, k: float | None = None) -> str:
        return self.average(name, x, p, f"{name} + (({x}) - {name}) * {f'(2.0 / {p + 1})' if k is None else k}")

    def wilder(self, name: str, x: str, p: int) -> str:
        return self.average(name, x, p, f"({name} * {p - 1} + ({x})) / {p}")

    def sql(self, rows: str, outs: dict[str, str]) -> str:
        """CTEs r, which are the rows with n from 1 on, and o: r with the outs."""
        for name, e in outs.items():
            self.states[name] = ("NULL::DOUBLE", self.let(f"{name}_next", f"({e})::DOUBLE"))
        inner = "rec JOIN r ON r.sym = rec.of AND r.n = rec.at + 1"
        # names of rows that are states too would be ambiguous; there are none
        layer = f"(SELECT rec.*, r.* FROM {inner})"
        for step in self.steps:
            layer = f"(SELECT *, {', '.join(f'{e} AS {name}' for name, e in step.items())} FROM {layer})"
        starts = ", ".join(f"{start} AS {name}" for name, (start, _) in self.states.items())
        nexts = ", ".join(e for _, e in self.states.values())
        return f"r AS ({rows}), rec AS (SELECT DISTINCT sym AS of, 0::BIGINT AS at, {starts} FROM r UNION ALL SELECT of, n, {nexts} FROM {layer}), o AS (SELECT r.*, {', '.join(f'rec.{x}' for x in outs)} FROM r JOIN rec ON rec.of = r.sym AND rec.at = r.n)"


def fold_lines(name: str, cells: dict[str, tuple[str, str]], with_: str, steps: float = 1e4) -> None:
    """lines over o; the SQL is a recursive query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = daily(spark, sf_dir).indicators({c: d for c, (d, _) in cells.items()})
        return rounded(made.df.select("sym", "ts", *(F.col(c).cast("double").alias(c) for c in cells)), steps)

    shown = ", ".join(f"{cut(e, steps)} AS {c}" for c, (_, e) in cells.items())
    query(name, f"WITH RECURSIVE {DAILY}, {with_} SELECT sym, ts, {shown} FROM o")(run)


_ROWS = (
    f"SELECT *, {_before('close', 5)} AS c5, CASE WHEN n > 1 THEN greatest(high - low, abs(c1 - high), abs(c1 - low)) END AS tr, close - c1 AS dc, "
    f"CASE WHEN n >= 5 THEN max(high) {over(5)} END AS top5, CASE WHEN n >= 5 THEN min(low) {over(5)} END AS low5, max(high) {over(5)} AS top, min(low) {over(5)} AS bottom, "
    f"CASE WHEN n > 5 THEN sum(abs(close - c1)) {over(5)} END AS path, sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume::DOUBLE ELSE 0 END) {_ALL} AS flow, "
    f"CASE WHEN n = 1 THEN NULL WHEN high - h1 > 0 AND high - h1 > l1 - low THEN high - h1 ELSE 0 END AS rise, CASE WHEN n = 1 THEN NULL WHEN l1 - low > 0 AND l1 - low > high - h1 THEN l1 - low ELSE 0 END AS fall, "
    f"volume::DOUBLE AS vol, {_before('volume', 1)}::DOUBLE AS vol1 FROM (SELECT *, row_number() {_O} AS n, {_before('close', 1)} AS c1, {_before('high', 1)} AS h1, {_before('low', 1)} AS l1, {_before('open', 1)} AS o1 FROM d)"
)


def _averages() -> None:
    f = Fold()
    x, levels = "close", []
    for k in range(1, 7):
        x = f.ema(f"e{k}", x, 4)
        levels.append(x)
    e1, e2, e3, e4, e5, e6 = levels
    third = f.state("third", "NULL::DOUBLE", e3)
    slow, fast = f.ema("slow", "close", 9), f.ema("fast", "CASE WHEN n > 4 THEN close END", 5)
    line = f.let("line", f"{fast} - {slow}")
    signal = f.ema("signal", line, 4)
    fslow, ffast = f.ema("fslow", "close", 26, 0.075), f.ema("ffast", "CASE WHEN n > 14 THEN close END", 12, 0.15)
    fline = f.let("fline", f"{ffast} - {fslow}")
    fsignal = f.ema("fsignal", fline, 9)
    speed = "pow((CASE WHEN path <= close - c5 OR abs(path) < 1e-14 THEN 1 ELSE abs((close - c5) / path) END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"
    kama = f.state("kama", "NULL::DOUBLE", f"CASE WHEN n <= 5 THEN close ELSE kama + (close - kama) * {speed} END")
    v = 0.7
    outs = {
        "dema4": f"2 * {e1} - {e2}", "tema4": f"3 * {e1} - 3 * {e2} + {e3}", "trix4": f"100 * ({third} / third - 1)",
        "t34": f"{-(v**3)} * {e6} + {3 * v * v + 3 * v**3} * {e5} + {-6 * v * v - 3 * v - 3 * v**3} * {e4} + {1 + 3 * v + v**3 + 3 * v * v} * {e3}",
        "macd": line, "macds": signal, "macdh": f"{line} - {signal}", "fix": fline, "fixs": fsignal, "fixh": f"{fline} - {fsignal}", "kama5": f"CASE WHEN n > 5 THEN {kama} END",
    }
    # the fixed line shows no value before its signal's first row
    directives = {
        "dema4": "dema:4", "tema4": "tema:4", "trix4": "trix:4", "t34": "t3:4", "macd": "macd:5,9", "macds": "macd.signal:5,9,4", "macdh": "macd.histogram:5,9,4", "fix": "macdfix", "fixs": "macdfix.signal:9", "fixh": "macdfix.histogram:9", "kama5": "kama:5",
    }
    fold_lines("recursive_averages_more", {c: (directives[c], c) for c in outs}, f.sql(_ROWS, outs))


def _strength() -> None:
    f = Fold()
    up, down = f.wilder("up", "CASE WHEN n > 1 THEN greatest(dc, 0) END", 5), f.wilder("down", "CASE WHEN n > 1 THEN greatest(-dc, 0) END", 5)
    rsi = f.let("rsi", f"CASE WHEN {up} + {down} = 0 THEN 0 ELSE 100 * {up} / ({up} + {down}) END")
    a = f.ema("ta", "dc", 5)
    b, c = f.ema("tb", a, 3), f.ema("tc", "abs(dc)", 5)
    d = f.ema("td", c, 3)
    sa, sc = f.ema("sa", "close - (top5 + low5) / 2", 3), f.ema("sc", "top5 - low5", 3)
    sb, sd = f.ema("sb", sa, 3), f.ema("sd", sc, 3)
    smi = f.let("smi", f"200 * {sb} / nullif({sd}, 0)")
    sms = f.ema("sms", smi, 3)
    raw = "CASE WHEN top <> bottom THEN 100 * (close - bottom) / (top - bottom) ELSE 0 END"
    k = f.state("kk", "50.0::DOUBLE", f"(1 - 1.0 / 3) * kk + ({raw}) / 3")
    j = f.state("kd", "50.0::DOUBLE", f"(1 - 1.0 / 3) * kd + {k} / 3")
    outs = {
        "cmo5": f"CASE WHEN {up} + {down} = 0 THEN 0 ELSE 100 * ({up} - {down}) / ({up} + {down}) END", "tsi": f"100 * {b} / nullif({d}, 0)", "smi": smi, "smis": sms, "k": k, "dd": j, "jj": f"3 * {k} - 2 * {j}",
        "rsi5": rsi, "ema5": f.ema("em", "close", 5), "smma5": f.wilder("sm", "close", 5),
    }
    outs = {f"x_{c}": e for c, e in outs.items()}
    stoch = f"CASE WHEN count(x_rsi5) {over(4)} = 4 THEN CASE WHEN max(x_rsi5) {over(4)} = min(x_rsi5) {over(4)} THEN 0 ELSE 100 * (x_rsi5 - min(x_rsi5) {over(4)}) / (max(x_rsi5) {over(4)} - min(x_rsi5) {over(4)}) END END"
    cells = {
        "cmo5": ("cmo:5", "x_cmo5"), "tsi": ("tsi:5,3", "x_tsi"), "smi": ("stoch_momentum:5,3,3", "x_smi"), "smis": ("stoch_momentum.signal:5,3,3", "x_smis"), "k": ("kdj.k:5", "x_k"), "dd": ("kdj.d:5", "x_dd"), "jj": ("kdj.j:5", "x_jj"),
        "rsi5": ("rsi:5", "x_rsi5"), "ema5": ("ema:5", "x_ema5"), "smma5": ("smma:5", "x_smma5"), "sk": ("stochrsi.k:5,4,3", "stk"), "sd": ("stochrsi.d:5,4,3", _mean("stk", 3)),
    }
    fold_lines("recursive_strength", cells, f.sql(_ROWS, outs).replace("o AS (SELECT r.*", "o0 AS (SELECT r.*") + f", o AS (SELECT *, {stoch} AS stk FROM o0)")


def _direction() -> None:
    f = Fold()
    p = 5
    sums = {}
    for name, x in (("plus", "rise"), ("minus", "fall"), ("span", "tr")):
        sums[name] = f.state(f"w_{name}", "0.0::DOUBLE", f"CASE WHEN n = 1 THEN 0 WHEN n <= {p} THEN w_{name} + {x} ELSE w_{name} - w_{name} / {p} + {x} END")
    dip, dim = (f.let(f"di_{s}", f"CASE WHEN n > {p} THEN CASE WHEN abs({sums['span']}) < 1e-14 THEN 0 ELSE 100 * {sums[s]} / {sums['span']} END END") for s in ("plus", "minus"))
    dxv = f.let("dxv", f"CASE WHEN abs({dip} + {dim}) >= 1e-14 THEN 100 * abs({dip} - {dim}) / ({dip} + {dim}) END")
    last = f.state("dxl", "0.0::DOUBLE", f"coalesce({dxv}, dxl)")
    n = f.state("adn", "0", f"adn + CASE WHEN {dip} IS NULL THEN 0 ELSE 1 END")
    adx = f.state("adv", "0.0::DOUBLE", f"CASE WHEN {dip} IS NULL THEN adv WHEN {n} < {p} THEN adv + coalesce({dxv}, 0) WHEN {n} = {p} AND adn < {p} THEN (adv + coalesce({dxv}, 0)) / {p} WHEN {dxv} IS NULL THEN adv ELSE (adv * {p - 1} + {dxv}) / {p} END")
    atr = f.wilder("trm", "tr", 4)
    mid = f.ema("mi", "close", 5)
    atr5 = f.wilder("a5", "tr", 5)
    hi, lo = f.let("st_hi", f"mid_ + 2 * {atr5}"), f.let("st_lo", f"mid_ - 2 * {atr5}")
    up = f.state("st_up", "NULL::DOUBLE", f"CASE WHEN {atr5} IS NULL THEN NULL WHEN st_up IS NULL THEN {hi} WHEN {hi} < st_up OR c1 > st_up THEN {hi} ELSE st_up END")
    bottom = f.state("st_bot", "NULL::DOUBLE", f"CASE WHEN {atr5} IS NULL THEN NULL WHEN st_bot IS NULL THEN {lo} WHEN {lo} > st_bot OR c1 < st_bot THEN {lo} ELSE st_bot END")
    trend = f.state("st_t", "NULL::DOUBLE", f"CASE WHEN {atr5} IS NULL THEN NULL WHEN st_t IS NULL THEN -1 WHEN st_t < 0 THEN CASE WHEN close > {up} THEN 1 ELSE -1 END ELSE CASE WHEN close < {bottom} THEN -1 ELSE 1 END END")
    outs = {
        "x_pdm": f"CASE WHEN n >= {p} THEN {sums['plus']} END", "x_mdm": f"CASE WHEN n >= {p} THEN {sums['minus']} END", "x_pdi": dip, "x_mdi": dim, "x_dx": f"CASE WHEN n > {p} THEN {last} END", "x_adx": f"CASE WHEN {n} >= {p} THEN {adx} END",
        "x_kup": f"{mid} + 2 * {atr}", "x_klo": f"{mid} - 2 * {atr}", "x_kw": f"4 * {atr} / {mid}", "x_mid": mid, "x_st": f"CASE WHEN {trend} > 0 THEN {bottom} ELSE {up} END", "x_dir": trend, "x_atr": atr5,
    }
    cells = {
        "pdm": ("plus_dm:5", "x_pdm"), "mdm": ("minus_dm:5", "x_mdm"), "pdi": ("plus_di:5", "x_pdi"), "mdi": ("minus_di:5", "x_mdi"), "dx": ("dx:5", "x_dx"), "adx": ("adx:5", "x_adx"), "adxr": ("adxr:5", f"(x_adx + lag(x_adx, 4) {_O}) / 2"),
        "kmid": ("keltner:5", "x_mid"), "kup": ("keltner.upper:5,4,2", "x_kup"), "klo": ("keltner.lower:5,4,2", "x_klo"), "kw": ("kcw:5,4,2", "x_kw"), "st": ("supertrend:5,2", "x_st"), "dir": ("supertrend.direction:5,2", "x_dir"),
        "atr5": ("atr:5", "x_atr"), "natr5": ("natr:5", "100 * x_atr / close"),
    }
    fold_lines("recursive_direction", cells, f.sql(_ROWS.replace("SELECT *, ", "SELECT *, (high + low) / 2 AS mid_, ", 1), outs))


def _volume() -> None:
    f = Fold()
    x = f.state("ax", "NULL::DOUBLE", "CASE WHEN n = 1 THEN flow ELSE ax + (flow - ax) * 2.0 / 4 END")
    y = f.state("ay", "NULL::DOUBLE", "CASE WHEN n = 1 THEN flow ELSE ay + (flow - ay) * 2.0 / 11 END")
    efi = f.ema("fo", "dc * vol", 5)
    a = f.ema("ma", "high - low", 9)
    b = f.ema("mb", a, 9)
    outs = {"x_ado": f"CASE WHEN n >= 10 THEN {x} - {y} END", "x_efi": efi, "x_mass": f"{a} / nullif({b}, 0)"}
    cells = {"ado": ("adosc:3,10", "x_ado"), "efi": ("efi:5", "x_efi"), "mass": ("mass_index:5", _total("x_mass", 5))}
    fold_lines("recursive_volume", cells, f.sql(_ROWS, outs), 1e2)


def _volume_indices() -> None:
    """Their values run over many powers of ten, so they are compared as logarithms."""
    side = "exp(sum(CASE WHEN volume {0} v1 THEN ln(close / c1) ELSE 0 END) " + _ALL + ")"
    cells = {"nvi": ("nvi", f"log10(1000 * {side.format('<')})"), "pvi": ("pvi", f"log10(1000 * {side.format('>')})")}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = daily(spark, sf_dir).indicators({c: d for c, (d, _) in cells.items()})
        return rounded(made.df.select("sym", "ts", *(F.log10(c).alias(c) for c in cells)))

    shown = ", ".join(f"{cut(e)} AS {c}" for c, (_, e) in cells.items())
    query("volume_indices", f"WITH {DAILY}, e AS (SELECT *, {_before('close', 1)} AS c1, {_before('volume', 1)} AS v1 FROM d) SELECT sym, ts, {shown} FROM e")(run)


_TAIL = "abs(c1 - o1) / 4"
_HC, _LC, _HL = "abs(high - c1)", "abs(low - c1)", "abs(high - low)"
_R = f"CASE WHEN {_HC} >= {_LC} AND {_HC} >= {_HL} THEN {_HC} - {_LC} / 2 + {_TAIL} WHEN {_LC} >= {_HC} AND {_LC} >= {_HL} THEN {_LC} - {_HC} / 2 + {_TAIL} ELSE {_HL} + {_TAIL} END"
_SWING = f"CASE WHEN c1 IS NULL OR ({_R}) = 0 THEN 0 ELSE 50 * ((close - c1) + (close - open) / 2 + (c1 - o1) / 4) / ({_R}) * greatest({_HC}, {_LC}) / 3 END"
lines("swing_index", {"asi": ("asi", f"sum({_SWING}) {_ALL}")}, f"e AS (SELECT *, {_before('close', 1)} AS c1, {_before('open', 1)} AS o1 FROM d)", "e", 1e2)
_averages()
_strength()
_direction()
_volume()
_volume_indices()


def _stops() -> None:
    f = Fold()
    h, low = f.let("hh", "CASE WHEN n = 2 THEN high ELSE h1 END"), f.let("bb", "CASE WHEN n = 2 THEN low ELSE l1 END")
    was = f.let("was", "CASE WHEN n = 2 THEN l1 - low > 0 AND l1 - low > high - h1 ELSE falls END")
    sar = f.let("sar_0", f"CASE WHEN n = 2 THEN CASE WHEN {was} THEN h1 ELSE l1 END ELSE stop END")
    ep = f.let("ep_0", f"CASE WHEN n = 2 THEN CASE WHEN {was} THEN low ELSE high END ELSE ep END")
    af = f.let("af_0", "CASE WHEN n = 2 THEN 0.02 ELSE af END")
    flip = f.let("flip", f"CASE WHEN {was} THEN high >= {sar} ELSE low <= {sar} END")
    out = f.let("out_0", f"CASE WHEN NOT {flip} THEN {sar} WHEN {was} THEN least({ep}, {low}, low) ELSE greatest({ep}, {h}, high) END")
    now = f.state("falls", "false", f"CASE WHEN {flip} THEN NOT {was} ELSE {was} END")
    ep1 = f.state("ep", "NULL::DOUBLE", f"CASE WHEN {flip} THEN CASE WHEN {now} THEN low ELSE high END WHEN NOT {was} AND high > {ep} THEN high WHEN {was} AND low < {ep} THEN low ELSE {ep} END")
    af1 = f.state("af", "0.02::DOUBLE", f"CASE WHEN {flip} THEN 0.02 WHEN {ep1} <> {ep} THEN least({af} + 0.02, 0.2) ELSE {af} END")
    f.state("stop", "NULL::DOUBLE", f"CASE WHEN {now} THEN greatest({out} + {af1} * ({ep1} - {out}), {h}, high) ELSE least({out} + {af1} * ({ep1} - {out}), {low}, low) END")
    up, down = f.wilder("up", "CASE WHEN n > 1 THEN greatest(dc, 0) END", 3), f.wilder("down", "CASE WHEN n > 1 THEN greatest(-dc, 0) END", 3)
    streak = f.state("streak", "0.0::DOUBLE", "CASE WHEN n = 1 THEN 0 WHEN close > c1 THEN greatest(streak, 0) + 1 WHEN close < c1 THEN least(streak, 0) - 1 ELSE 0 END")
    run_up, run_down = f.wilder("ru", f"CASE WHEN n > 1 THEN greatest({streak} - streak, 0) END", 2), f.wilder("rd", f"CASE WHEN n > 1 THEN greatest(streak - {streak}, 0) END", 2)
    place = "CASE WHEN len(rates) = 20 THEN 100 * len(list_filter(rates, lambda v: v < rate)) / 20 END"
    outs = {
        "x_sar": f"CASE WHEN n > 1 THEN {out} END", "x_ext": f"CASE WHEN n > 1 THEN {out} * CASE WHEN {now} THEN -1 ELSE 1 END END",
        "x_crsi": f"CASE WHEN n > 21 THEN (CASE WHEN {up} + {down} = 0 THEN 0 ELSE 100 * {up} / ({up} + {down}) END + CASE WHEN {run_up} + {run_down} = 0 THEN 0 ELSE 100 * {run_up} / ({run_up} + {run_down}) END + {place}) / 3 END",
    }
    rows = f"SELECT *, list(rate) FILTER (rate IS NOT NULL) OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rates FROM (SELECT *, (close / c1 - 1) * 100 AS rate FROM ({_ROWS}))"
    fold_lines("stops", {"sar": ("sar", "x_sar"), "ext": ("sarext", "x_ext"), "crsi": ("crsi:3,2,20", "x_crsi")}, f.sql(rows, outs))


_stops()

# The frame's methods, over the ticks of each user

_W = "PARTITION BY user_id ORDER BY ts, event_id"
_X = "(value / 500)"


def surface(name: str, made: Callable[[BarFrame], DataFrame], sql: dict[str, str], source: str = "events", extra: str = "", steps: float = STEPS, keys: str = "user_id, ts, event_id") -> None:
    """A query of keys and columns; sql: what each is over the events. Doubles are cut on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(made(ticks(spark, sf_dir)).select(*keys.split(", "), *(F.col(c) if e.startswith("!") else F.col(c).cast("double").alias(c) for c, e in sql.items())), steps)

    cells = "".join(f", {e[1:] if e.startswith('!') else cut(e, steps)} AS {c}" for c, e in sql.items())
    query(name, f"{extra}SELECT {keys}{cells} FROM {source} WINDOW w AS ({_W}), r AS ({_W} ROWS 6 PRECEDING), c AS ({_W} ROWS UNBOUNDED PRECEDING)")(run)


def _copies(f: BarFrame, names, of=None) -> BarFrame:
    return f.assign(**{n: (of or F.col("value")) for n in names})


surface(
    "frame_offsets",
    lambda f: _copies(f, ("a", "b", "d", "e", "s", "p", "t", "m")).shift(1, ["a"]).shift(-2, ["b"]).diff(2, ["d"]).diff(-1, ["e"]).cumsum(["s"]).assign(p=F.lit(1) + F.col("value") / 1000).cumprod(["p"]).cummax(["t"]).cummin(["m"]).df,
    {"a": "lag(value) OVER w", "b": "lead(value, 2) OVER w", "d": "value - lag(value, 2) OVER w", "e": "value - lead(value) OVER w", "s": "sum(value) OVER c", "p": "product(1 + value / 1000) OVER c", "t": "max(value) OVER c", "m": "min(value) OVER c"},
)
_MATH = {
    "acos": "acos(x)", "asin": "asin(x)", "atan": "atan(x)", "ceil": "ceil(value)", "cos": "cos(x)", "cosh": "(exp(x) + exp(-x)) / 2", "exp": "exp(x)", "floor": "floor(value)", "ln": "ln(x)", "log10": "log10(x)", "sin": "sin(x)", "sinh": "(exp(x) - exp(-x)) / 2",
    "sqrt": "sqrt(x)", "tan": "tan(x)", "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))",
}


def _math(f: BarFrame) -> DataFrame:
    for n in _MATH:
        f = f.assign(**{f"{n}_": F.col("value") if n in ("ceil", "floor") else F.col("value") / 500}).math(n, [f"{n}_"])
    f = _copies(f, ("ab", "cl", "rd")).assign(ab=F.col("value") - 50).abs(["ab"]).clip(20.0, 80.0, ["cl"]).round(1, ["rd"])
    return f.df


surface("frame_math", _math, {**{f"{n}_": e.replace("x)", f"{_X})").replace("-x", f"-{_X}") if "exp(-x" in e or "exp(x" in e else e.replace("(x)", _X) for n, e in _MATH.items()}, "ab": "abs(value - 50)", "cl": "least(greatest(value, 20), 80)", "rd": "round_even(value, 1)"})
_V3 = "CASE WHEN event_id % 3 <> 0 THEN value END"


def _operators(f: BarFrame) -> DataFrame:
    v, g, w = F.col("value"), F.when(F.col("event_id") % 3 != 0, F.col("value")), F.lit(7.5)
    p, q = F.col("value") > 50, F.col("event_id") % 2 == 0
    made = {"plus": v + w, "minus": v - w, "times": v * w, "over": F.when(F.abs(A.true_divide(v, F.floor(v / 100) - 1)) == A.INF, -1.0).otherwise(A.true_divide(v, F.floor(v / 100) - 1)), "whole": A.floor_divide(v, w)}
    made |= {n: A.compare(op, g, F.lit(12.31)) for n, op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))}
    made |= {"both": p & q, "either": p | q, "one": A.xor(p, q), "neither": ~p, "within": A.between(v, 20, 80), "left_": A.between(v, 20, 80, "left")}
    return f.df.select("user_id", "ts", "event_id", *(c.alias(n) for n, c in made.items()))


surface(
    "operators", _operators,
    {"plus": "value + 7.5", "minus": "value - 7.5", "times": "value * 7.5", "over": "CASE WHEN floor(value / 100) = 1 THEN -1 ELSE value / (floor(value / 100) - 1) END", "whole": "floor(value / 7.5)",
     **{n: f"!coalesce({_V3} {op} 12.31, {miss})" for n, op, miss in (("eq", "=", "false"), ("ne", "<>", "true"), ("lt", "<", "false"), ("le", "<=", "false"), ("gt", ">", "false"), ("ge", ">=", "false"))},
     "both": "!value > 50 AND event_id % 2 = 0", "either": "!value > 50 OR event_id % 2 = 0", "one": "!(value > 50) <> (event_id % 2 = 0)", "neither": "!NOT value > 50", "within": "!value BETWEEN 20 AND 80", "left_": "!value >= 20 AND value < 80"},
)


def _gaps(f: BarFrame) -> DataFrame:
    g = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    f = f.assign(na=g, ok=g, filled=g, first_=g, line=g, swapped=F.when(F.col("value") > 400, 400.0).otherwise(F.col("value")), member=F.floor(F.col("value")), put=F.col("value"), kept=F.col("value"))
    f = f.isna(["na"]).notna(["ok"]).fillna(-1.0, ["filled"]).fillna(-1.0, ["first_"], limit=2).interpolate(["line"]).replace(400.0, 0.0, ["swapped"]).isin([1, 2, 3], ["member"])
    return f.set_where(F.col("event_type") == "error", "put", -5.0).where(F.col("value") < 100, 100.0, ["kept"]).df


_NTH = "sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER c"
surface(
    "missing_values", _gaps,
    {"na": "!event_id % 3 = 0", "ok": "!event_id % 3 <> 0", "filled": f"coalesce({_V3}, -1)", "first_": f"CASE WHEN event_id % 3 = 0 AND {_NTH} <= 2 THEN -1 ELSE {_V3} END",
     "line": "CASE WHEN g IS NOT NULL THEN g ELSE av + (bv - av) * (n - an) / (bn - an) END", "swapped": "CASE WHEN value >= 400 THEN 0 ELSE value END", "member": "!floor(value) IN (1, 2, 3)", "put": "CASE WHEN event_type = 'error' THEN -5 ELSE value END", "kept": "least(value, 100)"},
    "gaps", f"WITH g0 AS (SELECT *, {_V3} AS g, row_number() OVER ({_W}) AS n FROM events), gaps AS (SELECT *, last_value(g IGNORE NULLS) OVER b AS av, first_value(g IGNORE NULLS) OVER f AS bv, last_value(CASE WHEN g IS NOT NULL THEN n END IGNORE NULLS) OVER b AS an, "
    f"first_value(CASE WHEN g IS NOT NULL THEN n END IGNORE NULLS) OVER f AS bn FROM g0 WINDOW b AS ({_W} ROWS UNBOUNDED PRECEDING), f AS ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ",
)


def _windows(f: BarFrame) -> DataFrame:
    w, e, v, k = f.rolling(7, min_periods=4), f.expanding(4), F.col("value"), F.col("event_id").cast("double") % 17
    a, b, mid = w.window, e.window, f.rolling(5, min_periods=5, center=True).window
    made = {"sk": a.skew(v), "ku": a.kurt(v), "nu": a.nunique(v), "ra": a.rank(v), "rp": a.rank(v, "min", False, True), "co": a.cov(v, k), "cr": a.corr(v, k), "ql": a.quantile(v, 0.3, "lower"), "qh": a.quantile(v, 0.3, "higher"), "ce": mid.mean(v)}
    made |= {f"e_{n}": getattr(b, n)(v) for n in ("count", "nunique", "min", "var", "sem", "median", "first", "last", "skew")} | {"e_cov": b.cov(v, k), "e_q": b.quantile(v, 0.6), "e_rank": b.rank(v)}
    return f.df.select("user_id", "ts", "event_id", *(c.alias(n) for n, c in made.items()))


def _listed(xs: str, least: int = 4) -> dict[str, str]:
    n, m = f"len({xs})", f"list_avg({xs})"
    p2, p3, p4 = (f"list_sum(list_transform({xs}, lambda v: pow(v - {m}, {k})))" for k in (2, 3, 4))
    gate = f"CASE WHEN {n} >= {least} THEN {{}} END"
    return {
        "skew": gate.format(f"CASE WHEN {p2} = 0 THEN 0 ELSE {n} * sqrt({n} - 1.0) / ({n} - 2) * {p3} / pow({p2}, 1.5) END"),
        "kurt": gate.format(f"CASE WHEN {p2} = 0 THEN -3 ELSE {n} * ({n} + 1.0) * ({n} - 1) / (({n} - 2.0) * ({n} - 3)) * {p4} / ({p2} * {p2}) - 3 * pow({n} - 1, 2) / (({n} - 2.0) * ({n} - 3)) END"),
        "nunique": gate.format(f"len(list_distinct({xs}))"), "rank": gate.format(f"len(list_filter({xs}, lambda v: v < value)) + (len(list_filter({xs}, lambda v: v = value)) + 1) / 2"),
        "below": gate.format(f"(len(list_filter({xs}, lambda v: v > value)) + 1) / {n}"), "lower": gate.format(f"list_sort({xs})[1 + CAST(floor(({n} - 1) * 0.3) AS INT)]"), "higher": gate.format(f"list_sort({xs})[1 + CAST(ceil(({n} - 1) * 0.3) AS INT)]"),
        "median": gate.format(f"list_median({xs})"), "q6": gate.format(f"list_aggregate({xs}, 'quantile_cont', 0.6)"), "count": gate.format(n),
    }


_R7, _E4 = _listed("xs"), _listed("es")
_GATE_R, _GATE_C = "CASE WHEN count(*) OVER r >= 4 THEN {} END", "CASE WHEN count(*) OVER c >= 4 THEN {} END"
surface(
    "windows_more", _windows,
    {"sk": _R7["skew"], "ku": _R7["kurt"], "nu": _R7["nunique"], "ra": _R7["rank"], "rp": _R7["below"], "co": _GATE_R.format("covar_samp(value, k) OVER r"), "cr": _GATE_R.format("corr(value, k) OVER r"), "ql": _R7["lower"], "qh": _R7["higher"],
     "ce": f"CASE WHEN count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN avg(value) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END",
     "e_count": _GATE_C.format("count(value) OVER c"), "e_nunique": _E4["nunique"], "e_min": _GATE_C.format("min(value) OVER c"), "e_var": _GATE_C.format("var_samp(value) OVER c"), "e_sem": _GATE_C.format("stddev_samp(value) OVER c / sqrt(count(*) OVER c)"),
     "e_median": _E4["median"], "e_first": _GATE_C.format("first_value(value) OVER c"), "e_last": _GATE_C.format("last_value(value) OVER c"), "e_skew": _E4["skew"], "e_cov": _GATE_C.format("covar_samp(value, k) OVER c"), "e_q": _E4["q6"], "e_rank": _E4["rank"]},
    "x", f"WITH x AS (SELECT *, event_id % 17 AS k, list(value) OVER ({_W} ROWS 6 PRECEDING) AS xs, list(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS es FROM events) ", 1e4,
)


def _ewm(f: BarFrame) -> DataFrame:
    f = _copies(f, ("m", "s", "va", "sd", "co", "cr", "bv", "un")).assign(k=F.col("event_id").cast("double") % 17)
    f = f.ewm("mean", ["m"], span=9).ewm("sum", ["s"], alpha=0.3).ewm("var", ["va"], com=3).ewm("std", ["sd"], halflife=2, min_periods=3).ewm("cov", ["co"], other="k", span=9).ewm("corr", ["cr"], other="k", span=9)
    return f.ewm("var", ["bv"], span=9, bias=True).ewm("mean", ["un"], span=9, adjust=False).df


def _decayed(a: str) -> dict[str, str]:
    """Sums over the series so far, each weighted by 1 - a to the power of its age."""
    n = "len(es)"
    sums = {"w": f"list_sum(list_transform(es, lambda v, i: pow(1 - {a}, {n} - i)))", "ww": f"list_sum(list_transform(es, lambda v, i: pow(1 - {a}, 2 * ({n} - i))))"}
    for name, e in (("x", "v"), ("k", "ks[i]"), ("xx", "v * v"), ("kk", "ks[i] * ks[i]"), ("xk", "v * ks[i]")):
        sums[name] = f"list_sum(list_transform(es, lambda v, i: ({e}) * pow(1 - {a}, {n} - i)))"
    return sums


def _spread(a: str, x: str = "x", y: str = "x", xy: str = "xx", bias: bool = False) -> str:
    d = _decayed(a)
    cov = f"({d[xy]} / {d['w']} - {d[x]} / {d['w']} * {d[y]} / {d['w']})"
    return cov if bias else f"CASE WHEN len(es) > 1 THEN {cov} * pow({d['w']}, 2) / (pow({d['w']}, 2) - {d['ww']}) END"


_D9 = _decayed("0.2")
surface(
    "ewm_all", _ewm,
    {"m": f"{_D9['x']} / {_D9['w']}", "s": _decayed("0.3")["x"], "va": _spread("0.25"), "sd": f"CASE WHEN len(es) >= 3 THEN sqrt({_spread('(1 - exp(-ln(2) / 2))')}) END", "co": _spread("0.2", "x", "k", "xk"),
     "cr": f"CASE WHEN {_spread('0.2', 'k', 'k', 'kk', True)} > 1e-9 THEN {_spread('0.2', 'x', 'k', 'xk', True)} / sqrt({_spread('0.2', bias=True)} * {_spread('0.2', 'k', 'k', 'kk', True)}) END", "bv": _spread("0.2", bias=True),
     "un": "list_sum(list_transform(es, lambda v, i: v * pow(0.8, len(es) - i) * CASE WHEN i = 1 THEN 1 ELSE 0.2 END))"},
    "x", f"WITH x AS (SELECT *, list(value) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS es, list(event_id % 17) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS ks FROM events) ", 1e4,
)
_DAY = "CAST(ts AS DATE)"
_TIMES = {
    "microsecond": "microsecond(ts) % 1000000", "nanosecond": "0", "dayofweek": "isodow(ts) - 1", "day_of_week": "isodow(ts) - 1", "isoweekday": "isodow(ts)", "day_of_year": "dayofyear(ts)", "weekofyear": "weekofyear(ts)", "daysinmonth": "day(last_day(ts))",
    "timestamp": "epoch_us(ts) / 1e6", "value": "epoch_us(ts)",
    "is_quarter_start": f"!{_DAY} = date_trunc('quarter', ts)", "is_quarter_end": f"!{_DAY} = date_trunc('quarter', ts) + INTERVAL 3 month - INTERVAL 1 day", "is_year_start": f"!{_DAY} = date_trunc('year', ts)", "is_year_end": "!strftime(ts, '%m-%d') = '12-31'",
    "is_leap_year": "!day(last_day(make_date(year(ts), 2, 1))) = 29", "normalize": "!date_trunc('day', ts)::TIMESTAMP", "isoformat": "!strftime(ts, '%Y-%m-%dT%H:%M:%S')", "time": "!strftime(ts, '%H:%M:%S.%f')", "date": f"!{_DAY}",
}


def _times(f: BarFrame) -> DataFrame:
    from .functions import datetimes as D

    ts = F.col("ts").cast("timestamp")
    made = {f"p_{n}": D.part(n, F.col("ts")) for n in _TIMES} | {"p_value": D.part("value", F.col("ts")) / 1000}
    made |= {"iso_year": D.part("isocalendar", F.col("ts"))["year"], "iso_week": D.part("isocalendar", F.col("ts"))["week"], "text": D.strftime(F.col("ts"), "%Y/%m/%d %H:%M:%S day %j %a %b")}
    made |= {"low": D.grid(ts, "15min", "floor"), "top": D.grid(ts, "2h", "ceil"), "near": D.grid(ts, "10s", "away"), "parsed": D.to_datetime(D.strftime(F.col("ts"), "%Y-%m-%d %H:%M:%S")), "epoch": D.to_datetime(F.unix_micros(ts), "us", numeric=True)}
    made |= {"there": D.tz_convert(ts, "America/New_York"), "back": D.tz_localize(F.col("ts"), "Europe/Berlin")}
    plain = ("p_normalize", "low", "top", "near", "parsed", "epoch", "there", "back")
    return f.df.select("user_id", "ts", "event_id", *((c.cast("timestamp_ntz") if n in plain else c).alias(n) for n, c in made.items()))


_GRID = "make_timestamp(CAST(floor(epoch_us(ts) / {0}.0) AS BIGINT) * {0})"
surface(
    "datetime_more", _times,
    {**{f"p_{n}": e for n, e in _TIMES.items()}, "iso_year": "isoyear(ts)", "iso_week": "weekofyear(ts)", "text": "!strftime(ts, '%Y/%m/%d %H:%M:%S day %j %a %b')", "low": "!" + _GRID.format(900_000_000),
     "top": "!make_timestamp(CAST(ceil(epoch_us(ts) / 7200000000.0) AS BIGINT) * 7200000000)", "near": "!make_timestamp(CAST(round(epoch_us(ts) / 10000000.0) AS BIGINT) * 10000000)", "parsed": "!date_trunc('second', ts)::TIMESTAMP", "epoch": "!ts::TIMESTAMP",
     "there": "!ts - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 hour ELSE INTERVAL 5 hour END",
     "back": "!ts - CASE WHEN ts >= TIMESTAMP '2024-03-31 02:00:00' AND ts < TIMESTAMP '2024-10-27 03:00:00' THEN INTERVAL 2 hour ELSE INTERVAL 1 hour END"},
    steps=1.0,
)


def frame_query(name: str, sql: str):
    """A query of a frame's method whose result has columns of its own."""

    def add(made: Callable[[BarFrame], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: rounded(made(ticks(spark, sf_dir)), 1e4))
        return made

    return add


_SK_ALL = "count(*) * sqrt(count(*) - 1.0) / (count(*) - 2) * sum(pow(value - m, 3)) / pow(sum(pow(value - m, 2)), 1.5)"
_KU_ALL = "count(*) * (count(*) + 1.0) * (count(*) - 1) / ((count(*) - 2.0) * (count(*) - 3)) * sum(pow(value - m, 4)) / pow(sum(pow(value - m, 2)), 2) - 3 * pow(count(*) - 1, 2) / ((count(*) - 2.0) * (count(*) - 3))"


@frame_query("reductions_more", f"SELECT user_id, {cut('product(1 + value / 1000)', 1e4)} AS p_prod, {cut(_SK_ALL, 1e4)} AS value_skew, {cut(_KU_ALL, 1e4)} AS value_kurt, {cut('quantile_cont(value, 0.3)', 1e4)} AS value_quantile, arg_min(ts, (value, epoch_us(ts))) AS value_idxmin, "
             "bool_or(value > 300) AS t_any, bool_and(value > 1) AS t_all FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id HAVING count(*) > 3")
def _(f):
    f = f.assign(p=1 + F.col("value") / 1000, t=F.col("value") > 300, u=F.col("value") > 1)
    a, b, c, d = f.reduce("prod", columns=["p"]), f.reduce("skew", "kurt", "quantile", "idxmin", "count", columns=["value"], q=0.3), f.reduce("any", columns=["t"]), f.reduce("all", columns=["u"]).withColumnRenamed("u_all", "t_all")
    return a.join(b, "user_id").join(c, "user_id").join(d, "user_id").filter("value_count > 3").drop("value_count")


@frame_query("descriptions", "SELECT user_id, count(*) AS value_count, " + ", ".join(f"{cut(e, 1e4)} AS value_{n}" for n, e in (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"), ("q25", "quantile_cont(value, 0.25)"), ("q50", "median(value)"), ("q75", "quantile_cont(value, 0.75)"), ("max", "max(value)"))) + " FROM events GROUP BY user_id")
def _(f):
    return f.describe(["value"])


_PAIRS = "SELECT user_id, x, y, {0} AS {1} FROM (SELECT user_id, 'value' AS x, 'k' AS y, value AS a, event_id % 17 AS b FROM events UNION ALL SELECT user_id, 'k', 'value', event_id % 17, value FROM events UNION ALL SELECT user_id, 'value', 'value', value, value FROM events UNION ALL SELECT user_id, 'k', 'k', event_id % 17, event_id % 17 FROM events) GROUP BY ALL"


@frame_query("correlations", _PAIRS.format(cut("corr(a, b)", 1e4), "corr"))
def _(f):
    return f.assign(k=(F.col("event_id") % 17).cast("double")).corr(["value", "k"])


@frame_query("covariances", _PAIRS.format(cut("covar_samp(a, b)", 1e4), "cov"))
def _(f):
    return f.assign(k=(F.col("event_id") % 17).cast("double")).cov(["value", "k"])


@frame_query("modes", "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n, max(count(*)) OVER (PARTITION BY user_id) AS top FROM events GROUP BY 1, 2) WHERE n = top")
def _(f):
    return f.mode("event_type")


@frame_query("uniques", "SELECT DISTINCT user_id, event_type FROM events")
def _(f):
    return f.unique("event_type")


@frame_query("value_shares", f"SELECT user_id, event_type, {cut('count(*) / sum(count(*)) OVER (PARTITION BY user_id)', 1e4)} AS count FROM events GROUP BY user_id, event_type")
def _(f):
    return f.value_counts("event_type", normalize=True)


@frame_query("monotonic_flags", f"SELECT user_id, bool_and(coalesce(event_id >= b, true)) AS is_monotonic_increasing, bool_and(coalesce(event_id <= b, true)) AS is_monotonic_decreasing, count(DISTINCT event_id) = count(*) AS is_unique FROM (SELECT *, lag(event_id) OVER ({_W}) AS b FROM events) GROUP BY user_id")
def _(f):
    return f.monotonic("event_id")


_N = f"row_number() OVER ({_W}) AS n, count(*) OVER (PARTITION BY user_id) AS m"


@frame_query("rows_by_position", f"SELECT user_id, ts, event_id, value, part FROM (SELECT *, {_N} FROM events), (VALUES ('head'), ('tail'), ('slice'), ('last'), ('picked')) t(part) WHERE (part = 'head' AND n <= 3) OR (part = 'tail' AND n > m - 2) OR (part = 'slice' AND n BETWEEN 3 AND 5) OR (part = 'last' AND n = m) OR (part = 'picked' AND n IN (1, 4))")
def _(f):
    parts = {"head": f.head(3), "tail": f.tail(2), "slice": f.iloc(slice(2, 5)), "last": f.iloc(-1), "picked": f.iloc([0, 3])}
    frames = [x.df.select("user_id", "ts", "event_id", "value", F.lit(n).alias("part")) for n, x in parts.items()]
    return functools.reduce(DataFrame.unionByName, frames)


_SPAN = "TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'"


@frame_query("rows_by_label", f"SELECT user_id, when_, event_id, CAST(floor(value) AS BIGINT) AS whole, position FROM (SELECT *, ts::TIMESTAMP AS when_, row_number() OVER ({_W}) - 1 AS position FROM events WHERE ts BETWEEN {_SPAN} AND value < 300 AND event_type <> 'error')")
def _(f):
    f = f.loc(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)).filter(F.col("value") < 300).assign(kind=F.when(F.col("event_type") != "error", F.col("event_type"))).dropna(subset=["kind"])
    f = f.rename({"ts": "when_"}).assign(whole=F.floor("value").cast("double")).astype({"whole": "long"}).drop("kind", "value", "event_type")
    return f.reset_index().df.select("user_id", "when_", "event_id", "whole", F.col("position").cast("long").alias("position"))


@frame_query("sorted_ends", "SELECT user_id, event_id, value, part FROM (SELECT *, 'most' AS part FROM events ORDER BY value DESC, user_id, ts, event_id LIMIT 15) UNION ALL SELECT user_id, event_id, value, part FROM (SELECT *, 'least' AS part FROM events ORDER BY value, user_id, ts, event_id LIMIT 15) "
             "UNION ALL SELECT user_id, event_id, value, part FROM (SELECT *, 'sorted' AS part FROM events ORDER BY value DESC, user_id, ts, event_id LIMIT 9) UNION ALL SELECT user_id, event_id, value, part FROM (SELECT *, 'indexed' AS part FROM events ORDER BY user_id, ts, event_id LIMIT 9)")
def _(f):
    parts = {"most": f.nlargest(15, "value"), "least": f.nsmallest(15, "value"), "sorted": f.sort_values("value", False).limit(9), "indexed": f.sort_index().limit(9)}
    return functools.reduce(DataFrame.unionByName, [x.select("user_id", "event_id", "value", F.lit(n).alias("part")) for n, x in parts.items()])


@frame_query("duplicate_flags", f"SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS early, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) > 1 AS late FROM events")
def _(f):
    return f.duplicated(["user_id", "event_type"], name="early").duplicated(["user_id", "event_type"], "last", "late").df.select("user_id", "ts", "event_id", "early", "late")


@frame_query("appended", "SELECT user_id, ts::TIMESTAMP AS ts, event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END AS value FROM events UNION ALL SELECT user_id, ts::TIMESTAMP + INTERVAL 400 day, event_id, value FROM events WHERE event_id % 50 = 1")
def _(f):
    f = f.over(f.df.select("user_id", "ts", "event_id", "value"))
    again = f.df.filter("event_id % 5 = 0").withColumn("value", F.lit(-1.0))
    later = f.df.filter("event_id % 50 = 1").withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS"))
    return f.append(again).append(later).df.select("user_id", "ts", "event_id", "value")


@frame_query("rank_methods", "SELECT user_id, ts, event_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in (
    ("low", "rank() OVER v"), ("high", "rank() OVER v + count(*) OVER (PARTITION BY user_id, floor(value / 10)) - 1"), ("first_", "row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10), ts, event_id)"), ("falling", "dense_rank() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC)"))) + f", {cut('rank() OVER v / count(*) OVER (PARTITION BY user_id)', 1e4)} AS share FROM events WINDOW v AS (PARTITION BY user_id ORDER BY floor(value / 10))")
def _(f):
    f = f.assign(t=F.floor(F.col("value") / 10).cast("double"))
    f = f.rank("t", "low", "min").rank("t", "high", "max").rank("t", "first_", "first").rank("t", "falling", "dense", ascending=False).rank("t", "share", "min", pct=True)
    return f.df.select("user_id", "ts", "event_id", "low", "high", "first_", "falling", "share")


@frame_query("folds_of_columns", f"WITH {HOURLY} SELECT user_id, date_trunc('day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(max(volume) AS BIGINT) AS busiest FROM h GROUP BY 1, 2")
def _(f):
    bars = BarFrame(bars_of_ticks(f.df, "1h", F.col("value"), key=["user_id"], tiebreak=["event_id"]), ("user_id",)).assign(busiest=F.col("volume"))
    return bars.cumulate("1d", {"busiest": "max"}).df


@frame_query("days_of_a_zone", "SELECT user_id, date_trunc('day', l) + CASE WHEN date_trunc('day', l) >= TIMESTAMP '2024-03-10 07:00:00' AND date_trunc('day', l) < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 hour ELSE INTERVAL 5 hour END AS ts, max(value) AS high, min(value) AS low, count(*) AS volume "
             "FROM (SELECT *, ts::TIMESTAMP - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 hour ELSE INTERVAL 5 hour END AS l FROM events) GROUP BY 1, 2")
def _(f):
    rows = f.df.withColumn("ts", F.col("ts").cast("timestamp"))
    bars = bars_of_ticks(rows, "1d", F.col("value"), key=["user_id"], tiebreak=["event_id"], tz="America/New_York")
    return bars.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "high", "low", "volume")
