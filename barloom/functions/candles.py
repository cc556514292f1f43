"""The 61 candlestick patterns, as comparisons of bars with the averages of the bars before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compiler import Compiler
from ..plans.registry import real, register

OHLC = ("open", "high", "low", "close")
#: Fixed values, per setting: what is averaged, over how many earlier bars (0: the bar itself), and its factor.
SETTINGS = {
    "body_long": ("body", 10, 1.0),
    "body_very_long": ("body", 10, 3.0),
    "body_short": ("body", 10, 1.0),
    "body_doji": ("range", 10, 0.1),
    "shadow_long": ("body", 0, 1.0),
    "shadow_very_long": ("body", 0, 2.0),
    "shadow_short": ("shadows", 10, 0.5),
    "shadow_very_short": ("range", 10, 0.1),
    "near": ("range", 5, 0.2),
    "far": ("range", 5, 0.6),
    "equal": ("range", 5, 0.05),
}


class Bar:
    """One bar of a pattern, seen from the current row; back: rows before it."""

    def __init__(self, candles: Candles, back: int):
        self.candles, self.back = candles, back

    def _value(self, name: str) -> Column:
        return self.candles.k.lag(self.candles.part(name), self.back)

    def __getattr__(self, name: str) -> Column:
        if name in SETTINGS:
            value = self.candles.k.lag(self.candles.setting(name), self.back)
        else:
            value = self._value(name)
        self.__dict__[name] = value
        return value

    @property
    def white(self) -> Column:
        return self.color == 1

    @property
    def black(self) -> Column:
        return self.color == -1

    @property
    def long(self) -> Column:
        return self.body > self.body_long

    @property
    def short(self) -> Column:
        return self.body <= self.body_short

    @property
    def doji(self) -> Column:
        return self.body <= self.body_doji

    @property
    def marubozu(self) -> Column:
        return self.long & (self.upper < self.shadow_very_short) & (self.lower < self.shadow_very_short)


class Candles:
    """The parts of bars, each a staged column."""

    def __init__(self, k: Compiler, o: Column, h: Column, low: Column, c: Column):
        self.k = k
        whole = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
        self.parts = {n: k.stage(F.when(whole, x)) for n, x in (("open", o), ("high", h), ("low", low), ("close", c))}

    def part(self, name: str) -> Column:
        if name not in self.parts:
            o, h, low, c = (self.parts[n] for n in OHLC)
            top, bottom = F.greatest(o, c), F.least(o, c)
            self.parts[name] = self.k.stage({
                "body": lambda: F.abs(c - o), "range": lambda: h - low, "upper": lambda: h - top, "lower": lambda: bottom - low, "shadows": lambda: (h - top) + (bottom - low),
                "top": lambda: top, "bottom": lambda: bottom, "color": lambda: F.when(c >= o, 1).when(c < o, -1), "middle": lambda: low + (h - low) / 2,
            }[name]())
        return self.parts[name]

    def setting(self, name: str) -> Column:
        key = f"setting {name}"
        if key not in self.parts:
            what, rows, factor = SETTINGS[name]
            x = self.part(what)
            frame = self.k.past(rows) if rows else None
            mean = F.when(F.count(x).over(frame) == rows, F.avg(x).over(frame)) if rows else x
            self.parts[key] = self.k.stage(mean * factor)
        return self.parts[key]

    def bars(self, n: int) -> list[Bar]:
        """The last n bars, oldest first."""
        return [Bar(self, back) for back in range(n - 1, -1, -1)]


def gap_up(later: Bar, earlier: Bar) -> Column:
    return later.bottom > earlier.top


def gap_down(later: Bar, earlier: Bar) -> Column:
    return later.top < earlier.bottom


def candle_gap_up(later: Bar, earlier: Bar) -> Column:
    return later.low > earlier.high


def candle_gap_down(later: Bar, earlier: Bar) -> Column:
    return later.high < earlier.low


def near(x: Column, y: Column, room: Column) -> Column:
    return (x >= y - room) & (x <= y + room)


PATTERNS: dict[str, tuple[int, int]] = {}


def pattern(name: str, bars: int, rows: int, *args):
    """bars: how many the pattern reads; rows: the averaging rows before the earliest bar that uses one, and its distance: the lookback."""

    def add(shape: Callable):
        PATTERNS[name] = (bars, rows)

        @register(f"cdl.{name}", args, OHLC, lambda *_: rows)
        def line(k: Compiler, *values):
            name = f"candles {[str(v._jc.toString()) for v in values[-4:]]}"
            shared = k.shared.setdefault(name, None) or Candles(k, *values[-4:])
            k.shared[name] = shared
            value = shape(*shared.bars(bars), *values[:-4])
            present = k.stage(F.count(shared.part("body")).over(k.rows(rows + 1)) == rows + 1, f"whole {rows}")
            return F.when(present, F.coalesce(value, F.lit(0)).cast("double"))

        return shape

    return add


def up(test: Column) -> Column:
    return F.when(test, 100)


def down(test: Column) -> Column:
    return F.when(test, -100)


def with_color(test: Column, bar: Bar, sign: int = 1) -> Column:
    return F.when(test, sign * 100 * bar.color)


# One bar


@pattern("doji", 1, 10)
def _(a):
    return up(a.doji)


@pattern("marubozu", 1, 10)
def _(a):
    return with_color(a.marubozu, a)


@pattern("closingmarubozu", 1, 10)
def _(a):
    return with_color(a.long & F.when(a.white, a.upper < a.shadow_very_short).otherwise(a.lower < a.shadow_very_short), a)


@pattern("longline", 1, 10)
def _(a):
    return with_color(a.long & (a.upper < a.shadow_short) & (a.lower < a.shadow_short), a)


@pattern("shortline", 1, 10)
def _(a):
    return with_color((a.body < a.body_short) & (a.upper < a.shadow_short) & (a.lower < a.shadow_short), a)


@pattern("highwave", 1, 10)
def _(a):
    return with_color((a.body < a.body_short) & (a.upper > a.shadow_very_long) & (a.lower > a.shadow_very_long), a)


@pattern("spinningtop", 1, 10)
def _(a):
    return with_color((a.body < a.body_short) & (a.upper > a.body) & (a.lower > a.body), a)


@pattern("dragonflydoji", 1, 10)
def _(a):
    return up(a.doji & (a.upper < a.shadow_very_short) & (a.lower > a.shadow_very_short))


@pattern("gravestonedoji", 1, 10)
def _(a):
    return up(a.doji & (a.lower < a.shadow_very_short) & (a.upper > a.shadow_very_short))


@pattern("longleggeddoji", 1, 10)
def _(a):
    return up(a.doji & ((a.lower > a.shadow_long) | (a.upper > a.shadow_long)))


@pattern("rickshawman", 1, 10)
def _(a):
    return up(a.doji & (a.lower > a.shadow_long) & (a.upper > a.shadow_long) & (a.bottom <= a.middle + a.near) & (a.top >= a.middle - a.near))


@pattern("belthold", 1, 10)
def _(a):
    return with_color(a.long & F.when(a.white, a.lower < a.shadow_very_short).otherwise(a.upper < a.shadow_very_short), a)


@pattern("takuri", 1, 10)
def _(a):
    return up(a.doji & (a.upper < a.shadow_very_short) & (a.lower > a.shadow_very_long))


# Two bars


def _hammer(b):
    return (b.body < b.body_short) & (b.lower > b.shadow_long) & (b.upper < b.shadow_very_short)


def _inverted(b):
    return (b.body < b.body_short) & (b.upper > b.shadow_long) & (b.lower < b.shadow_very_short)


@pattern("hammer", 2, 11)
def _(a, b):
    return up(_hammer(b) & (b.bottom <= a.low + a.near))


@pattern("hangingman", 2, 11)
def _(a, b):
    return down(_hammer(b) & (b.bottom >= a.high - a.near))


@pattern("invertedhammer", 2, 11)
def _(a, b):
    return up(_inverted(b) & gap_down(b, a))


@pattern("shootingstar", 2, 11)
def _(a, b):
    return down(_inverted(b) & gap_up(b, a))


def _engulfs(b, a):
    return (b.top >= a.top) & (b.bottom <= a.bottom) & ((b.top > a.top) | (b.bottom < a.bottom))


@pattern("engulfing", 2, 2)
def _(a, b):
    strict = (b.top > a.top) & (b.bottom < a.bottom)
    return F.when((a.color != b.color) & _engulfs(b, a), b.color * F.when(strict, 100).otherwise(80))


def _harami(a, b, small):
    inside = (b.top <= a.top) & (b.bottom >= a.bottom)
    strict = (b.top < a.top) & (b.bottom > a.bottom)
    return F.when(a.long & small & inside, -a.color * F.when(strict, 100).otherwise(80))


@pattern("harami", 2, 11)
def _(a, b):
    return _harami(a, b, b.short)


@pattern("haramicross", 2, 11)
def _(a, b):
    return _harami(a, b, b.doji)


@pattern("piercing", 2, 11)
def _(a, b):
    return up(a.black & a.long & b.white & b.long & (b.open < a.low) & (b.close < a.open) & (b.close > a.close + a.body * 0.5))


@pattern("darkcloudcover", 2, 11, real(0.5, 0))
def _(a, b, depth):
    return down(a.white & a.long & b.black & (b.open > a.high) & (b.close > a.open) & (b.close < a.close - a.body * depth))


@pattern("dojistar", 2, 11)
def _(a, b):
    return with_color(a.long & b.doji & F.when(a.white, gap_up(b, a)).otherwise(gap_down(b, a)), a, -1)


@pattern("homingpigeon", 2, 11)
def _(a, b):
    return up(a.black & a.long & b.black & b.short & (b.open < a.open) & (b.close > a.close))


@pattern("matchinglow", 2, 6)
def _(a, b):
    return up(a.black & b.black & near(b.close, a.close, a.equal))


def _neck(a, b):
    return a.black & a.long & b.white & (b.open < a.low)


@pattern("inneck", 2, 11)
def _(a, b):
    return down(_neck(a, b) & (b.close <= a.close + a.equal) & (b.close >= a.close))


@pattern("onneck", 2, 11)
def _(a, b):
    return down(_neck(a, b) & near(b.close, a.low, a.equal))


@pattern("thrusting", 2, 11)
def _(a, b):
    return down(_neck(a, b) & (b.close > a.close + a.equal) & (b.close <= a.close + a.body * 0.5))


def _kick(a, b):
    return (a.color != b.color) & a.marubozu & b.marubozu & F.when(a.black, candle_gap_up(b, a)).otherwise(candle_gap_down(b, a))


@pattern("kicking", 2, 11)
def _(a, b):
    return with_color(_kick(a, b), b)


@pattern("kickingbylength", 2, 11)
def _(a, b):
    return F.when(_kick(a, b), 100 * F.when(b.body > a.body, b.color).otherwise(a.color))


@pattern("separatinglines", 2, 11)
def _(a, b):
    belt = F.when(b.white, b.lower < b.shadow_very_short).otherwise(b.upper < b.shadow_very_short)
    return with_color((a.color != b.color) & near(b.open, a.open, a.equal) & b.long & belt, b)


@pattern("counterattack", 2, 11)
def _(a, b):
    return with_color((a.color != b.color) & a.long & b.long & near(b.close, a.close, a.equal), b)


# Three bars


def _morning(a, b, c, depth, middle):
    return up(a.long & a.black & middle & gap_down(b, a) & (c.body > c.body_short) & c.white & (c.close > a.close + a.body * depth))


def _evening(a, b, c, depth, middle):
    return down(a.long & a.white & middle & gap_up(b, a) & (c.body > c.body_short) & c.black & (c.close < a.close - a.body * depth))


@pattern("morningstar", 3, 12, real(0.3, 0))
def _(a, b, c, depth):
    return _morning(a, b, c, depth, b.short)


@pattern("eveningstar", 3, 12, real(0.3, 0))
def _(a, b, c, depth):
    return _evening(a, b, c, depth, b.short)


@pattern("morningdojistar", 3, 12, real(0.3, 0))
def _(a, b, c, depth):
    return _morning(a, b, c, depth, b.doji)


@pattern("eveningdojistar", 3, 12, real(0.3, 0))
def _(a, b, c, depth):
    return _evening(a, b, c, depth, b.doji)


@pattern("abandonedbaby", 3, 12, real(0.3, 0))
def _(a, b, c, depth):
    falls = a.white & c.black & (c.close < a.close - a.body * depth) & candle_gap_up(b, a) & candle_gap_down(c, b)
    rises = a.black & c.white & (c.close > a.close + a.body * depth) & candle_gap_down(b, a) & candle_gap_up(c, b)
    return with_color(a.long & b.doji & (c.body > c.body_short) & (falls | rises), c)


@pattern("3inside", 3, 12)
def _(a, b, c):
    out = (a.white & c.black & (c.close < a.open)) | (a.black & c.white & (c.close > a.open))
    return with_color(a.long & b.short & (b.top < a.top) & (b.bottom > a.bottom) & out, a, -1)


@pattern("3outside", 3, 3)
def _(a, b, c):
    rises = b.white & a.black & (b.close > a.open) & (b.open < a.close) & (c.close > b.close)
    falls = b.black & a.white & (b.open > a.close) & (b.close < a.open) & (c.close < b.close)
    return with_color(rises | falls, b)


@pattern("3whitesoldiers", 3, 12)
def _(a, b, c):
    shape = a.white & b.white & c.white & (c.close > b.close) & (b.close > a.close)
    for x in (a, b, c):
        shape = shape & (x.upper < x.shadow_very_short)
    for before, x in ((a, b), (b, c)):
        shape = shape & (x.open > before.open) & (x.open <= before.close + before.near) & (x.body > before.body - before.far)
    return up(shape & (c.body > c.body_short))


@pattern("3blackcrows", 4, 13)
def _(z, a, b, c):
    shape = z.white & a.black & b.black & c.black & (z.high > a.close) & (a.close > b.close) & (b.close > c.close)
    for x in (a, b, c):
        shape = shape & (x.lower < x.shadow_very_short)
    for before, x in ((a, b), (b, c)):
        shape = shape & (x.open < before.open) & (x.open > before.close)
    return down(shape)


@pattern("identical3crows", 3, 12)
def _(a, b, c):
    shape = a.black & b.black & c.black & (a.close > b.close) & (b.close > c.close)
    for x in (a, b, c):
        shape = shape & (x.lower < x.shadow_very_short)
    return down(shape & near(b.open, a.close, a.equal) & near(c.open, b.close, b.equal))


@pattern("2crows", 3, 12)
def _(a, b, c):
    return down(a.white & a.long & b.black & gap_up(b, a) & c.black & (c.open < b.open) & (c.open > b.close) & (c.close > a.open) & (c.close < a.close))


@pattern("upsidegap2crows", 3, 12)
def _(a, b, c):
    return down(a.white & a.long & b.black & b.short & gap_up(b, a) & c.black & (c.open > b.open) & (c.close < b.close) & (c.close > a.close))


@pattern("advanceblock", 3, 12)
def _(a, b, c):
    shape = a.white & b.white & c.white & (c.close > b.close) & (b.close > a.close) & a.long & (a.upper < a.shadow_short)
    for before, x in ((a, b), (b, c)):
        shape = shape & (x.open > before.open) & (x.open <= before.close + before.near)
    weak = (b.body < a.body - a.far) & (c.body < b.body + b.near)
    weaker = c.body < b.body - b.far
    shadowed = (c.body < b.body) & (b.body < a.body) & ((c.upper > c.shadow_short) | (b.upper > b.shadow_short))
    capped = (c.body < b.body) & (c.upper > c.shadow_long)
    return down(shape & (weak | weaker | shadowed | capped))


@pattern("stalledpattern", 3, 12)
def _(a, b, c):
    shape = a.white & b.white & c.white & (c.close > b.close) & (b.close > a.close) & a.long & b.long & (b.upper < b.shadow_very_short)
    return down(shape & (b.open > a.open) & (b.open <= a.close + a.near) & (c.body < c.body_short) & (c.open >= b.close - c.body - b.near))


@pattern("sticksandwich", 3, 7)
def _(a, b, c):
    return up(a.black & b.white & c.black & (b.low > a.close) & near(c.close, a.close, a.equal))


@pattern("tristar", 3, 12)
def _(a, b, c):
    dojis = (a.body <= a.body_doji) & (b.body <= a.body_doji) & (c.body <= a.body_doji)
    return F.when(dojis & gap_up(b, a) & (c.top < b.top), -100).when(dojis & gap_down(b, a) & (c.bottom > b.bottom), 100)


@pattern("unique3river", 3, 12)
def _(a, b, c):
    return up(a.long & a.black & b.black & (b.close > a.close) & (b.open <= a.open) & (b.low < a.low) & (c.body < c.body_short) & c.white & (c.open > b.low))


@pattern("gapsidesidewhite", 3, 7)
def _(a, b, c):
    rises, falls = gap_up(b, a) & gap_up(c, a), gap_down(b, a) & gap_down(c, a)
    same = b.white & c.white & near(c.body, b.body, b.near) & near(c.open, b.open, b.equal)
    return F.when(rises & same, 100).when(falls & same, -100)


@pattern("tasukigap", 3, 7)
def _(a, b, c):
    alike = F.abs(b.body - c.body) < b.near
    rises = gap_up(b, a) & b.white & c.black & (c.open < b.close) & (c.open > b.open) & (c.close < b.open) & (c.close > a.top)
    falls = gap_down(b, a) & b.black & c.white & (c.open < b.open) & (c.open > b.close) & (c.close > b.open) & (c.close < a.bottom)
    return with_color((rises | falls) & alike, b)


@pattern("3starsinsouth", 3, 12)
def _(a, b, c):
    shape = a.black & b.black & c.black & a.long & (a.lower > a.shadow_long)
    second = (b.body < a.body) & (b.open > a.close) & (b.open <= a.high) & (b.low < a.close) & (b.low >= a.low) & (b.lower > b.shadow_very_short)
    third = (c.body < c.body_short) & (c.lower < c.shadow_very_short) & (c.upper < c.shadow_very_short) & (c.low > b.low) & (c.high < b.high)
    return up(shape & second & third)


@pattern("xsidegap3methods", 3, 2)
def _(a, b, c):
    shape = (a.color == b.color) & (b.color == -c.color) & (c.open < b.top) & (c.open > b.bottom) & (c.close < a.top) & (c.close > a.bottom)
    return with_color(shape & F.when(a.white, gap_up(b, a)).otherwise(gap_down(b, a)), a)


# Four and five bars


@pattern("3linestrike", 4, 8)
def _(a, b, c, d):
    shape = (a.color == b.color) & (b.color == c.color) & (d.color == -c.color)
    for before, x in ((a, b), (b, c)):
        shape = shape & (x.open >= before.bottom - before.near) & (x.open <= before.top + before.near)
    rises = c.white & (c.close > b.close) & (b.close > a.close) & (d.open > c.close) & (d.close < a.open)
    falls = c.black & (c.close < b.close) & (b.close < a.close) & (d.open < c.close) & (d.close > a.open)
    return with_color(shape & (rises | falls), c)


@pattern("concealbabyswall", 4, 13)
def _(a, b, c, d):
    shape = a.black & b.black & c.black & d.black
    for x in (a, b):
        shape = shape & (x.lower < x.shadow_very_short) & (x.upper < x.shadow_very_short)
    return up(shape & gap_down(c, b) & (c.upper > c.shadow_very_short) & (c.high > b.close) & (d.high > c.high) & (d.low < c.low))


@pattern("breakaway", 5, 14)
def _(a, b, c, d, e):
    shape = a.long & (a.color == b.color) & (b.color == d.color) & (d.color == -e.color)
    falls = a.black & gap_down(b, a) & (c.high < b.high) & (c.low < b.low) & (d.high < c.high) & (d.low < c.low) & (e.close > b.open) & (e.close < a.close)
    rises = a.white & gap_up(b, a) & (c.high > b.high) & (c.low > b.low) & (d.high > c.high) & (d.low > c.low) & (e.close < b.open) & (e.close > a.close)
    return with_color(shape & (falls | rises), e)


@pattern("ladderbottom", 5, 14)
def _(a, b, c, d, e):
    shape = a.black & b.black & c.black & d.black & e.white & (a.open > b.open) & (b.open > c.open) & (a.close > b.close) & (b.close > c.close)
    return up(shape & (d.upper > d.shadow_very_short) & (e.open > d.open) & (e.close > d.high))


@pattern("mathold", 5, 14, real(0.5, 0))
def _(a, b, c, d, e, depth):
    shape = a.long & b.short & c.short & d.short & a.white & b.black & e.white & gap_up(b, a)
    for x in (c, d):
        shape = shape & (x.bottom < a.close) & (x.bottom > a.close - a.body * depth)
    falling = (c.top < b.open) & (d.top < c.top)
    return up(shape & falling & (e.open > d.close) & (e.close > F.greatest(b.high, c.high, d.high)))


@pattern("risefall3methods", 5, 14)
def _(a, b, c, d, e):
    shape = a.long & b.short & c.short & d.short & e.long & (a.color == -b.color) & (b.color == c.color) & (c.color == d.color) & (d.color == -e.color)
    for x in (b, c, d):
        shape = shape & (x.bottom < a.high) & (x.top > a.low)
    sign = a.color
    for later, before in ((c, b), (d, c)):  # against the first bar
        shape = shape & (later.close * sign < before.close * sign)
    return with_color(shape & (e.open * sign > d.close * sign) & (e.close * sign > a.close * sign), a)


def _hike(name, rows):
    @register(f"cdl.{name}", (), OHLC, lambda: rows, "recursive")
    def line(k, *values):
        shown = k.machine(name, (), *values)
        return F.when(k.position() >= rows, shown)


_hike("hikkake", 5)
_hike("hikkakemod", 10)


@register("cdl.bullish", (), ("open", "close"))
def bullish(k, o, c):
    return c > o


@register("cdl.bearish", (), ("open", "close"))
def bearish(k, o, c):
    return c < o
