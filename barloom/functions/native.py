"""Commands that are window frames, offsets and expressions: all of it runs in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.compiler import Compiler, correlation, divide
from ..plans.errors import DirectiveValueError
from ..plans.registry import Argument, average_lookback, m1, period, real, register

OHLC = ("open", "high", "low", "close")
HLC = ("high", "low", "close")
HL = ("high", "low")
TINY = 1e-14


def zero_if(test: Column, value: Column) -> Column:
    """0 where the test holds, else value; missing stays missing."""
    return F.when(test, F.lit(0.0)).otherwise(value)


def moving_average(k: Compiler, x: Column, n: int, kind: int) -> Column:
    if n == 1:
        return x
    if kind == 0:
        return k.sma(x, n)
    if kind == 2:
        return k.wma(x, n)
    if kind == 5:
        return triangular(k, x, n)
    name, args = {1: ("ema", (n,)), 3: ("dema", (n,)), 4: ("tema", (n,)), 6: ("kama", (n,)), 7: ("mama", (0.5, 0.05)), 8: ("t3", (n, 0.7))}[kind]
    return k.machine(name, args, x)


def triangular(k: Compiler, x: Column, n: int) -> Column:
    a, b = ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)
    return k.sma(k.sma(x, a), b)


MATYPE = Argument(0, 0, 8)


@register("ma", (period(), MATYPE), lookback=average_lookback)
def ma(k, n, kind, x):
    return moving_average(k, x, n, kind)


@register("wma", (period(),), lookback=m1)
def wma(k, n, x):
    return k.wma(x, n)


@register("trima", (period(),), lookback=m1)
def trima(k, n, x):
    return triangular(k, x, n)


@register("mavp", (period(), period(), MATYPE), ("close", "<periods>"), lambda low, high, kind: average_lookback(high, kind))
def mavp(k, low, high, kind, x, periods):
    if low > high:
        raise DirectiveValueError("mavp: the least period is over the largest")
    wanted = k.stage(F.least(F.greatest(F.floor(periods).cast("int"), F.lit(low)), F.lit(high)))
    ready = k.position() >= average_lookback(high, kind)
    picked = F.lit(None).cast("double")
    for n in range(high, low - 1, -1):
        picked = F.when(wanted == n, moving_average(k, x, n, kind)).otherwise(picked)
    return F.when(ready & periods.isNotNull(), picked)


@register("vwma", (period(),), ("close", "volume"), m1)
def vwma(k, n, x, v):
    return divide(k.total(x * v, n), k.total(v + x * 0, n))


@register("alma", (period(), real(0.85), real(6.0)), lookback=lambda p, *_: m1(p))
def alma(k, n, offset, sigma, x):
    middle, width = offset * (n - 1), n / sigma
    weights = [math.exp(-((i - middle) ** 2) / (2 * width * width)) for i in range(n)]
    return k.weighted(x, [w / sum(weights) for w in weights])


def _root(n: int) -> int:
    return max(1, int(math.floor(math.sqrt(n) + 0.5)))


@register("hma", (period(),), lookback=lambda p: m1(p) + m1(_root(p)))
def hma(k, n, x):
    return k.wma(2 * k.wma(x, max(1, n // 2)) - k.wma(x, n), _root(n))


def swma4(k: Compiler, x: Column) -> Column:
    x = k.stage(x)
    return (k.lag(x, 3) + 2 * k.lag(x, 2) + 2 * k.lag(x, 1) + x) / 6


@register("swma", lookback=lambda: 3)
def swma(k, x):
    return swma4(k, x)


@register("bbi", (period(3), period(6), period(12), period(24)), lookback=lambda *p: m1(max(p)))
def bbi(k, a, b, c, d, x):
    return (k.sma(x, a) + k.sma(x, b) + k.sma(x, c) + k.sma(x, d)) / 4


@register("bias", (period(6),), lookback=m1)
def bias(k, n, x):
    mean = k.sma(x, n)
    return zero_if(mean == 0, divide(x - mean, mean) * 100)


@register("dma", (period(10), period(50)), lookback=lambda a, b: m1(max(a, b)), aliases="ddd")
def dma(k, a, b, x):
    return k.sma(x, a) - k.sma(x, b)


@register("dma.ama", (period(10), period(50), period(10)), lookback=lambda a, b, m: m1(max(a, b)) + m1(m))
def dma_ama(k, a, b, m, x):
    return k.sma(dma(k, a, b, x), m)


@register("dkx", (), OHLC, lambda: 19)
def dkx(k, o, h, low, c):
    return k.wma((3 * c + low + o + h) / 6, 20)


@register("dkx.ma", (period(10),), OHLC, lambda m: 18 + m)
def dkx_ma(k, m, o, h, low, c):
    return k.sma(dkx(k, o, h, low, c), m)


@register("midpoint", (period(),), lookback=m1)
def midpoint(k, n, x):
    return (k.highest(x, n) + k.lowest(x, n)) / 2


def middle(k: Compiler, h: Column, low: Column, n: int) -> Column:
    return (k.highest(h, n) + k.lowest(low, n)) / 2


@register("midprice", (period(),), HL, m1)
def midprice(k, n, h, low):
    return middle(k, h, low, n)


# Bands and channels


@register("boll", (period(20),), lookback=m1, aliases="middle m")
def boll(k, n, x):
    return k.sma(x, n)


def deviation(k: Compiler, x: Column, n: int) -> Column:
    return k.over(F.stddev_pop, x, n)


@register("boll.upper", (period(20), real(2.0)), lookback=lambda p, _: m1(p), aliases="u")
def boll_upper(k, n, times, x):
    return k.sma(x, n) + times * deviation(k, x, n)


@register("boll.lower", (period(20), real(2.0)), lookback=lambda p, _: m1(p), aliases="l")
def boll_lower(k, n, times, x):
    return k.sma(x, n) - times * deviation(k, x, n)


@register("bbw", (period(20),), lookback=m1)
def bbw(k, n, x):
    return divide(4 * deviation(k, x, n), k.sma(x, n))


@register("accbands", (period(20),), lookback=m1, aliases="middle m")
def accbands(k, n, c):
    return k.sma(c, n)


def _edge(x: Column, h: Column, low: Column, sign: int) -> Column:
    return F.when(h + low == 0, x).otherwise(x * (1 + sign * divide(4 * (h - low), h + low)))


@register("accbands.upper", (period(20),), HL, m1, aliases="u")
def accbands_upper(k, n, h, low):
    return k.sma(_edge(h, h, low, 1), n)


@register("accbands.lower", (period(20),), HL, m1, aliases="l")
def accbands_lower(k, n, h, low):
    return k.sma(_edge(low, h, low, -1), n)


@register("donchian", (period(),), HL, m1, aliases="middle m")
def donchian(k, n, h, low):
    return middle(k, h, low, n)


@register("donchian.upper", (period(),), ("high",), m1, aliases="u")
@register("hhv", (period(),), ("high",), m1)
def hhv(k, n, h):
    return k.highest(h, n)


@register("donchian.lower", (period(),), ("low",), m1, aliases="l")
@register("llv", (period(),), ("low",), m1)
def llv(k, n, low):
    return k.lowest(low, n)


@register("ttm_squeeze", (period(20), real(2.0), real(1.5)), HLC, lambda p, *_: 2 * m1(p))
def ttm_squeeze(k, n, bb, kc, h, low, c):
    return regression(k, c - (middle(k, h, low, n) + k.sma(c, n)) / 2, n)[2]


@register("ttm_squeeze.on", (period(20), real(2.0), real(1.5)), HLC, lambda p, *_: p)
def ttm_squeeze_on(k, n, bb, kc, h, low, c):
    spread, room = k.stage(deviation(k, c, n)), k.stage(k.sma(true_range(k, h, low, c), n))
    return F.when(spread.isNotNull() & room.isNotNull(), F.when(bb * spread < kc * room, 1.0).otherwise(0.0))


@register("ichimoku.tenkan", (period(9), period(26), period(52)), HLC, lambda t, b, s: m1(t), aliases="conversion")
def tenkan(k, t, b, s, h, low, c):
    return middle(k, h, low, t)


@register("ichimoku.kijun", (period(9), period(26), period(52)), HLC, lambda t, b, s: m1(b), aliases="base")
def kijun(k, t, b, s, h, low, c):
    return middle(k, h, low, b)


@register("ichimoku.senkou_a", (period(9), period(26), period(52)), HLC, lambda t, b, s: m1(max(t, b)) + b, aliases="span_a")
def senkou_a(k, t, b, s, h, low, c):
    return k.lag((middle(k, h, low, t) + middle(k, h, low, b)) / 2, b)


@register("ichimoku.senkou_b", (period(9), period(26), period(52)), HLC, lambda t, b, s: m1(s) + b, aliases="span_b")
def senkou_b(k, t, b, s, h, low, c):
    return k.lag(middle(k, h, low, s), b)


@register("ichimoku.chikou", (period(9), period(26), period(52)), HLC, aliases="lagging")
def chikou(k, t, b, s, h, low, c):
    return c


def _mike(name, of):
    @register(f"mike.{name}", (period(),), HLC, m1)
    def line(k, n, h, low, c):
        return of((h + low + c) / 3, k.highest(h, n), k.lowest(low, n))


_mike("weakr", lambda t, h, low: t + (t - low))
_mike("midr", lambda t, h, low: t + (h - low))
_mike("strongr", lambda t, h, low: 2 * h - low)
_mike("weaks", lambda t, h, low: t - (h - t))
_mike("mids", lambda t, h, low: t - (h - low))
_mike("strongs", lambda t, h, low: 2 * low - h)


def _prior(name, of, aliases=""):
    @register(name, (), HLC, lambda: 1, aliases=aliases)
    def line(k, h, low, c):
        return of(k.lag(h), k.lag(low), k.lag(c))


def _cdp(h, low, c):
    return (h + low + 2 * c) / 4


def _pp(h, low, c):
    return (h + low + c) / 3


_prior("cdp", _cdp)
_prior("cdp.ah", lambda h, low, c: _cdp(h, low, c) + (h - low))
_prior("cdp.nh", lambda h, low, c: 2 * _cdp(h, low, c) - low)
_prior("cdp.nl", lambda h, low, c: 2 * _cdp(h, low, c) - h)
_prior("cdp.al", lambda h, low, c: _cdp(h, low, c) - (h - low))
_prior("pivot_points", _pp, "p pp")
_prior("pivot_points.r1", lambda h, low, c: 2 * _pp(h, low, c) - low)
_prior("pivot_points.r2", lambda h, low, c: _pp(h, low, c) + (h - low))
_prior("pivot_points.r3", lambda h, low, c: h + 2 * (_pp(h, low, c) - low))
_prior("pivot_points.s1", lambda h, low, c: 2 * _pp(h, low, c) - h)
_prior("pivot_points.s2", lambda h, low, c: _pp(h, low, c) - (h - low))
_prior("pivot_points.s3", lambda h, low, c: low - 2 * (h - _pp(h, low, c)))


def _pivot(name, series, sign):
    @register(name, (period(), period()), (series,), lambda left, right: left + right)
    def line(k, left, right, x):
        x = k.stage(x)
        centre = k.lag(x, right)
        after = F.max(sign * x).over(k.rows(right))
        before = F.max(sign * x).over(k.w0.rowsBetween(-(left + right), -right - 1))
        return k.full(x, left + right + 1, F.when((sign * centre > after) & (sign * centre > before), centre))


_pivot("pivothigh", "high", 1)
_pivot("pivotlow", "low", -1)


# Momentum


@register("mom", (period(),), lookback=lambda p: p)
def mom(k, n, x):
    return x - k.lag(x, n)


def _rate(name, of):
    @register(name, (period(),), lookback=lambda p: p)
    def line(k, n, x):
        base = k.lag(x, n)
        return F.when((base == 0) & x.isNotNull(), F.lit(0.0)).otherwise(of(divide(x, base)))


_rate("roc", lambda r: (r - 1) * 100)
_rate("rocp", lambda r: r - 1)
_rate("rocr", lambda r: r)
_rate("rocr100", lambda r: r * 100)


@register("change", (period(2, 2),), lookback=m1)
def change(k, n, x):
    return divide(x, k.lag(x, n - 1)) - 1


@register("dpo", (period(),), lookback=lambda p: max(m1(p), p // 2 + 1))
def dpo(k, n, x):
    return k.lag(x, n // 2 + 1) - k.sma(x, n)


def roc(k: Compiler, x: Column, n: int) -> Column:
    return (divide(x, k.lag(x, n)) - 1) * 100


@register("kst", lookback=lambda: 44)
def kst(k, x):
    return sum((w * k.sma(roc(k, x, r), n) for w, r, n in ((2, 15, 10), (3, 20, 10), (4, 30, 15))), k.sma(roc(k, x, 10), 10))


@register("coppock", (period(10), period(14), period(11)), lookback=lambda w, a, b: max(a, b) + m1(w))
def coppock(k, w, a, b, x):
    return k.wma(roc(k, x, a) + roc(k, x, b), w)


@register("relative_vigor", (period(10),), OHLC, lambda p: p + 2)
def relative_vigor(k, n, o, h, low, c):
    return divide(k.sma(swma4(k, c - o), n), k.sma(swma4(k, h - low), n))


@register("relative_vigor.signal", (period(10),), OHLC, lambda p: p + 5)
def relative_vigor_signal(k, n, o, h, low, c):
    return swma4(k, relative_vigor(k, n, o, h, low, c))


@register("bop", (), OHLC)
def bop(k, o, h, low, c):
    return zero_if(h - low < TINY, divide(c - o, h - low)) + o * 0


@register("willr", (period(),), HLC, m1)
def willr(k, n, h, low, c):
    top, bottom = k.highest(h, n), k.lowest(low, n)
    return zero_if((top == bottom) & c.isNotNull(), (top - c) * divide(F.lit(-100.0), top - bottom))


@register("cci", (period(least=2),), HLC, m1)
def cci(k, n, h, low, c):
    typical = k.stage((h + low + c) / 3)
    away = typical - k.sma(typical, n)
    spread = mean_deviation(k, typical, n)
    return zero_if((spread == 0) | (away == 0), divide(away, 0.015 * spread))


def mean_deviation(k: Compiler, x: Column, n: int) -> Column:
    a = k.values(x, n)
    mean = k.stage(F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n)
    return k.stage(F.when(a.isNotNull(), F.aggregate(a, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / n))


@register("imi", (period(),), ("open", "close"), m1)
def imi(k, n, o, c):
    up, down = k.total(F.greatest(c - o, F.lit(0.0)) + (c - o) * 0, n), k.total(F.greatest(o - c, F.lit(0.0)) + (c - o) * 0, n)
    return 100 * divide(up, up + down)


@register("mfi", (period(),), ("high", "low", "close", "volume"), lambda p: p)
def mfi(k, n, h, low, c, v):
    typical = k.stage((h + low + c) / 3)
    move, flow = k.stage(typical - k.lag(typical)), typical * v
    flow = k.stage(F.when(move.isNotNull(), flow))
    up = k.total(F.when(move > 0, flow).otherwise(flow * 0), n)
    down = k.total(F.when(move < 0, flow).otherwise(flow * 0), n)
    return zero_if(up + down == 0, 100 * divide(up, up + down))


@register("ultosc", (period(7), period(14), period(28)), HLC, lambda *p: max(p))
def ultosc(k, a, b, c3, h, low, c):
    before = k.stage(k.lag(c))
    whole = before.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
    pressure = k.stage(F.when(whole, c - F.least(low, before)))
    span = k.stage(F.when(whole, F.greatest(h, before) - F.least(low, before)))

    def ratio(n):
        room = k.total(span, n)
        return zero_if(room == 0, divide(k.total(pressure, n), room))

    return 100 * (4 * ratio(a) + 2 * ratio(b) + ratio(c3)) / 7


def raw_k(k: Compiler, n: int, h: Column, low: Column, c: Column) -> Column:
    top, bottom = k.highest(h, n), k.lowest(low, n)
    return zero_if((top == bottom) & c.isNotNull(), 100 * divide(c - bottom, top - bottom))


@register("rsv", (period(),), HLC, m1)
def rsv(k, n, h, low, c):
    return raw_k(k, n, h, low, c)


@register("stochf.k", (period(5), period(3), MATYPE), HLC, lambda a, *_: m1(a), aliases="fastk")
def stochf_k(k, a, b, kind, h, low, c):
    return raw_k(k, a, h, low, c)


@register("stochf.d", (period(5), period(3), MATYPE), HLC, lambda a, b, kind: m1(a) + average_lookback(b, kind), aliases="fastd")
def stochf_d(k, a, b, kind, h, low, c):
    return moving_average(k, raw_k(k, a, h, low, c), b, kind)


_STOCH = (period(5), period(3), MATYPE, period(3), MATYPE)


@register("stoch.k", _STOCH, HLC, lambda a, b, kb, d, kd: m1(a) + average_lookback(b, kb), aliases="slowk")
def stoch_k(k, a, b, kb, d, kd, h, low, c):
    return moving_average(k, raw_k(k, a, h, low, c), b, kb)


@register("stoch.d", _STOCH, HLC, lambda a, b, kb, d, kd: m1(a) + average_lookback(b, kb) + average_lookback(d, kd), aliases="slowd")
def stoch_d(k, a, b, kb, d, kd, h, low, c):
    return moving_average(k, stoch_k(k, a, b, kb, d, kd, h, low, c), d, kd)


@register("stochrsi.k", (period(14), period(5), period(3), MATYPE), lookback=lambda r, a, *_: r + m1(a), aliases="fastk")
def stochrsi_k(k, r, a, b, kind, x):
    strength = k.stage(k.machine("rsi", (r,), x))
    return raw_k(k, a, strength, strength, strength)


@register("stochrsi.d", (period(14), period(5), period(3), MATYPE), lookback=lambda r, a, b, kind: r + m1(a) + average_lookback(b, kind), aliases="fastd")
def stochrsi_d(k, r, a, b, kind, x):
    return moving_average(k, stochrsi_k(k, r, a, b, kind, x), b, kind)


def _age(k: Compiler, x: Column, n: int, sign: int) -> Column:
    """Rows since the latest extreme of the last n + 1 rows."""
    x = k.stage(x)
    place = k.position()
    at = F.max_by(place, F.struct(sign * x, place)).over(k.rows(n + 1))
    return k.full(x, n + 1, place - at)


@register("aroon.up", (period(least=2),), HL, lambda p: p, aliases="u")
def aroon_up(k, n, h, low):
    return k.full(k.stage(low), n + 1, 100.0 * (n - _age(k, h, n, 1)) / n)


@register("aroon.down", (period(least=2),), HL, lambda p: p, aliases="d")
def aroon_down(k, n, h, low):
    return k.full(k.stage(h), n + 1, 100.0 * (n - _age(k, low, n, -1)) / n)


@register("aroonosc", (period(least=2),), HL, lambda p: p)
def aroonosc(k, n, h, low):
    return 100.0 * (_age(k, low, n, -1) - _age(k, h, n, 1)) / n


@register("psy", (period(12),), lookback=lambda p: p)
def psy(k, n, x):
    x = k.stage(x)
    return 100 * k.sma(F.when(x > k.lag(x), 1.0).when(x <= k.lag(x), 0.0), n)


@register("chop", (period(least=2),), HLC, lambda p: p)
def chop(k, n, h, low, c):
    ratio = divide(k.total(true_range(k, h, low, c), n), k.highest(h, n) - k.lowest(low, n))
    return 100 * F.when(ratio > 0, F.log10(ratio)) / math.log10(n)


@register("cog", (period(least=2),), lookback=m1)
def cog(k, n, x):
    return -divide(k.weighted(x, range(n, 0, -1)), k.total(x, n))


@register("rci", (period(),), lookback=m1)
def rci(k, n, x):
    a = k.values(x, n)
    ranks = F.transform(a, lambda v: F.size(F.filter(a, lambda u: u < v)) + (F.size(F.filter(a, lambda u: u == v)) + 1) / 2)
    ranks = k.stage(F.when(a.isNotNull(), ranks))
    mean = (n + 1) / 2
    cross = F.aggregate(F.transform(ranks, lambda r, i: (r - mean) * (i + 1 - mean)), F.lit(0.0), lambda s, v: s + v)
    own = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + (r - mean) * (r - mean))
    time = n * (n * n - 1) / 12
    return F.when(own > 0, 100 * cross / F.sqrt(own * time)) if time else F.lit(None).cast("double")


# Moving-average oscillators


def _pair(k, x, a, ka, b, kb):
    if b < a:
        a, ka, b, kb = b, ka, a, kb
    return moving_average(k, x, a, ka), moving_average(k, x, b, kb)


@register("apo", (period(12), period(26), MATYPE), lookback=lambda a, b, kind: max(average_lookback(a, kind), average_lookback(b, kind)))
def apo(k, a, b, kind, x):
    fast, slow = _pair(k, x, a, kind, b, kind)
    return fast - slow


@register("ppo", (period(12), period(26), MATYPE), lookback=lambda a, b, kind: max(average_lookback(a, kind), average_lookback(b, kind)))
def ppo(k, a, b, kind, x):
    fast, slow = _pair(k, x, a, kind, b, kind)
    return zero_if(slow == 0, 100 * divide(fast - slow, slow))


_EXT = (period(12), MATYPE, period(26), MATYPE)


def _ext_lookback(a, ka, b, kb, *signal):
    return max(average_lookback(a, ka), average_lookback(b, kb)) + (average_lookback(*signal) if signal else 0)


@register("macdext", _EXT, lookback=_ext_lookback, aliases="dif")
def macdext(k, a, ka, b, kb, x):
    fast, slow = _pair(k, x, a, ka, b, kb)
    return fast - slow


@register("macdext.signal", (*_EXT, period(9), MATYPE), lookback=_ext_lookback, aliases="s dea")
def macdext_signal(k, a, ka, b, kb, s, ks, x):
    return moving_average(k, k.stage(macdext(k, a, ka, b, kb, x)), s, ks)


@register("macdext.histogram", (*_EXT, period(9), MATYPE), lookback=_ext_lookback, aliases="h macd")
def macdext_histogram(k, a, ka, b, kb, s, ks, x):
    line = k.stage(macdext(k, a, ka, b, kb, x))
    return line - moving_average(k, line, s, ks)


# Trend strength and volatility


def true_range(k: Compiler, h: Column, low: Column, c: Column) -> Column:
    before = k.lag(c)
    return k.stage(F.when(before.isNotNull() & h.isNotNull() & low.isNotNull(), F.greatest(h - low, F.abs(before - h), F.abs(before - low))))


@register("tr", (), HLC, lambda: 1)
def tr(k, h, low, c):
    return true_range(k, h, low, c)


@register("vortex.plus", (period(14),), HLC, lambda p: p, aliases="p")
def vortex_plus(k, n, h, low, c):
    return divide(k.total(F.abs(h - k.lag(low)), n), k.total(true_range(k, h, low, c), n))


@register("vortex.minus", (period(14),), HLC, lambda p: p, aliases="m")
def vortex_minus(k, n, h, low, c):
    return divide(k.total(F.abs(low - k.lag(h)), n), k.total(true_range(k, h, low, c), n))


#: Minutes of the time frames.
FRAME_MINUTES = {"1s": 1 / 60, "1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "2h": 120, "4h": 240, "6h": 360, "8h": 480, "12h": 720}
FRAME_DAYS = {"1d": 1, "3d": 3, "1w": 7, "1M": 30, "1y": 365}


@register("hv", (period(), Argument("1d", kind="frame"), real(252.0, 0), real(1440.0, 0)), lookback=lambda p, *_: p)
def hv(k, n, frame, days, session, x):
    if frame in FRAME_MINUTES:
        a_year = days * session / FRAME_MINUTES[frame]
    elif frame in FRAME_DAYS:
        a_year = {"1d": days, "3d": days / 3, "1w": 52.0, "1M": 12.0, "1y": 1.0}[frame]
    else:
        raise DirectiveValueError(f"hv: {frame} is no time frame")
    ratio = k.stage(divide(x, k.lag(x)))
    return k.over(F.stddev_samp, F.when(ratio > 0, F.ln(ratio)), n) * math.sqrt(a_year)


@register("avgprice", (), OHLC)
def avgprice(k, o, h, low, c):
    return (o + h + low + c) / 4


@register("medprice", (), HL)
def medprice(k, h, low):
    return (h + low) / 2


@register("typprice", (), HLC)
def typprice(k, h, low, c):
    return (h + low + c) / 3


@register("wclprice", (), HLC)
def wclprice(k, h, low, c):
    return (h + low + 2 * c) / 4


# Volume


def running(k: Compiler, x: Column) -> Column:
    """The sum so far; missing where x is."""
    x = k.stage(x)
    return F.when(x.isNotNull(), F.sum(x).over(k.all))


def complete(k: Compiler, *inputs: Column):
    """The inputs' previous complete row: values of the last earlier row where none is missing."""
    whole = inputs[0].isNotNull()
    for x in inputs[1:]:
        whole = whole & x.isNotNull()
    rows = k.stage(F.when(whole, F.struct(*(x.alias(f"x{i}") for i, x in enumerate(inputs)))))
    before = k.stage(F.last(rows, ignorenulls=True).over(k.w0.rowsBetween(-(1 << 31) + 1, -1)))
    return whole, [before[f"x{i}"] for i in range(len(inputs))]


@register("obv", (), ("close", "volume"), kind="recursive")
def obv(k, c, v):
    whole, (before, _) = complete(k, c, v)
    return running(k, F.when(whole, F.when(before.isNull() | (c > before), v).when(c < before, -v).otherwise(0.0)))


def money_flow(h: Column, low: Column, c: Column, v: Column) -> Column:
    return F.when(h - low > 0, divide((c - low) - (h - c), h - low) * v).otherwise((h - low) * c * v * 0)


@register("ad", (), ("high", "low", "close", "volume"), kind="recursive")
def ad(k, h, low, c, v):
    return running(k, money_flow(h, low, c, v))


@register("pvt", (), ("close", "volume"), kind="recursive")
def pvt(k, c, v):
    whole, (before, _) = complete(k, c, v)
    return running(k, F.when(whole, F.coalesce(divide(c - before, before) * v, F.lit(0.0))))


@register("emv", (period(),), ("high", "low", "volume"), lambda p: p)
def emv(k, n, h, low, v):
    mid = k.stage((h + low) / 2)
    box = divide(v / 1e8, h - low)
    return k.sma(divide(mid - k.lag(mid), box), n)


@register("cmf", (period(20),), ("high", "low", "close", "volume"), m1)
def cmf(k, n, h, low, c, v):
    return divide(k.total(money_flow(h, low, c, v), n), k.total(v + (h + low + c) * 0, n))


@register("vr", (period(26),), ("close", "volume"), lambda p: p)
def vr(k, n, c, v):
    c = k.stage(c)
    step = k.stage(c - k.lag(c))
    up = k.total(F.when(step > 0, v).otherwise(step * v * 0), n)
    down = k.total(F.when(step < 0, v).otherwise(step * v * 0), n)
    flat = k.total(F.when(step == 0, v).otherwise(step * v * 0), n)
    return 100 * divide(up + flat / 2, down + flat / 2)


@register("wvad", (period(24),), (*OHLC, "volume"), m1)
def wvad(k, n, o, h, low, c, v):
    return k.total(F.when(h - low != 0, divide(c - o, h - low) * v).otherwise((c + o + h + low) * v * 0), n)


@register("iii", (), ("high", "low", "close", "volume"))
def iii(k, h, low, c, v):
    return F.when(h - low != 0, divide(2 * c - h - low, h - low) * v).otherwise((c + h + low) * v * 0)


@register("wad", (), HLC, kind="recursive")
def wad(k, h, low, c):
    whole, (_, _, before) = complete(k, h, low, c)
    move = F.when(c > before, c - F.least(before, low)).when(c < before, c - F.greatest(before, h)).otherwise(0.0)
    return running(k, F.when(whole, move))


@register("asi", (real(3.0, 0),), OHLC, kind="recursive")
def asi(k, limit, o, h, low, c):
    whole, (o1, _, _, c1) = complete(k, o, h, low, c)
    a, b, span = F.abs(h - c1), F.abs(low - c1), F.abs(h - low)
    tail = F.abs(c1 - o1) / 4
    r = F.when((a >= b) & (a >= span), a - b / 2 + tail).when((b >= a) & (b >= span), b - a / 2 + tail).otherwise(span + tail)
    n = (c - c1) + (c - o) / 2 + (c1 - o1) / 4
    swing = F.when(r != 0, 50 * divide(n, r) * F.greatest(a, b) / limit).otherwise(0.0)
    return running(k, F.when(whole, F.when(c1.isNull(), 0.0).otherwise(swing)))


@register("brar.ar", (period(26),), ("open", "high", "low"), m1)
def brar_ar(k, n, o, h, low):
    return 100 * divide(k.total(h - o, n), k.total(o - low, n))


@register("brar.br", (period(26),), HLC, lambda p: p)
def brar_br(k, n, h, low, c):
    before = k.lag(c)

    def part(x):
        return F.when(x > 0, x).otherwise(x * 0)

    return 100 * divide(k.total(part(h - before), n), k.total(part(before - low), n))


# Statistics


@register("sum", (period(),), lookback=m1)
def sum_(k, n, x):
    return k.total(x, n)


def _index(names, sign):
    def line(k, n, x):
        x = k.stage(x)
        place = k.position()
        return k.full(x, n, F.max_by(place, F.struct(sign * x, place)).over(k.rows(n))).cast("double")

    for name in names:
        register(name, (period(),), lookback=m1)(line)


_index(("maxindex", "minmaxindex.max"), 1)
_index(("minindex", "minmaxindex.min"), -1)


@register("minmax.min", (period(),), lookback=m1)
def minmax_min(k, n, x):
    return k.lowest(x, n)


@register("minmax.max", (period(),), lookback=m1)
def minmax_max(k, n, x):
    return k.highest(x, n)


def regression(k: Compiler, x: Column, n: int) -> tuple[Column, Column, Column]:
    """Slope, intercept at the window's first row, and value at its last, of the line through the last n rows."""
    x = k.stage(x)
    mean = k.stage(k.sma(x, n))
    weights = [i - (n - 1) / 2 for i in range(n)]
    slope = k.stage(k.weighted(x, weights) / sum(w * w for w in weights))
    return slope, mean - slope * ((n - 1) / 2), mean + slope * ((n - 1) / 2)


@register("linearreg", (period(least=2),), lookback=m1)
def linearreg(k, n, x):
    return regression(k, x, n)[2]


@register("linearreg_slope", (period(least=2),), lookback=m1)
def linearreg_slope(k, n, x):
    return regression(k, x, n)[0]


@register("linearreg_intercept", (period(least=2),), lookback=m1)
def linearreg_intercept(k, n, x):
    return regression(k, x, n)[1]


@register("linearreg_angle", (period(least=2),), lookback=m1)
def linearreg_angle(k, n, x):
    return F.degrees(F.atan(regression(k, x, n)[0]))


@register("tsf", (period(least=2),), lookback=m1)
def tsf(k, n, x):
    slope, _, last = regression(k, x, n)
    return last + slope


@register("var", (period(least=2),), lookback=m1)
def var(k, n, x):
    return k.over(F.var_pop, x, n)


@register("stddev", (period(least=2), real(1.0)), lookback=lambda p, _: m1(p))
def stddev(k, n, times, x):
    return times * deviation(k, x, n)


@register("correl", (period(),), ("close", "<other>"), m1)
def correl(k, n, x, y):
    both = x.isNotNull() & y.isNotNull()
    x, y = k.stage(F.when(both, x)), k.stage(F.when(both, y))
    return k.full(x, n, F.coalesce(correlation(x, y, k.rows(n)), F.lit(0.0)))


@register("beta", (period(),), ("close", "<other>"), lambda p: p)
def beta(k, n, x, y):
    rx, ry = divide(x, k.lag(x)) - 1, divide(y, k.lag(y)) - 1
    both = k.stage(rx).isNotNull() & k.stage(ry).isNotNull()
    rx, ry = k.stage(F.when(both, k.stage(rx))), k.stage(F.when(both, k.stage(ry)))
    spread = F.var_pop(rx).over(k.rows(n))
    return k.full(rx, n, zero_if(spread == 0, divide(F.covar_pop(rx, ry).over(k.rows(n)), spread)))


@register("median", (period(),), lookback=m1)
def median(k, n, x):
    return k.over(lambda c: F.percentile(c, 0.5), x, n)


@register("quantile", (period(), real(0.5, 0, 1)), lookback=lambda p, _: m1(p))
def quantile(k, n, q, x):
    return k.over(lambda c: F.percentile(c, q), x, n)


@register("rank", (period(),), lookback=m1)
def rank(k, n, x):
    x = k.stage(x)
    a = k.values(x, n)
    return F.when(a.isNotNull(), (F.size(F.filter(a, lambda v: v < x)) + (F.size(F.filter(a, lambda v: v == x)) + 1) / 2) / n)


def _moments(k: Compiler, x: Column, n: int) -> tuple[Column, Column, Column]:
    a = k.values(x, n)
    mean = k.stage(F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n)

    def moment(power: int) -> Column:
        return k.stage(F.aggregate(a, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(float(power)))))

    return moment(2), moment(3), moment(4)


@register("skew", (period(least=3),), lookback=m1)
def skew(k, n, x):
    two, three, _ = _moments(k, x, n)
    return zero_if(two == 0, (n * math.sqrt(n - 1) / (n - 2)) * divide(three, F.pow(two, F.lit(1.5))))


@register("kurt", (period(least=4),), lookback=m1)
def kurt(k, n, x):
    two, _, four = _moments(k, x, n)
    shift = 3 * (n - 1) ** 2 / ((n - 2) * (n - 3))
    value = n * (n + 1) * (n - 1) / ((n - 2) * (n - 3)) * divide(four, two * two) - shift
    return F.when(two == 0, -3.0).otherwise(value)


@register("sem", (period(least=2),), lookback=m1)
def sem(k, n, x):
    return k.over(F.stddev_samp, x, n) / math.sqrt(n)


@register("dev", (period(),), lookback=m1)
def dev(k, n, x):
    return mean_deviation(k, x, n)


@register("mode", (period(),), lookback=m1)
def mode(k, n, x):
    x = k.stage(x)
    a = k.stage(F.when(F.count(F.lit(1)).over(k.rows(n)) == n, F.collect_list(x).over(k.rows(n))))
    counted = F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda u: u == v)).alias("n"), (-v).alias("v")))
    return -F.array_max(counted)["v"]


# Truths


def _every(k: Compiler, b: Column, n: int) -> Column:
    """Kleene AND of the last n truths: false if one is false, else missing if one is missing or before the start."""
    level = k.stage(F.when(b, 1).when(~b, 0))
    low, present = F.min(level).over(k.rows(n)), F.count(level).over(k.rows(n))
    return F.when(low == 0, F.lit(False)).when(present == n, F.lit(True))


@register("increase", (period(1), Argument(1, -1, 1)), lookback=lambda p, _: p)
def increase(k, n, direction, x):
    if direction not in (-1, 1):
        raise DirectiveValueError("increase: the direction is 1 or -1")
    x = k.stage(x)
    step = x > k.lag(x) if direction > 0 else x < k.lag(x)
    return F.when(k.position() >= n, _every(k, step, n))


@register("repeat", (period(1),), ("<truth>",), m1)
def repeat(k, n, b):
    return F.when(k.position() >= n - 1, _every(k, b, n))
