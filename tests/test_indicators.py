"""Commands against plain Python over one series, one after another."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.plans.compiler import evaluate, lookback
from barloom.plans.registry import COMMANDS, REQUIRED

from .bars import walk

BARS = walk()
O, H, L, C, V = (BARS[c].tolist() for c in ("open", "high", "low", "close", "volume"))
N = len(C)
COLUMNS = tuple(BARS.columns)


def ema(xs, n, seed=None):
    out, e = [None] * len(xs), None
    have = [i for i, x in enumerate(xs) if x is not None]
    for j, i in enumerate(have):
        if j == n - 1:
            e = sum(xs[k] for k in have[:n]) / n
        elif j >= n:
            e = e + (xs[i] - e) * 2 / (n + 1)
        out[i] = e
    return out


def wilder(xs, n):
    out, e = [None] * len(xs), None
    have = [i for i, x in enumerate(xs) if x is not None]
    for j, i in enumerate(have):
        if j == n - 1:
            e = sum(xs[k] for k in have[:n]) / n
        elif j >= n:
            e = (e * (n - 1) + xs[i]) / n
        out[i] = e
    return out


def each(f, *xs):
    return [None if None in row else f(*row) for row in zip(*xs, strict=True)]


def roll(xs, n, f):
    return [None if i < n - 1 or None in xs[i - n + 1 : i + 1] else f(xs[i - n + 1 : i + 1]) for i in range(len(xs))]


def mean(x):
    return sum(x) / len(x)


TR = [None] + [max(H[i] - L[i], abs(H[i] - C[i - 1]), abs(L[i] - C[i - 1])) for i in range(1, N)]


def macd():
    fast, slow = ema([None] * 14 + C[14:], 12), ema(C, 26)
    line = each(lambda a, b: a - b, fast, slow)
    signal = ema(line, 9)
    return line, signal, each(lambda a, b: a - b, line, signal)


def rsi(xs, n):
    up = [None] + [max(b - a, 0) for a, b in zip(xs, xs[1:], strict=False)]
    down = [None] + [max(a - b, 0) for a, b in zip(xs, xs[1:], strict=False)]
    return each(lambda u, d: 100 * u / (u + d) if u + d else 0.0, wilder(up, n), wilder(down, n))


def kdj():
    k = d = 50.0
    out = []
    for i in range(N):
        top, bottom = max(H[max(0, i - 8) : i + 1]), min(L[max(0, i - 8) : i + 1])
        k = k * 2 / 3 + 100 * (C[i] - bottom) / (top - bottom) / 3
        d = d * 2 / 3 + k / 3
        out.append((k, d, 3 * k - 2 * d))
    return [list(x) for x in zip(*out, strict=True)]


def adx(n):
    up = [None] + [max(H[i] - H[i - 1], 0) if H[i] - H[i - 1] > L[i - 1] - L[i] else 0.0 for i in range(1, N)]
    down = [None] + [max(L[i - 1] - L[i], 0) if L[i - 1] - L[i] > H[i] - H[i - 1] else 0.0 for i in range(1, N)]

    def sums(xs):
        out, s = [None] * N, sum(xs[1:n])
        for i in range(n, N):
            s = s - s / n + xs[i]
            out[i] = s
        return out

    plus = each(lambda a, t: 100 * a / t, sums(up), sums(TR))
    minus = each(lambda a, t: 100 * a / t, sums(down), sums(TR))
    dx = each(lambda a, b: 100 * abs(a - b) / (a + b), plus, minus)
    return plus, minus, dx, wilder(dx, n)


def wma(xs, n):
    return roll(xs, n, lambda w: sum(x * (i + 1) for i, x in enumerate(w)) / (n * (n + 1) / 2))


def kama(n):
    out, v = [None] * N, C[n - 1]
    for i in range(n, N):
        path = sum(abs(C[j] - C[j - 1]) for j in range(i - n + 1, i + 1))
        ratio = abs(C[i] - C[i - n]) / path
        v += (C[i] - v) * (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        out[i] = v
    return out


def running(xs):
    return list(np.cumsum(xs))


def percent_rank(w):
    return (sum(x < w[-1] for x in w) + (sum(x == w[-1] for x in w) + 1) / 2) / len(w)


WANTED = {
    "ma:7": roll(C, 7, mean), "ema:10": ema(C, 10), "smma:10": wilder(C, 10), "wma:6": wma(C, 6), "kama:10": kama(10),
    "dema:5": each(lambda a, b: 2 * a - b, ema(C, 5), ema(ema(C, 5), 5)), "tema:5": each(lambda a, b, c: 3 * a - 3 * b + c, ema(C, 5), ema(ema(C, 5), 5), ema(ema(ema(C, 5), 5), 5)),
    "trima:6": roll(roll(C, 3, mean), 4, mean), "hma:9": wma(each(lambda a, b: 2 * a - b, wma(C, 4), wma(C, 9)), 3), "vwma:5": [None if i < 4 else sum(C[j] * V[j] for j in range(i - 4, i + 1)) / sum(V[i - 4 : i + 1]) for i in range(N)],
    "boll.upper": roll(C, 20, lambda w: mean(w) + 2 * np.std(w)), "stddev:10": roll(C, 10, np.std), "median:9": roll(C, 9, np.median), "quantile:9,0.3": roll(C, 9, lambda w: np.quantile(w, 0.3)),
    "macd": macd()[0], "macd.signal": macd()[1], "macd.histogram": macd()[2], "rsi:14": rsi(C, 14), "atr:14": wilder(TR, 14), "natr:14": each(lambda a, c: 100 * a / c, wilder(TR, 14), C),
    "kdj.k": kdj()[0], "kdj.d": kdj()[1], "kdj.j": kdj()[2], "plus_di:14": adx(14)[0], "minus_di:14": adx(14)[1], "dx:14": adx(14)[2], "adx:14": adx(14)[3],
    "adxr:14": each(lambda a, b: (a + b) / 2, adx(14)[3], [None] * 13 + adx(14)[3][:-13]),
    "obv": running([V[0]] + [V[i] * ((C[i] > C[i - 1]) - (C[i] < C[i - 1])) for i in range(1, N)]), "ad": running([((C[i] - L[i]) - (H[i] - C[i])) / (H[i] - L[i]) * V[i] for i in range(N)]),
    "linearreg:10": roll(C, 10, lambda w: np.polyval(np.polyfit(range(10), w, 1), 9)), "linearreg_slope:10": roll(C, 10, lambda w: np.polyfit(range(10), w, 1)[0]), "tsf:10": roll(C, 10, lambda w: np.polyval(np.polyfit(range(10), w, 1), 10)),
    "skew:10": roll(C, 10, lambda w: pd.Series(w).skew()), "kurt:10": roll(C, 10, lambda w: pd.Series(w).kurt()), "rank:8": roll(C, 8, percent_rank), "dev:8": roll(C, 8, lambda w: mean([abs(x - mean(w)) for x in w])),
    "willr:14": [None if i < 13 else -100 * (max(H[i - 13 : i + 1]) - C[i]) / (max(H[i - 13 : i + 1]) - min(L[i - 13 : i + 1])) for i in range(N)],
    "cci:14": roll(each(lambda a, b, c: (a + b + c) / 3, H, L, C), 14, lambda w: (w[-1] - mean(w)) / (0.015 * mean([abs(x - mean(w)) for x in w]))),
    "maxindex:9": [None if i < 8 else float(max(range(i - 8, i + 1), key=lambda j: (C[j], j))) for i in range(N)], "aroon.up:10": [None if i < 10 else 100 * (10 - (i - max(range(i - 10, i + 1), key=lambda j: (H[j], j)))) / 10 for i in range(N)],
    "correl:12@close,other": [None if i < 11 else np.corrcoef(C[i - 11 : i + 1], BARS.other[i - 11 : i + 1])[0, 1] for i in range(N)], "roc:5": [None] * 5 + [100 * (C[i] / C[i - 5] - 1) for i in range(5, N)],
    "mavp:2,8@close,periods": [None if i < 7 else mean(C[i - int(BARS.periods[i]) + 1 : i + 1]) for i in range(N)], "trix:5": each(lambda a, b: 100 * (a / b - 1), ema(ema(ema(C, 5), 5), 5), [None] + ema(ema(ema(C, 5), 5), 5)[:-1]),
    "pvi": None, "mass_index:10": roll(each(lambda a, b: a / b, ema(each(lambda h, l: h - l, H, L), 9), ema(ema(each(lambda h, l: h - l, H, L), 9), 9)), 10, sum),
    "tsi": each(lambda a, b: 100 * a / b, ema(ema([None] + [C[i] - C[i - 1] for i in range(1, N)], 25), 13), ema(ema([None] + [abs(C[i] - C[i - 1]) for i in range(1, N)], 25), 13)),
    "efi": ema([None] + [(C[i] - C[i - 1]) * V[i] for i in range(1, N)], 13), "stoch.k": roll([None if i < 4 else 100 * (C[i] - min(L[i - 4 : i + 1])) / (max(H[i - 4 : i + 1]) - min(L[i - 4 : i + 1])) for i in range(N)], 3, mean),
    "keltner.upper": each(lambda e, a: e + 2 * a, ema(C, 20), wilder(TR, 10)), "ma:5@(rsi:14)": roll(rsi(C, 14), 5, mean), "ema:5@(ma:4)": ema(roll(C, 4, mean), 5),
}
WANTED = {k: v for k, v in WANTED.items() if v is not None}


@pytest.fixture(scope="module")
def got(spark):
    names = {f"d{i}": t for i, t in enumerate(WANTED)}
    df = spark.createDataFrame(pd.concat([BARS, walk(60, 5, 2)]))
    rows = evaluate(df, names, ["k"], ["ts"]).filter("k = 1").orderBy("ts").toPandas()
    return {t: rows[n] for n, t in names.items()}


@pytest.mark.parametrize("text", list(WANTED))
def test_values(got, text):
    have, want = got[text].astype(float).to_numpy(), np.array([np.nan if x is None else x for x in WANTED[text]], float)
    assert np.array_equal(np.isnan(have), np.isnan(want)), (have[:45], want[:45])
    np.testing.assert_allclose(have, want, rtol=1e-9, atol=1e-9, equal_nan=True)
    first = int(np.argmax(~np.isnan(want)))
    if not text.startswith("kdj"):
        assert first == lookback(text, COLUMNS)


def test_every_line_has_its_lookback(spark):
    """Each command runs; its first value is where its lookback says, or later where a pattern needs more."""
    df = spark.createDataFrame(BARS)
    texts = {}
    for spec in COMMANDS.values():
        args = ",".join("5" if a.default is REQUIRED else "" for a in spec.args)
        args = {"mavp": "2,7", "pivothigh": "3,2", "pivotlow": "3,2"}.get(spec.name, args)
        names = {"<other>": "other", "<periods>": "periods", "<truth>": "(close > open)"}
        operands = "@" + ",".join(names.get(s, s) for s in spec.series) if any(s[0] == "<" for s in spec.series) else ""
        texts[spec.title] = spec.title + (f":{args}" if args.strip(",") else "") + operands
    titles = list(texts)
    for at in range(0, len(titles), 64):
        part = {f"d{i}": texts[t] for i, t in enumerate(titles[at : at + 64])}
        rows = evaluate(df, part, ["k"], ["ts"]).orderBy("ts").toPandas()
        for name, text in part.items():
            there = rows[name].notna().to_numpy()
            title = text.partition(":")[0].partition("@")[0]
            assert there.any(), text
            if not title.startswith(("kdj", "pivot")) or title.startswith("pivot_"):
                assert int(np.argmax(there)) == lookback(text, COLUMNS), text


def test_missing_rows(spark):
    """A window over a missing value is missing; a recursive command leaves the row out and goes on."""
    bars = BARS.head(30).copy()
    bars.loc[10, "close"] = np.nan
    bars.loc[20, "close"] = np.inf
    rows = evaluate(spark.createDataFrame(bars), {"w": "ma:3", "e": "ema:3", "t": "close > 0"}, ["k"], ["ts"]).orderBy("ts").toPandas()
    assert rows["w"].isna().to_numpy().nonzero()[0].tolist() == [0, 1, 10, 11, 12, 20, 21, 22]
    want = ema([None if i in (10, 20) else c for i, c in enumerate(C[:30])], 3)
    assert [None if math.isnan(x) else pytest.approx(x) for x in rows["e"]] == want
    assert rows["t"][10] is None or pd.isna(rows["t"][10])


def test_operators(spark):
    bars = BARS.head(20)
    rows = evaluate(spark.createDataFrame(bars), {"up": "close // open", "z": "close / 0 > 1", "k": "close > 0 | close / 0 > 1", "n": "~(close > 0)", "m": "-close + 1"}, ["k"], ["ts"]).orderBy("ts").toPandas()
    assert [bool(x) for x in rows["up"][1:]] == [C[i - 1] <= O[i - 1] and C[i] > O[i] for i in range(1, 20)]
    assert rows["z"].isna().all() and rows["k"].all() and not rows["n"].any()
    np.testing.assert_allclose(rows["m"], 1 - np.array(C[:20]))
