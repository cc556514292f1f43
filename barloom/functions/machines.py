"""Recursive commands as step machines: each takes the values of one complete row and keeps a small state.

A machine's output is None while it warms up. Batch plans run the machines over sorted partitions in a single
streaming pass; streaming plans keep them as state. Both call the same step.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import divide
from ..plans.registry import m1, period, real, register

MACHINES: dict[str, type] = {}
TINY = 1e-14


def machine(cls):
    MACHINES[cls.__name__.lower()] = cls
    return cls


# The ordered pass


def run(df: DataFrame, key: Sequence[str], order: Sequence[str], wanted: list[tuple[str, str, tuple, list[str]]]) -> DataFrame:
    """df with an array column for each wanted (column, machine, arguments, inputs).

    The rows are partitioned and sorted by a window, as native stages are, so an exchange that is there already is
    used again. A task streams its sorted rows batch by batch and holds the machines of one key only.
    """
    from pyspark.sql import Window

    names = df.columns
    sorted_ = df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    inputs = {c: names.index(c) for _, _, _, columns in wanted for c in columns}
    keys = [names.index(c) for c in key]
    specs = [(name, args, tuple(columns)) for _, name, args, columns in wanted]
    added = [column for column, *_ in wanted]

    def step(batches):
        now, machines = None, []
        for batch in batches:
            rows = batch.num_rows
            out: list[list] = [[None] * rows for _ in specs]
            values = {c: batch.column(i).to_pylist() for c, i in inputs.items()}
            owners = list(zip(*(batch.column(i).to_pylist() for i in keys), strict=True)) if keys else [()] * rows
            start = 0
            while start < rows:
                owner = owners[start]
                end = start + 1
                while end < rows and owners[end] == owner:
                    end += 1
                if owner != now:
                    now, machines = owner, [MACHINES[name](*args) for name, args, _ in specs]
                for target, (_, _, columns), m in zip(out, specs, machines, strict=True):
                    call = m.step
                    for i, row in enumerate(zip(*(values[c][start:end] for c in columns), strict=True), start):
                        if None not in row:
                            made = call(*row)
                            if made is not None:
                                target[i] = made if isinstance(made, tuple) else (made,)
                start = end
            arrays = [pa.array(t, pa.list_(pa.float64())) for t in out]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], names=[*names, *added])

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in added)])
    return sorted_.mapInArrow(step, schema)


# Averages


@machine
class Ema:
    """Starts at the mean of the first n values."""

    def __init__(self, n: int, k: float | None = None):
        self.n, self.k = n, 2 / (n + 1) if k is None else k
        self.count, self.value = 0, 0.0

    def step(self, x: float):
        if self.count < self.n:
            self.count += 1
            self.value += x
            if self.count < self.n:
                return None
            self.value /= self.n
        else:
            self.value += (x - self.value) * self.k
        return self.value


@machine
class Smma:
    def __init__(self, n: int):
        self.n, self.count, self.value = n, 0, 0.0

    def step(self, x: float):
        if self.count < self.n:
            self.count += 1
            self.value += x
            if self.count < self.n:
                return None
            self.value /= self.n
        else:
            self.value = (self.value * (self.n - 1) + x) / self.n
        return self.value


class Cascade:
    """Averages of averages: the values of all levels, once the last has one."""

    def __init__(self, n: int, levels: int):
        self.levels = [Ema(n) for _ in range(levels)]

    def step(self, x: float):
        out = []
        for level in self.levels:
            x = level.step(x)
            if x is None:
                return None
            out.append(x)
        return out


@machine
class Dema(Cascade):
    def __init__(self, n: int):
        super().__init__(n, 2)

    def step(self, x: float):
        e = super().step(x)
        return e and 2 * e[0] - e[1]


@machine
class Tema(Cascade):
    def __init__(self, n: int):
        super().__init__(n, 3)

    def step(self, x: float):
        e = super().step(x)
        return e and 3 * e[0] - 3 * e[1] + e[2]


@machine
class T3(Cascade):
    def __init__(self, n: int, v: float = 0.7):
        super().__init__(n, 6)
        self.c = (-(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v)

    def step(self, x: float):
        e = super().step(x)
        return e and self.c[0] * e[5] + self.c[1] * e[4] + self.c[2] * e[3] + self.c[3] * e[2]


@machine
class Trix(Cascade):
    def __init__(self, n: int):
        super().__init__(n, 3)
        self.before = None

    def step(self, x: float):
        e = super().step(x)
        if e is None:
            return None
        before, self.before = self.before, e[2]
        return None if before is None else 100 * (e[2] / before - 1) if before else 0.0


@machine
class Kama:
    def __init__(self, n: int):
        self.n, self.ring, self.value = n, deque(maxlen=n + 1), None

    def step(self, x: float):
        self.ring.append(x)
        if len(self.ring) <= self.n:
            self.value = x
            return None
        ring = list(self.ring)
        path = sum(abs(b - a) for a, b in zip(ring, ring[1:], strict=False))
        move = ring[-1] - ring[0]
        ratio = 1.0 if path <= move or abs(path) < TINY else abs(move / path)
        speed = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        self.value += (x - self.value) * speed
        return self.value


@machine
class Macd:
    """Line, signal, histogram. The faster average starts so that both have their first value on the same row."""

    def __init__(self, fast: int, slow: int, signal: int = 9, fixed: int = 0):
        if slow < fast:
            fast, slow = slow, fast
        self.wait = slow - fast
        self.fast, self.slow, self.signal = Ema(fast, 0.15 if fixed else None), Ema(slow, 0.075 if fixed else None), Ema(signal)

    def step(self, x: float):
        slow = self.slow.step(x)
        if self.wait:
            self.wait -= 1
            fast = None
        else:
            fast = self.fast.step(x)
        if slow is None or fast is None:
            return None
        line = fast - slow
        signal = self.signal.step(line)
        return (line, signal, None if signal is None else line - signal)


# Gains and losses


class Wilder:
    """The mean of the first n values, then Wilder's average."""

    def __init__(self, n: int):
        self.inner = Smma(n)
        self.step = self.inner.step


@machine
class Rsi:
    def __init__(self, n: int):
        self.up, self.down, self.before = Smma(n), Smma(n), None

    def both(self, x: float):
        before, self.before = self.before, x
        if before is None:
            return None
        up, down = self.up.step(max(x - before, 0.0)), self.down.step(max(before - x, 0.0))
        return None if up is None else (up, down)

    def step(self, x: float):
        b = self.both(x)
        return b and (100 * b[0] / (b[0] + b[1]) if b[0] + b[1] else 0.0)


@machine
class Cmo(Rsi):
    def step(self, x: float):
        b = self.both(x)
        return b and (100 * (b[0] - b[1]) / (b[0] + b[1]) if b[0] + b[1] else 0.0)


@machine
class Crsi:
    def __init__(self, rsi: int, streak: int, rank: int):
        self.price, self.run, self.rates = Rsi(rsi), Rsi(streak), deque(maxlen=rank)
        self.before, self.streak, self.rank = None, 0.0, rank

    def step(self, x: float):
        before, self.before = self.before, x
        a = self.price.step(x)
        if before is None:
            self.run.step(0.0)
            return None
        self.streak = (max(self.streak, 0) + 1) if x > before else (min(self.streak, 0) - 1) if x < before else 0.0
        b = self.run.step(self.streak)
        rate = (x / before - 1) * 100 if before else math.nan
        c = 100 * sum(r < rate for r in self.rates) / self.rank if len(self.rates) == self.rank else None
        self.rates.append(rate)
        return None if a is None or b is None or c is None else (a + b + c) / 3


@machine
class Tsi:
    def __init__(self, long: int, short: int):
        self.a, self.b, self.c, self.d, self.before = Ema(long), Ema(short), Ema(long), Ema(short), None

    def step(self, x: float):
        before, self.before = self.before, x
        if before is None:
            return None
        a, c = self.a.step(x - before), self.c.step(abs(x - before))
        if a is None:
            return None
        b, d = self.b.step(a), self.d.step(c)
        return None if b is None or not d else 100 * b / d


@machine
class Smi:
    """Stochastic momentum from the distance to the middle and the range; also its signal."""

    def __init__(self, d: int, signal: int):
        self.a, self.b, self.c, self.d, self.signal = Ema(d), Ema(d), Ema(d), Ema(d), Ema(signal)

    def step(self, away: float, span: float):
        a, c = self.a.step(away), self.c.step(span)
        if a is None:
            return None
        b, d = self.b.step(a), self.d.step(c)
        if b is None or not d:
            return None
        value = 200 * b / d
        return (value, self.signal.step(value))


@machine
class Kdj:
    def __init__(self, n: int, k: int, d: int, start: float):
        self.high, self.low = deque(maxlen=n), deque(maxlen=n)
        self.kp, self.dp, self.k, self.d = k, d, start, start

    def step(self, high: float, low: float, close: float):
        self.high.append(high)
        self.low.append(low)
        top, bottom = max(self.high), min(self.low)
        rsv = 100 * (close - bottom) / (top - bottom) if top != bottom else 0.0
        self.k = (1 - 1 / self.kp) * self.k + rsv / self.kp
        self.d = (1 - 1 / self.dp) * self.d + self.k / self.dp
        return (self.k, self.d, 3 * self.k - 2 * self.d)


# Direction


def true_range(high: float, low: float, before: float) -> float:
    return max(high - low, abs(before - high), abs(before - low))


@machine
class Dm:
    """Wilder sums of directional movement and true range: plus, minus, range, from the row they are whole."""

    def __init__(self, n: int, rows: int):
        self.n, self.wait, self.before = n, rows, None
        self.plus = self.minus = self.range = 0.0

    def step(self, high: float, low: float, close: float = math.nan):
        before, self.before = self.before, (high, low, close)
        if before is None:
            return None
        up, down = high - before[0], before[1] - low
        plus, minus = (up if up > 0 and up > down else 0.0), (down if down > 0 and down > up else 0.0)
        span = true_range(high, low, before[2])
        if self.n == 1:
            return (plus, minus, span)
        self.wait -= 1
        if self.wait > 0 or self.seeding():
            self.plus, self.minus, self.range = self.plus + plus, self.minus + minus, self.range + span
            return (self.plus, self.minus, self.range) if self.wait == 0 else None
        self.plus += plus - self.plus / self.n
        self.minus += minus - self.minus / self.n
        self.range += span - self.range / self.n
        return (self.plus, self.minus, self.range)

    def seeding(self) -> bool:
        return False


@machine
class DmSum(Dm):
    """Movement alone: the sum of the first n - 1 moves is the first value."""

    def __init__(self, n: int):
        super().__init__(n, n - 1)

    def seeding(self) -> bool:
        return self.wait == 0


def di(part: float, span: float) -> float:
    return 0.0 if abs(span) < TINY else 100 * part / span


@machine
class Di(Dm):
    """+DI, -DI."""

    def __init__(self, n: int):
        super().__init__(n, n)

    def step(self, high, low, close):
        s = super().step(high, low, close)
        return s and (di(s[0], s[2]), di(s[1], s[2]))


@machine
class Dx(Di):
    def __init__(self, n: int):
        super().__init__(n)
        self.last = 0.0

    def step(self, high, low, close):
        s = super().step(high, low, close)
        if s is None:
            return None
        if abs(s[0] + s[1]) >= TINY:
            self.last = 100 * abs(s[0] - s[1]) / (s[0] + s[1])
        return self.last


@machine
class Adx(Di):
    """ADX and ADXR."""

    def __init__(self, n: int):
        super().__init__(n)
        self.count, self.value, self.ring = 0, 0.0, deque(maxlen=n)

    def step(self, high, low, close):
        s = super().step(high, low, close)
        if s is None:
            return None
        whole = s[0] + s[1]
        dx = 100 * abs(s[0] - s[1]) / whole if abs(whole) >= TINY else None
        if self.count < self.n:
            self.count += 1
            self.value += dx or 0.0
            if self.count < self.n:
                return None
            self.value /= self.n
        elif dx is not None:
            self.value = (self.value * (self.n - 1) + dx) / self.n
        self.ring.append(self.value)
        return (self.value, (self.value + self.ring[0]) / 2 if len(self.ring) == self.n else None)


@machine
class Atr:
    def __init__(self, n: int):
        self.mean, self.before = Smma(n), None

    def step(self, high, low, close):
        before, self.before = self.before, close
        return None if before is None else self.mean.step(true_range(high, low, before))


@machine
class Keltner:
    """Middle, distance of the bands, width."""

    def __init__(self, ema: int, atr: int, mult: float):
        self.ema, self.atr, self.mult = Ema(ema), Atr(atr), mult

    def step(self, high, low, close):
        e, a = self.ema.step(close), self.atr.step(high, low, close)
        if e is None or a is None:
            return None
        return (e + self.mult * a, e - self.mult * a, 2 * self.mult * a / e if e else None)


@machine
class Supertrend:
    """Line, direction."""

    def __init__(self, n: int, mult: float):
        self.atr, self.mult, self.trend, self.up, self.low, self.before = Atr(n), mult, None, 0.0, 0.0, 0.0

    def step(self, high, low, close):
        a, before, self.before = self.atr.step(high, low, close), self.before, close
        if a is None:
            return None
        mid = (high + low) / 2
        up, bottom = mid + self.mult * a, mid - self.mult * a
        if self.trend is None:
            self.trend, self.up, self.low = -1.0, up, bottom
        else:
            self.up = up if up < self.up or before > self.up else self.up
            self.low = bottom if bottom > self.low or before < self.low else self.low
            if self.trend < 0:
                self.trend = 1.0 if close > self.up else -1.0
            else:
                self.trend = -1.0 if close < self.low else 1.0
        return (self.low if self.trend > 0 else self.up, self.trend)


@machine
class SarExt:
    """Stop and reverse, negative while short. A start of 0 takes the side of the first movement."""

    def __init__(self, start, offset, l_init, l_step, l_max, s_init, s_step, s_max):
        self.start, self.offset = start, offset
        self.init, self.by, self.most = (min(l_init, l_max), min(s_init, s_max)), (min(l_step, l_max), min(s_step, s_max)), (l_max, s_max)
        self.rows = 0

    def step(self, high, low):
        self.rows += 1
        if self.rows == 1:
            self.h, self.l = high, low
            return None
        h, bottom = self.h, self.l
        if self.rows == 2:
            down = bottom - low
            self.short = self.start < 0 or (self.start == 0 and down > 0 and down > high - h)
            self.sar = abs(self.start) if self.start else (h if self.short else bottom)
            self.ep = low if self.short else high
            self.af = self.init[self.short]
            h, bottom = high, low  # the first bar is clamped to itself
        self.h, self.l = high, low
        if not self.short:
            if low <= self.sar:
                self.short = True
                out = max(self.ep, h, high) * (1 + self.offset)
                self.af, self.ep = self.init[1], low
                self.sar = max(out + self.af * (low - out), h, high)
                return -out
            out = self.sar
            if high > self.ep:
                self.ep, self.af = high, min(self.af + self.by[0], self.most[0])
            self.sar = min(out + self.af * (self.ep - out), bottom, low)
            return out
        if high >= self.sar:
            self.short = False
            out = min(self.ep, bottom, low) * (1 - self.offset)
            self.af, self.ep = self.init[0], high
            self.sar = min(out + self.af * (high - out), bottom, low)
            return out
        out = self.sar
        if low < self.ep:
            self.ep, self.af = low, min(self.af + self.by[1], self.most[1])
        self.sar = max(out + self.af * (self.ep - out), h, high)
        return -out


# Volume


@machine
class Adosc:
    def __init__(self, fast: int, slow: int):
        self.a, self.b, self.wait, self.sum = 2 / (fast + 1), 2 / (slow + 1), max(fast, slow) - 1, 0.0
        self.x = self.y = None

    def step(self, high, low, close, volume):
        if high - low > 0:
            self.sum += ((close - low) - (high - close)) / (high - low) * volume
        if self.x is None:
            self.x = self.y = self.sum
        else:
            self.x += (self.sum - self.x) * self.a
            self.y += (self.sum - self.y) * self.b
        self.wait -= 1
        return None if self.wait >= 0 else self.x - self.y


@machine
class VolumeIndex:
    """From 1000, moved by the rate of change on rows whose volume moves to one side."""

    def __init__(self, side: int):
        self.side, self.value, self.before = side, 1000.0, None

    def step(self, close, volume):
        before, self.before = self.before, (close, volume)
        if before and self.side * (volume - before[1]) > 0 and before[0]:
            self.value *= 1 + (close - before[0]) / before[0]
        return self.value


@machine
class Efi:
    def __init__(self, n: int):
        self.mean, self.before = Ema(n), None

    def step(self, close, volume):
        before, self.before = self.before, close
        return None if before is None else self.mean.step((close - before) * volume)


@machine
class MassRatio:
    def __init__(self):
        self.a, self.b = Ema(9), Ema(9)

    def step(self, high, low):
        a = self.a.step(high - low)
        b = None if a is None else self.b.step(a)
        return None if not b else a / b


# Cycles


class Hilbert:
    """The shared front of the cycle commands: smoothed price, in-phase and quadrature parts, and the period."""

    def __init__(self, warm: int):
        self.warm, self.rows = warm, 0
        self.price: deque = deque([0.0] * 4, maxlen=4)
        self.s: deque = deque([0.0] * 7, maxlen=7)
        self.d: deque = deque([0.0] * 7, maxlen=7)
        self.i1: deque = deque([0.0] * 7, maxlen=7)
        self.q1: deque = deque([0.0] * 7, maxlen=7)
        self.i2 = self.q2 = self.re = self.im = self.period = self.smooth_period = 0.0

    @staticmethod
    def transform(ring: deque, gain: float) -> float:
        return (0.0962 * ring[-1] + 0.5769 * ring[-3] - 0.5769 * ring[-5] - 0.0962 * ring[-7]) * gain

    def feed(self, x: float) -> float | None:
        """The smoothed price, once the parts are up to date with it."""
        self.price.append(x)
        self.rows += 1
        if self.rows < 4:
            return None
        smooth = (4 * self.price[-1] + 3 * self.price[-2] + 2 * self.price[-3] + self.price[-4]) / 10
        if self.rows <= self.warm:
            return None
        gain = 0.075 * self.period + 0.54
        self.s.append(smooth)
        self.d.append(self.transform(self.s, gain))
        self.q1.append(self.transform(self.d, gain))
        self.i1.append(self.d[-4])
        self.ji, self.jq = self.transform(self.i1, gain), self.transform(self.q1, gain)
        return smooth

    def turn(self) -> None:
        """Update the period from the parts."""
        q2, i2 = 0.2 * (self.q1[-1] + self.ji) + 0.8 * self.q2, 0.2 * (self.i1[-1] - self.jq) + 0.8 * self.i2
        self.re = 0.2 * (i2 * self.i2 + q2 * self.q2) + 0.8 * self.re
        self.im = 0.2 * (i2 * self.q2 - q2 * self.i2) + 0.8 * self.im
        self.i2, self.q2 = i2, q2
        last = self.period
        now = 360 / math.degrees(math.atan(self.im / self.re)) if self.im and self.re else last
        now = min(now, 1.5 * last)
        now = max(now, 0.67 * last)
        now = min(max(now, 6.0), 50.0)
        self.period = 0.2 * now + 0.8 * last
        self.smooth_period = 0.33 * self.period + 0.67 * self.smooth_period


@machine
class Mama(Hilbert):
    """MAMA, FAMA."""

    def __init__(self, fast: float, slow: float):
        super().__init__(12)
        self.fast, self.slow, self.phase, self.mama, self.fama = fast, slow, 0.0, 0.0, 0.0

    def step(self, x):
        if self.feed(x) is None:
            return None
        phase = math.degrees(math.atan(self.q1[-1] / self.i1[-1])) if self.i1[-1] else 0.0
        delta, self.phase = max(self.phase - phase, 1.0), phase
        alpha = max(self.fast / delta, self.slow) if delta > 1 else self.fast
        self.mama = alpha * x + (1 - alpha) * self.mama
        self.fama = alpha / 2 * self.mama + (1 - alpha / 2) * self.fama
        self.turn()
        return (self.mama, self.fama) if self.rows > 32 else None


@machine
class Cycle(Hilbert):
    """Period, in-phase, quadrature."""

    def __init__(self):
        super().__init__(12)

    def step(self, x):
        if self.feed(x) is None:
            return None
        self.turn()
        return (self.smooth_period, self.i1[-1], self.q1[-1]) if self.rows > 32 else None


@machine
class Phase(Hilbert):
    """Phase, sine, lead sine, trend line, trend mode."""

    def __init__(self):
        super().__init__(37)
        self.smoothed: deque = deque([0.0] * 50, maxlen=50)
        self.prices: deque = deque([0.0] * 50, maxlen=50)
        self.trends: deque = deque([0.0] * 3, maxlen=3)
        self.phase = self.sine = self.lead = 0.0
        self.days = 0

    def step(self, x):
        self.prices.append(x)
        smooth = self.feed(x)
        if smooth is None:
            return None
        self.smoothed.append(smooth)
        self.turn()
        cycle = self.smooth_period + 0.5
        n = int(cycle)
        real_, imag = 0.0, 0.0
        for i in range(n):
            angle = math.radians(i * 360 / n)
            real_ += math.sin(angle) * self.smoothed[-1 - i]
            imag += math.cos(angle) * self.smoothed[-1 - i]
        last, sine, lead = self.phase, self.sine, self.lead
        if abs(imag) > 0:
            phase = math.degrees(math.atan(real_ / imag))
        elif abs(imag) <= 0.01 and real_ < 0:
            phase = self.phase - 90
        elif abs(imag) <= 0.01 and real_ > 0:
            phase = self.phase + 90
        else:
            phase = self.phase
        phase += 90 + (360 / self.smooth_period if self.smooth_period else 0.0)
        phase += 180 if imag < 0 else 0
        phase -= 360 if phase > 315 else 0
        self.phase = phase
        self.sine, self.lead = math.sin(math.radians(phase)), math.sin(math.radians(phase + 45))
        mean = sum(self.prices[-1 - i] for i in range(n)) / n if n else 0.0
        t = self.trends
        trend = (4 * mean + 3 * t[-1] + 2 * t[-2] + t[-3]) / 10
        t.append(mean)
        mode = 1.0
        if (self.sine > self.lead and sine <= lead) or (self.sine < self.lead and sine >= lead):
            self.days, mode = 0, 0.0
        self.days += 1
        if self.days < 0.5 * self.smooth_period:
            mode = 0.0
        turned = phase - last
        if self.smooth_period and 0.67 * 360 / self.smooth_period < turned < 1.5 * 360 / self.smooth_period:
            mode = 0.0
        if trend and abs((smooth - trend) / trend) >= 0.015:
            mode = 1.0
        return (phase, self.sine, self.lead, trend, mode) if self.rows > 63 else None


# Patterns with a pending setup


class Hike:
    """An inside bar's breakout, and its confirmation within three rows."""

    def __init__(self):
        self.bars: deque = deque(maxlen=8)
        self.rows, self.at, self.sign, self.level = 0, -99, 0, (0.0, 0.0)

    def setup(self) -> tuple[int, tuple[float, float]] | None:
        raise NotImplementedError

    def step(self, o, h, low, c):
        self.bars.append((o, h, low, c))
        self.rows += 1
        if self.rows < self.least:
            return None
        found = self.setup()
        if found:
            self.sign, self.level = found
            self.at = self.rows
            return 100.0 * self.sign
        top, bottom = self.level
        if self.rows <= self.at + 3 and ((self.sign > 0 and c > top) or (self.sign < 0 and c < bottom)):
            self.at = -99
            return 200.0 * self.sign
        return 0.0


@machine
class Hikkake(Hike):
    least = 3

    def setup(self):
        (_, h2, l2, _), (_, h1, l1, _), (_, h, low, _) = list(self.bars)[-3:]
        if not (h1 < h2 and l1 > l2):
            return None
        if h < h1 and low < l1:
            return 1, (h1, l1)
        return (-1, (h1, l1)) if h > h1 and low > l1 else None


@machine
class HikkakeMod(Hike):
    least = 7

    def setup(self):
        bars = list(self.bars)
        (_, h3, l3, _), (_, h2, l2, c2), (_, h1, l1, _), (_, h, low, _) = bars[-4:]
        if not (h2 < h3 and l2 > l3 and h1 < h2 and l1 > l2):
            return None
        near = 0.2 * sum(b[1] - b[2] for b in bars[-7:-2]) / 5 if len(bars) >= 7 else 0.0
        if h < h1 and low < l1 and c2 <= l2 + near:
            return 1, (h1, l1)
        return (-1, (h1, l1)) if h > h1 and low > l1 and c2 >= h2 - near else None


# The commands

HLC = ("high", "low", "close")


def _simple(name, cls, args, series=("close",), lookback=m1, out=0, aliases="", fixed=()):
    @register(name, args, series, lookback, "recursive", aliases)
    def line(k, *values):
        n = len(values) - len(series)
        return k.machine(cls, (*values[:n], *fixed), *values[n:], out=out)


_simple("ema", "ema", (period(),))
_simple("smma", "smma", (period(),))
_simple("dema", "dema", (period(),), lookback=lambda p: 2 * m1(p))
_simple("tema", "tema", (period(),), lookback=lambda p: 3 * m1(p))
_simple("t3", "t3", (period(), real(0.7, 0, 1)), lookback=lambda p, _: 6 * m1(p))
_simple("kama", "kama", (period(),), lookback=lambda p: p)
_simple("trix", "trix", (period(),), lookback=lambda p: 3 * m1(p) + 1)
for _name, _out, _alias in (("mama", 0, "mama"), ("mama.fama", 1, "")):
    _simple(_name, "mama", (real(0.5, 0.01, 0.99), real(0.05, 0.01, 0.99)), lookback=lambda *_: 32, out=_out, aliases=_alias)
for _name, _out, _alias in (("ht_dcperiod", 0, ""), ("ht_phasor", 1, "i inphase"), ("ht_phasor.quadrature", 2, "q quad")):
    _simple(_name, "cycle", (), lookback=lambda: 32, out=_out, aliases=_alias)
for _name, _out, _alias in (("ht_dcphase", 0, ""), ("ht_sine", 1, "sine"), ("ht_sine.leadsine", 2, "lead"), ("ht_trendline", 3, ""), ("ht_trendmode", 4, "")):
    _simple(_name, "phase", (), lookback=lambda: 63, out=_out, aliases=_alias)

_simple("macd", "macd", (period(12), period(26)), lookback=lambda a, b: m1(max(a, b)), aliases="dif")
_simple("macd.signal", "macd", (period(12), period(26), period(9)), lookback=lambda a, b, s: max(a, b) + s - 2, out=1, aliases="s dea")
_simple("macd.histogram", "macd", (period(12), period(26), period(9)), lookback=lambda a, b, s: max(a, b) + s - 2, out=2, aliases="h macd")


def _fixed(name, out, args, aliases):
    @register(name, args, ("close",), lambda *s: 24 + (s[0] if s else 1), "recursive", aliases)
    def line(k, *values):
        return k.machine("macd", (12, 26, *(values[:-1] or (9,)), 1), values[-1], out=out)


_fixed("macdfix", 0, (), "dif")
_fixed("macdfix.signal", 1, (period(9),), "s dea")
_fixed("macdfix.histogram", 2, (period(9),), "h macd")

_simple("rsi", "rsi", (period(),), lookback=lambda p: p)
_simple("cmo", "cmo", (period(),), lookback=lambda p: p)
_simple("crsi", "crsi", (period(3), period(2), period(100)), lookback=lambda a, b, c: max(a, b, c + 1))
_simple("tsi", "tsi", (period(25), period(13)), lookback=lambda a, b: a + b - 1)


def _momentum(name, out, lookback):
    @register(name, (period(10), period(3), period(3)), HLC, lookback, "recursive")
    def line(k, n, d, signal, h, low, c):
        top, bottom = k.stage(k.highest(h, n)), k.stage(k.lowest(low, n))
        return k.machine("smi", (d, signal), c - (top + bottom) / 2, top - bottom, out=out)


_momentum("stoch_momentum", 0, lambda k, d, s: m1(k) + 2 * m1(d))
_momentum("stoch_momentum.signal", 1, lambda k, d, s: m1(k) + 2 * m1(d) + m1(s))


@register("kdj.k", (period(9), period(3), real(50.0)), HLC, lambda p, *_: 3 * p, "recursive")
def kdj_k(k, n, kp, start, *series):
    return k.machine("kdj", (n, kp, 3, start), *series)


_KDJ = (period(9), period(3), period(3), real(50.0))
_simple("kdj.d", "kdj", _KDJ, HLC, lambda p, *_: 3 * p, out=1)
_simple("kdj.j", "kdj", _KDJ, HLC, lambda p, *_: 3 * p, out=2)

for _name, _out in (("plus_dm", 0), ("minus_dm", 1)):
    _simple(_name, "dmsum", (period(),), ("high", "low"), lambda p: max(p - 1, 1), out=_out)
for _name, _out in (("plus_di", 0), ("minus_di", 1)):
    _simple(_name, "di", (period(),), HLC, lambda p: p, out=_out)
_simple("dx", "dx", (period(),), HLC, lambda p: p)
_simple("adx", "adx", (period(),), HLC, lambda p: 2 * p - 1)
_simple("adxr", "adx", (period(),), HLC, lambda p: 3 * p - 2, out=1)
_simple("atr", "atr", (period(),), HLC, lambda p: p)


@register("natr", (period(),), HLC, lambda p: p, "recursive")
def natr(k, n, h, low, c):
    a = k.machine("atr", (n,), h, low, c)
    return F.when((c == 0) & a.isNotNull(), 0.0).otherwise(100 * divide(a, c))


_simple("keltner", "ema", (period(20),), aliases="middle m")
_KELTNER = (period(20), period(10), real(2.0))
for _name, _out, _alias in (("keltner.upper", 0, "u"), ("keltner.lower", 1, "l"), ("kcw", 2, "")):
    _simple(_name, "keltner", _KELTNER, HLC, lambda e, a, _: max(m1(e), a), out=_out, aliases=_alias)
for _name, _out, _alias in (("supertrend", 0, "line"), ("supertrend.direction", 1, "trend d")):
    _simple(_name, "supertrend", (period(10), real(3.0)), HLC, lambda p, _: p, out=_out, aliases=_alias)


@register("sar", (real(0.02, 0), real(0.2, 0)), ("high", "low"), lambda *_: 1, "recursive")
def sar(k, by, most, h, low):
    return F.abs(k.machine("sarext", (0.0, 0.0, by, by, most, by, by, most), h, low))


_simple("sarext", "sarext", (real(0.0), real(0.0, 0), *(real(v, 0) for v in (0.02, 0.02, 0.2, 0.02, 0.02, 0.2))), ("high", "low"), lambda *_: 1)

_simple("adosc", "adosc", (period(3), period(10)), ("high", "low", "close", "volume"), lambda a, b: m1(max(a, b)))
_simple("nvi", "volumeindex", (), ("close", "volume"), lambda: 0, fixed=(-1,))
_simple("pvi", "volumeindex", (), ("close", "volume"), lambda: 0, fixed=(1,))
_simple("efi", "efi", (period(13),), ("close", "volume"), lambda p: p)


@register("mass_index", (period(25),), ("high", "low"), lambda p: 15 + p, "recursive")
def mass_index(k, n, h, low):
    return k.total(k.stage(k.machine("massratio", (), h, low)), n)


@machine
class Ewm:
    """Exponentially weighted mean, sum, covariance, correlation and the count so far of x and y. NaN is missing."""

    def __init__(self, alpha: float, adjust: bool, ignore_na: bool, bias: bool):
        self.keep, self.new = 1 - alpha, 1.0 if adjust else alpha
        self.adjust, self.ignore, self.bias = adjust, ignore_na, bias
        self.n, self.weight, self.squares = 0, 0.0, 0.0
        self.mx = self.my = self.xx = self.yy = self.xy = self.total = 0.0

    def step(self, x: float, y: float):
        there = x == x and y == y
        if self.n and (there or not self.ignore):
            self.weight *= self.keep
            self.squares *= self.keep * self.keep
            self.total *= self.keep
        if there:
            self.n += 1
            new = self.new if self.n > 1 else 1.0
            whole = self.weight + new
            dx, dy = x - self.mx, y - self.my
            self.mx, self.my = self.mx + dx * new / whole, self.my + dy * new / whole
            share = self.weight / whole
            self.xx = share * (self.xx + dx * dx * new / whole)
            self.yy = share * (self.yy + dy * dy * new / whole)
            self.xy = share * (self.xy + dx * dy * new / whole)
            self.squares += new * new
            self.weight, self.total = whole, self.total + x
            if not self.adjust:
                self.squares /= whole * whole
                self.weight = 1.0
        if not self.n:
            return None
        room = self.weight * self.weight
        spare = room - self.squares
        cov = self.xy if self.bias else self.xy * room / spare if spare > 0 else None
        corr = self.xy / math.sqrt(self.xx * self.yy) if self.xx > 0 and self.yy > 0 else None
        return (self.mx, self.total, cov, corr, float(self.n))


@machine
class EwmSum:
    """Exponentially weighted sum and the count so far of x, in rows that have y too. NaN is missing.

    The newest values are weighed by powers and added oldest first, as the sum is defined, onto what all older ones come to:
    a sum of few decimals often lies on a tie of the digits shown, where a running product would round to the other side.
    """

    NEWEST = 64

    def __init__(self, alpha: float, ignore_na: bool):
        self.keep, self.ignore = 1 - alpha, ignore_na
        self.weights = [self.keep**age for age in range(self.NEWEST, -1, -1)]
        self.n, self.older, self.values = 0, 0.0, deque()

    def step(self, x: float, y: float):
        there = x == x and y == y
        if there or self.n and not self.ignore:
            self.values.append(x if there else 0.0)
            if len(self.values) > self.NEWEST:
                self.older = self.older * self.keep + self.values.popleft()
        self.n += there
        if not self.n:
            return None
        first, *weights = self.weights[self.NEWEST - len(self.values) :]
        total = self.older * first
        for value, weight in zip(self.values, weights, strict=True):
            total += value * weight
        return (total, float(self.n))
