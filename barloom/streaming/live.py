"""Live bars: finer bars fold into the forming bar of each series, with recursive indicators carried along.

The state of a key is the open period's fold up to the last fine bar, that fine bar, and two sets of machines: as of
the last closed bar, and copies advanced by the forming bar. A bar sent again under the last timestamp replaces
itself; a new period closes the forming bar; a bar older than the last one goes out as late instead of changing it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.machines import MACHINES
from ..operators.timeframes import bucket

OUT = (("ts", T.TimestampType()), ("open", T.DoubleType()), ("high", T.DoubleType()), ("low", T.DoubleType()), ("close", T.DoubleType()), ("volume", T.DoubleType()), ("closed", T.BooleanType()), ("late", T.BooleanType()))


def combine(bar: tuple | None, fine: tuple) -> tuple:
    """The fold of a period's bar and one more fine bar: open, high, low, close, volume. A missing part stays missing."""
    if bar is None:
        return fine

    def pick(f, a, b):
        return None if a is None or b is None else f(a, b)

    return (bar[0], pick(max, bar[1], fine[1]), pick(min, bar[2], fine[2]), fine[3], pick(lambda a, b: a + b, bar[4], fine[4]))


class Series:
    """One key's state."""

    def __init__(self, machines: Sequence[tuple[str, tuple, tuple[int, ...], int]]):
        self.specs = machines
        self.machines = [MACHINES[name](*args) for name, args, *_ in machines]
        self.period = self.last = self.prefix = self.fine = None

    def values(self, bar: tuple, keep: bool) -> list:
        """The indicators of a bar; unless it is kept, on copies of the machines."""
        out = []
        for i, (_, _, columns, at) in enumerate(self.specs):
            row = [bar[c] for c in columns]
            machine = self.machines[i] if keep else pickle.loads(pickle.dumps(self.machines[i]))
            made = machine.step(*row) if None not in row else None
            out.append(made[at] if isinstance(made, tuple) else made)
        return out

    def forming(self) -> tuple:
        return combine(self.prefix, self.fine)

    def push(self, period, ts, fine: tuple) -> Iterator[tuple]:
        """Rows (period, bar, closed, late, indicators) that a fine bar brings about."""
        if self.last is not None and ts < self.last:
            yield period, fine, False, True, [None] * len(self.specs)
            return
        if self.period is not None and period != self.period:
            bar = self.forming()
            yield self.period, bar, True, False, self.values(bar, keep=True)
            self.prefix = self.fine = None
        elif self.last is not None and ts != self.last:
            self.prefix = self.forming()
        self.period, self.last, self.fine = period, ts, fine
        bar = self.forming()
        yield period, bar, False, False, self.values(bar, keep=False)


def live_bars(stream: DataFrame, frame: str, *, key: Sequence[str], ts: str = "ts", tz: str | None = None, indicators: Mapping[str, tuple[str, tuple, tuple[str, ...], int]] | None = None) -> DataFrame:
    """Updates of bars and indicators, a row for each change: key, ts (the period's start), OHLCV, closed, late, indicators.

    stream has key, ts (TIMESTAMP) and open, high, low, close, volume. indicators: name -> (machine, arguments, input
    columns, output). Rows of a micro-batch are ordered by ts in the handler. Start with output mode update.
    """
    names = ["open", "high", "low", "close", "volume"]
    specs = [(name, args, tuple(names.index(c) for c in columns), out) for name, args, columns, out in (indicators or {}).values()]
    schema = T.StructType([*(stream.schema[c] for c in key), *(T.StructField(n, t) for n, t in OUT), *(T.StructField(n, T.DoubleType()) for n in indicators or {})])
    rows = stream.withColumn("_period", bucket(F.col(ts), frame, tz, naive=False)).select(*key, F.col(ts).alias("_ts"), "_period", *(F.col(c).cast("double").alias(c) for c in names))

    def update(owner, batches, state):
        series = pickle.loads(state.get[0]) if state.exists else Series(specs)
        bars = pd.concat(list(batches)).sort_values("_ts", kind="stable")
        out = []
        for at, period, *fine in bars[["_ts", "_period", *names]].itertuples(index=False):
            fine = tuple(None if v != v or v in (float("inf"), float("-inf")) else float(v) for v in fine)
            out += [(*owner, p, *bar, closed, late, *made) for p, bar, closed, late, made in series.push(period, at, fine)]
        state.update((pickle.dumps(series),))
        yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return rows.groupBy(*key).applyInPandasWithState(update, schema, "state binary", "update", "NoTimeout")


def forming_bars(stream: DataFrame, frame: str, *, key: Sequence[str], ts: str = "ts", tz: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """The bars of a stream of fine bars that are never sent again: one native aggregation for update or append mode."""
    start = bucket(F.col(ts), frame, tz, naive=False)
    rows = stream.withWatermark(ts, watermark).withColumn("_start", start)
    return rows.groupBy(*key, F.col("_start").alias("period")).agg(
        F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume")
    )
