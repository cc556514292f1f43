"""Bars for tests: a seeded random walk."""

import numpy as np
import pandas as pd


def walk(n: int = 160, seed: int = 20260606, key: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    open_ = close + rng.normal(0, 0.2, n)
    high = np.maximum(open_, close) + np.abs(rng.normal(0, 0.5, n))
    low = np.minimum(open_, close) - np.abs(rng.normal(0, 0.5, n))
    return pd.DataFrame({"k": key, "ts": np.arange(n), "open": open_, "high": high, "low": low, "close": close, "volume": np.abs(rng.normal(1e6, 2e5, n)), "periods": np.arange(n) % 7 + 2.0, "other": close + rng.normal(0, 1, n)})
