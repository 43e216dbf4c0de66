"""Data and helpers that the tests share."""
import numpy as np
import pandas as pd


def price_frame(n_assets=3, n_bars=120, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2020-01-01", periods=n_bars)
    parts = []
    for a in range(n_assets):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n_bars)))
        high, low = close * (1 + rng.uniform(0, 0.02, n_bars)), close * (1 - rng.uniform(0, 0.02, n_bars))
        open_ = low + (high - low) * rng.uniform(0, 1, n_bars)
        f = pd.DataFrame(
            {"asset": f"A{a:02d}", "ts": days, "open": open_, "high": high, "low": low, "close": close,
             "volume": rng.integers(100, 1000, n_bars).astype(float)}
        )
        if missing:
            f = f[rng.uniform(0, 1, n_bars) >= missing]
        parts.append(f)
    return pd.concat(parts, ignore_index=True)


def collect(df, *order):
    """Rows as pandas, sorted, NULL doubles as NaN."""
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
