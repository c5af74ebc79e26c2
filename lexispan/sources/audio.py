"""PCM arithmetic on columns of samples, Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def resampled(samples: np.ndarray, rate: int, to: int = 16000) -> np.ndarray:
    """Linear interpolation to another rate; the sample at time t of the output is that between its two neighbours."""
    if rate == to or not len(samples):
        return np.asarray(samples, np.float64)
    n = int(len(samples) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(samples)), samples)


def quantised(samples: np.ndarray) -> bytes:
    """16-bit little-endian samples of floats, held to -1 to 1; negative ones by 32768, others by 32767."""
    x = np.clip(samples, -1, 1)
    return np.trunc(np.where(x < 0, x * 32768, x * 32767)).astype("<i2").tobytes()


def pcm16(samples: Column, rate: Column, to: int = 16000) -> Column:
    """A column of float arrays as 16-bit samples at another rate."""

    @F.pandas_udf("binary")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([quantised(resampled(np.asarray(x), int(k), to)) for x, k in zip(s, r, strict=True)])

    return run(samples, rate)


def level(pcm: Column) -> Column:
    """dBFS of a column of 16-bit samples; -100 for none."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        def one(b: bytes) -> float:
            x = np.frombuffer(b or b"", "<i2").astype(np.float64)
            mean = float((x * x).mean()) if len(x) else 0.0
            return 20 * np.log10(np.sqrt(mean) / 32768) if mean > 0 else -100.0

        return s.map(one)

    return run(pcm)
