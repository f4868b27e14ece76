"""Operators on fixed-length vectors: profiles, templates, warping distances and smoothness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels


def resampled(values: Column, n: int = kernels.PROFILE) -> Column:
    """The vector on ``n`` evenly spaced points by linear interpolation; zeros for fewer than two values."""
    size = F.size(values)
    at = lambda k: k * (size - 1) / F.lit(float(n - 1))
    low = lambda k: F.least(F.floor(at(k)).cast("int"), size - 2)
    value = lambda k: F.get(values, low(k)) + (F.get(values, low(k) + 1) - F.get(values, low(k))) * (at(k) - low(k))
    return F.when(size >= 2, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value)).otherwise(F.array_repeat(F.lit(0.0), n))


def unit_peak(values: Column) -> Column:
    """Divided by the largest magnitude if that is above 1e-9."""
    peak = F.array_max(F.transform(values, F.abs))
    return F.when(peak > 1e-9, F.transform(values, lambda v: v / peak)).otherwise(values)


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Warping distance of two vectors, batched over rows of equal lengths; null where either is null."""
    out = np.full(len(a), np.nan)
    shapes = pd.Series([None if x is None or y is None else (len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=object)
    for (n, m) in {s for s in shapes if s is not None}:
        rows = np.flatnonzero([s == (n, m) for s in shapes])
        for k in range(0, len(rows), 2048):
            part = rows[k : k + 2048]
            out[part] = kernels.dtw(np.stack(a.iloc[part].to_list()) if n else np.empty((len(part), 0)), np.stack(b.iloc[part].to_list()) if m else np.empty((len(part), 0)))
    return pd.Series(out).where(pd.Series([s is not None for s in shapes]), None)


def smoothness(df: DataFrame, key: str, values: str, fs: float) -> DataFrame:
    """Key and sparc of the vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "sparc": [kernels.sparc(v, fs) for v in f[values]]})

    return df.select(key, values).mapInPandas(run, f"{key} long, sparc double")
