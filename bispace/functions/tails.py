"""Tail probabilities of many values at once, as Arrow-batched functions.

The Column expressions of ``stats`` evaluate a long series for each row; these do the same for whole
batches in numpy, which is what tables of tests by the million take. Nulls give null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument by 10."""
    z = x + 10
    shift = sum(np.log(x + k) for k in range(10))
    return (z - 0.5) * np.log(z) - z + math.log(2 * math.pi) / 2 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int = 20_000) -> np.ndarray:
    """Lentz's evaluation of the incomplete beta function's continued fraction, until all have settled."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, most):
        change = np.ones_like(x)
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            change *= d * c
        h *= change
        if np.all(np.abs(change - 1) < 1e-14):
            break
    return h


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution."""
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[np.isinf(t) & (df > 0)] = 0.0
    t, df = t[ok], df[ok]
    x = df / (df + t * t)
    a, b = df / 2, np.full(len(t), 0.5)
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    front = np.exp(ln_gamma(a + b) - ln_gamma(a) - math.lgamma(0.5) + a * np.log(safe) + b * np.log1p(-safe))
    near = safe < (a + 1) / (a + b + 2)
    p, q = np.where(near, a, b), np.where(near, b, a)
    part = front * beta_fraction(p, q, np.where(near, safe, 1 - safe)) / p
    out[ok] = np.where(inside, np.where(near, part, 1 - part), np.where(x >= 1, 1.0, 0.0))
    return out


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, by batches."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(student_tail(t.to_numpy(np.float64), df.to_numpy(np.float64)))

    return F.nanvl(run(t.cast("double"), df.cast("double")), F.lit(None).cast("double"))


def normal_p(z: Column) -> Column:
    """P(Z >= z) of a standard normal, by batches."""

    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return pd.Series([0.5 * math.erfc(x / math.sqrt(2)) if x == x else math.nan for x in z.to_numpy(np.float64).tolist()])

    return F.nanvl(run(z.cast("double")), F.lit(None).cast("double"))


def mann_whitney_tail(u: Column, n1: Column, n2: Column, ties: Column, two_sided: bool = True) -> Column:
    """Asymptotic p-value of U with corrections for ties and continuity, by batches; equal values give 1."""
    n = (n1 + n2).cast("double")
    variance = n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(ties, n * (n - 1)), F.lit(0.0)))
    mean = n1 * n2 / 2
    away = (F.abs(u - mean) if two_sided else u - mean) - 0.5
    tail = normal_p(F.coalesce(F.try_divide(away, F.sqrt(F.greatest(variance, F.lit(0.0)))), F.lit(0.0))) * (2 if two_sided else 1)
    return F.when(variance > 0, F.least(F.lit(1.0), tail)).otherwise(F.lit(1.0))
