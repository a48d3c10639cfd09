"""Log-gamma, edge likelihood terms and binomial tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

import termloom.session  # noqa: F401


def log_gamma(x: Column) -> Column:
    """Natural logarithm of gamma for x > 0: Stirling's series at x + 10 for small x, inside codegen."""
    x = x.cast("double")
    z = F.when(x < 10.0, x + 10.0).otherwise(x)
    product = x
    for i in range(1, 10):
        product = product * (x + float(i))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    big = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    return F.when(x < 10.0, big - F.ln(product)).otherwise(big)


def pair_probability(k_a: Column, k_b: Column, total: Column) -> Column:
    """Chance of a weight unit falling on a pair: ``k_a k_b / (2 T^2)``; 0 for an empty graph."""
    t = total.cast("double")
    return F.when(t > 0, k_a.cast("double") * k_b.cast("double") / (2.0 * t * t)).otherwise(0.0)


def log_likelihood_term(w: Column, k_a: Column, k_b: Column, total: Column) -> Column:
    """``w ln(p) - ln gamma(w + 1)``; 0 where the weight, a strength or the probability is 0."""
    p = pair_probability(k_a, k_b, total)
    wd = w.cast("double")
    return F.when((wd > 0) & (p > 0), wd * F.ln(p) - log_gamma(wd + 1.0)).otherwise(0.0)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.where(x < 10, 10.0, 0.0)
    z = x + shift
    big = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    low = np.minimum(x, 10.0)
    product = np.prod([low + i for i in range(10)], axis=0)
    return np.where(x < 10, big - np.log(product), big)


def binomial_tail_log(w: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Natural logarithm of P(X >= w) for X ~ Bin(n, p): the regularised incomplete beta function by Lentz's continued fraction.

    Worked out in logarithms, so tails far below the smallest double keep their digits.
    """
    w, n, p = (np.asarray(a, dtype=float) for a in (w, n, p))
    out = np.where(w <= 0, 0.0, np.where((p <= 0) | (w > n), -np.inf, np.where(p >= 1, 0.0, np.nan)))
    todo = np.isnan(out) & ~np.isnan(w) & ~np.isnan(n) & ~np.isnan(p)
    if not todo.any():
        return out
    a, b, x = w[todo], n[todo] - w[todo] + 1, p[todo]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x) - np.log(a)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    log = np.minimum(front + np.log(np.maximum(h, tiny)), 0.0)
    with np.errstate(divide="ignore"):
        out[todo] = np.where(swap, np.log1p(-np.exp(log)), log)
    return out


def binomial_tail(w: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= w) for X ~ Bin(n, p)."""
    return np.exp(binomial_tail_log(w, n, p))


@F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("log10_p", T.DoubleType())]))
def binomial_tail_udf(w: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
    log = binomial_tail_log(w.to_numpy(), n.to_numpy(), p.to_numpy())
    return pd.DataFrame({"p": np.exp(log), "log10_p": log / math.log(10)})
