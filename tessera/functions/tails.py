"""Tails of the normal, t and chi-square distributions as vectorised functions.

Spark has none of them. Series and continued fractions follow the standard
expansions of the incomplete beta and gamma functions; ``*_p`` apply them to
columns, whole Arrow batches at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def _lgamma(x):
    """ln of the gamma function of positive numbers: Stirling's series from 10 on, smaller ones raised to there first."""
    y, below = np.array(x, float), np.ones(np.shape(x))
    for _ in range(10):
        small = y < 10
        below, y = np.where(small, below * y, below), np.where(small, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(below)


def upper_gamma(a, v):
    """The regularised upper incomplete gamma function Q(a, v), arrays at a time: a series below a + 1, a continued fraction above."""
    a, v = (np.array(t, float) for t in np.broadcast_arrays(np.asarray(a, float), np.asarray(v, float)))
    out = np.where(np.isnan(v) | np.isnan(a), np.nan, np.where(v <= 0, 1.0, 0.0))
    for low in (True, False):
        at = np.isfinite(v) & np.isfinite(a) & (v > 0) & ((v < a + 1) == low)
        if not at.any():
            continue
        b, x = a[at], v[at]
        front = np.exp(np.maximum(-x + b * np.log(x) - _lgamma(b), -745.0))
        if low:
            term = 1 / b
            total, n = term.copy(), b.copy()
            while np.any(np.abs(term) > np.abs(total) * 1e-17):
                n += 1
                term = term * x / n
                total += term
            out[at] = 1 - total * front
        else:
            c, k = x + 1 - b, np.full(b.shape, 1e300)
            d = 1 / c
            h = d.copy()
            for i in range(1, 2000):
                an = -i * (i - b)
                c = c + 2
                d = an * d + c
                d = 1 / np.where(np.abs(d) < TINY, TINY, d)
                k = c + an / k
                k = np.where(np.abs(k) < TINY, TINY, k)
                h = h * d * k
                if np.all(np.abs(d * k - 1) < 1e-15):
                    break
            out[at] = h * front
    return out


def _erfc(x):
    x = np.asarray(x, float)
    tail = upper_gamma(0.5, x * x)
    return np.where(x < 0, 2 - tail, tail)


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def log_normal_upper(z):
    """ln P(Z > z), by the asymptotic series where the tail underflows."""
    z = np.asarray(z, float)
    near = np.log(np.maximum(0.5 * _erfc(np.minimum(z, 30) / math.sqrt(2)), TINY))
    w = np.maximum(z, 30.0)
    far = -0.5 * w * w - np.log(w * math.sqrt(2 * math.pi)) + np.log1p(-1 / w**2 + 3 / w**4 - 15 / w**6)
    return np.where(z > 30, far, near)


def log_beta_tail(x, a, b):
    """ln of the regularised incomplete beta function I_x(a, b), for 0 <= x <= 1."""
    x, a, b = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float), np.asarray(b, float))
    swap = x > (a + 1) / (a + b + 2)
    u, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    u = np.clip(u, TINY, 1)
    front = p * np.log(u) + q * np.log1p(-np.minimum(u, 1 - 1e-16)) - np.log(p) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))
    c, d = np.ones_like(u), 1 - (p + q) * u / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * u / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * u / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    direct = front + np.log(h)
    return np.where(swap, np.log(np.maximum(-np.expm1(np.minimum(direct, 0)), TINY)), direct)


def log_t_two_sided(t, df):
    """ln P(|T| > |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return log_beta_tail(df / (df + t * t), df / 2, 0.5)


def t_two_sided(t, df):
    return np.exp(log_t_two_sided(t, df))


def chi2_upper(x, df):
    """P(X > x) for a chi-square variable."""
    return upper_gamma(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def _normal(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, normal_two_sided(z.fillna(0))))


def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    bad = t.isna() | df.isna() | (df <= 0)
    return pd.Series(np.where(bad, np.nan, t_two_sided(t.where(~bad, 0), df.where(~bad, 1))))


def _t_log10(t: pd.Series, df: pd.Series) -> pd.Series:
    bad = t.isna() | df.isna() | (df <= 0)
    return pd.Series(np.where(bad, np.nan, log_t_two_sided(t.where(~bad, 0), df.where(~bad, 1)) / math.log(10)))


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    bad = x.isna() | df.isna() | (df <= 0)
    return pd.Series(np.where(bad, np.nan, chi2_upper(x.where(~bad, 0), df.where(~bad, 1))))


@lru_cache(maxsize=256)
def rank_sum_shares(m: int, n: int) -> np.ndarray:
    """P(W <= w) of the rank-sum statistic of m and n rows without ties, for w from 0 to m * n.

    How many ways there are for each w are the coefficients of a product of
    (1 - q^(n+i)) / (1 - q^i) over i up to m, in whole numbers.
    """
    ways = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for w in range(m * n, n + i - 1, -1):
            ways[w] -= ways[w - n - i]
        for w in range(i, m * n + 1):
            ways[w] += ways[w - i]
    total = sum(ways)
    return np.array([x / total for x in accumulate(ways)])


def rank_sum_two_sided(w: float, m: int, n: int) -> float:
    """Exact two-sided P of a rank-sum statistic: twice the smaller tail, 1 at most."""
    below = rank_sum_shares(m, n)
    tail = 1 - below[int(w) - 1] if w > m * n / 2 else below[int(w)]
    return float(min(1.0, 2 * tail))


def _rank_sum(w: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([np.nan if pd.isna(a) or pd.isna(b) or pd.isna(c) or b < 1 or c < 1 else rank_sum_two_sided(a, int(b), int(c)) for a, b, c in zip(w, m, n)], dtype=float)


def rank_sum_p(w, m, n) -> Column:
    """Exact two-sided P of a rank-sum statistic of ``m`` and ``n`` rows without ties; null where one is null."""
    return F.nullif(F.pandas_udf(_rank_sum, "double")(w, m, n), F.lit(float("nan")))


def normal_p(z) -> Column:
    """Two-sided P of a standard normal statistic."""
    return F.pandas_udf(_normal, "double")(z)


def t_p(t, df) -> Column:
    """Two-sided P of a t statistic."""
    return F.pandas_udf(_t, "double")(t, df)


def t_log10_p(t, df) -> Column:
    """log10 of the two-sided P of a t statistic."""
    return F.pandas_udf(_t_log10, "double")(t, df)


def chi2_p(x, df) -> Column:
    """Upper tail of a chi-square statistic."""
    return F.pandas_udf(_chi2, "double")(x, df)
