"""Exact binomial intervals, and Student's t."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial_limits(hits: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Clopper-Pearson limits by bisection on the binomial tails; (0, 1) without trials."""
    if n == 0:
        return 0.0, 1.0
    i = np.arange(1, n + 1)
    choose = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))])

    def tail(first: int, last: int, p: float) -> float:
        at = np.arange(first, last + 1)
        return float(np.exp(choose[at] + at * np.log(p) + (n - at) * np.log1p(-p)).sum())

    def root(rises, goal: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if rises(mid) < goal else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if hits == 0 else root(lambda p: tail(hits, n, p), alpha / 2)
    high = 1.0 if hits == n else root(lambda p: -tail(0, hits, p), -alpha / 2)
    return low, high


def clopper_pearson(hits: Column, n: Column, alpha: float = 0.05) -> Column:
    """Struct (lo, hi)."""

    def run(h: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([binomial_limits(int(a), int(b), alpha) for a, b in zip(h, m)], columns=["lo", "hi"])

    run.__annotations__ = {"h": pd.Series, "m": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "lo double, hi double")(hits, n)


def student_tail(t: float, free: float) -> float:
    """P(T > t) for t >= 0, by the regularised incomplete beta function as a continued fraction (modified Lentz)."""
    x, a, b = free / (free + t * t), free / 2, 0.5
    if t == 0:
        return 0.5

    def fraction(x, a, b):
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 10_000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    whole = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return whole / 2


def student_quantile(p: float, free: float) -> float:
    """The t with P(T <= t) = p, for p above one half."""
    lo, hi = 0.0, 1.0
    while 1 - student_tail(hi, free) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - student_tail(mid, free) < p else (lo, mid)
    return (lo + hi) / 2


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t; null below 3 pairs."""

    def run(rs: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for a, m in zip(rs, ns):
            fit = not (pd.isna(a) or pd.isna(m) or m < 3)
            out.append((0.0 if abs(a) >= 1 else 2 * student_tail(abs(a) * math.sqrt((m - 2) / (1 - a * a)), m - 2)) if fit else None)
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"rs": pd.Series, "ns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(r, n)


def normal_p(z: Column) -> Column:
    """One-sided p of a normal deviate."""

    def run(zs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else math.erfc(x / math.sqrt(2)) / 2 for x in zs], dtype="float64")

    run.__annotations__ = {"zs": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(z)
