"""What Spark has no function for, as Arrow-batched functions: NFKC, Python's rounding, seeded picks, exact tails.

Catalyst can't push filters through these: filter first.
"""

from __future__ import annotations

import math
import os
import random
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC with white space (Unicode) collapsed and trimmed; null reads as empty."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()) if t else "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [" ".join(unicodedata.normalize("NFKC", t or "").split()) for t in a])


def python_round(column, digits: int = 0):
    """Rounding of the exact binary value, ties to even, as Python's round()."""

    @F.pandas_udf(T.DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else round(v, digits))

    return rounded(column.cast("double"))


def fixed(column, digits: int = 1):
    """Text with so many digits after the point, as Python formats; null gives an empty text."""

    @F.pandas_udf(T.StringType())
    def formatted(x: pd.Series) -> pd.Series:
        return x.map(lambda v: "" if v is None or math.isnan(v) else f"{v:.{digits}f}")

    return formatted(column.cast("double"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def random_named(video_path: pd.Series, total: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """Seeded draw without replacement by the video's name, in temporal order."""

    def pick(v, t, k, s):
        if v is None or t is None or t <= 0:
            return []
        return sorted(random.Random(f"{os.path.basename(v)}|{int(s)}|{int(k)}").sample(range(int(t)), max(1, min(int(k), int(t)))))

    return pd.Series([pick(*x) for x in zip(video_path, total, n, seed, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def random_numpy(total: pd.Series, n: pd.Series, seed: pd.Series) -> pd.Series:
    """Seeded draw without replacement by numpy's generator; all of a clip that is short."""

    def pick(t, k, s):
        return list(range(int(t))) if t <= k else sorted(np.random.default_rng(int(s)).choice(int(t), size=int(k), replace=False).tolist())

    return pd.Series([pick(*x) for x in zip(total, n, seed, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def shuffled_named(items: pd.Series, video_path: pd.Series, seed: pd.Series) -> pd.Series:
    """Seeded permutation by the video's name."""

    def permute(a, v, s):
        a = [int(x) for x in a]
        random.Random(f"shuffle|{os.path.basename(v)}|{int(s)}").shuffle(a)
        return a

    return pd.Series([permute(*x) for x in zip(items, video_path, seed, strict=True)])


def half_tail(n: int, k: int) -> float:
    """P(X <= k) of n fair coins, for 2 * k < n; exact integers for short sums.

    Else the term of k by Stirling's series times the sum of the terms relative to it, from k down. The sum ends where all
    that is left is below its rounding, after some multiple of sqrt(n) terms.
    """
    if n <= 1000 or k < 16:
        return math.ldexp(float(sum(math.comb(n, i) for i in range(k + 1))), -n)
    d = (n - 2 * k) / n
    excess = lambda x: 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    far = n / 2 * ((1 - d) * math.log1p(-d) + (1 + d) * math.log1p(d))
    own = math.sqrt(n / (2 * math.pi * k * (n - k))) * math.exp(excess(n) - excess(k) - excess(n - k) - far)
    total, last, at = 1.0, 1.0, 0
    # Ratios fall, so what is left is at most a geometric series from the last term on.
    while at < k and last * (k - at) > 1e-17 * total * (n - 2 * k + 1 + 2 * at):
        m = np.arange(at, min(k, at + (1 << 14)), dtype=float)
        terms = last * np.cumprod((k - m) / (n - k + 1 + m))
        total, last, at = total + float(terms.sum()), float(terms[-1]), at + len(m)
    return own * total


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact test on discordant pairs: twice the binomial tail of the lesser count, at most 1."""

    def p(x, y):
        return 1.0 if x == y else min(1.0, 2 * half_tail(int(x) + int(y), int(min(x, y))))

    return pd.Series([p(*x) for x in zip(b, c, strict=True)])
