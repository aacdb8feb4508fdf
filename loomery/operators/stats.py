"""Exact binomial intervals."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def clopper_pearson(rates: DataFrame, level: float = 0.95) -> DataFrame:
    """Rows with n and x get ``low`` and ``high``, the exact interval of the rate in permille (rounded)."""
    tail_size = (1 - level) / 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Self-contained, so that workers need nothing but numpy.
        def tail(n: int, x: int, p: float) -> float:
            """P(X >= x) for X ~ Bin(n, p)."""
            if x <= 0 or p >= 1:
                return 1.0
            if p <= 0:
                return 0.0
            # The incomplete beta integral; its fraction converges in some root of n steps on this side of the mean.
            a, b = x, n - x + 1
            scale = lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(p) + b * log1p(-p)
            if p < (a + 1) / (a + b + 2):
                return min(1.0, exp(scale) * fraction(a, b, p) / a)
            return max(0.0, 1 - exp(scale) * fraction(b, a, 1 - p) / b)

        def fraction(a: int, b: int, p: float) -> float:
            """The continued fraction of the incomplete beta integral, by Lentz's method."""
            tiny = 1e-300
            c, d = 1.0, 1 / ((1 - (a + b) * p / (a + 1)) or tiny)
            value, m = d, 0
            while True:
                m += 1
                step = 1.0
                for of in (m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / ((1 + of * d) or tiny), (1 + of / c) or tiny
                    step = d * c
                    value *= step
                if not abs(step - 1) >= 1e-14:
                    return value

        def solve(f, goal: float) -> float:
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if f(mid) < goal else (lo, mid)
            return (lo + hi) / 2

        for b in batches:
            low, high = [], []
            for n, x in zip(b["n"].tolist(), b["x"].tolist()):
                low.append(0.0 if x == 0 else solve(lambda p: tail(n, x, p), tail_size))
                high.append(1.0 if x == n else solve(lambda p: tail(n, x + 1, p), 1 - tail_size))
            yield b.assign(low=np.round(np.array(low) * 1000, 3), high=np.round(np.array(high) * 1000, 3))

    schema = T.StructType([*rates.schema.fields, T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    return rates.mapInPandas(run, schema)
