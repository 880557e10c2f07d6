"""Statistics of evaluations: closed forms as Columns, quantiles and exact tests on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.bounds import bisect, incomplete_beta

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a rate."""
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (mid - half) / (1 + zz / n), (mid + half) / (1 + zz / n)


def two_proportions_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pool = (k1 + k2) / (n1 + n2)
    return (k1 / n1 - k2 / n2) / F.sqrt(pool * (1 - pool) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))


def normal_tail(z: float) -> float:
    """Two-sided probability."""
    return math.erfc(abs(z) / math.sqrt(2))


def mcnemar(b: int, c: int) -> float:
    """Exact two-sided probability from discordant counts."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def lower_gamma(a: float, x: float) -> float:
    """Regularised incomplete gamma."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        c = b + num / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_quantile(q: float, df: float) -> float:
    top = df + 10 * math.sqrt(2 * df) + 50
    return bisect(lambda x: lower_gamma(df / 2, x / 2) < q, 0.0, top)


def t_quantile(q: float, df: float) -> float:
    """Student's t, for q above one half."""
    return bisect(lambda t: 1 - incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2 < q, 0.0, 1e4)


def df_factor(d: float, n: float, q: float = 0.975) -> float:
    """How much wider an interval is with d instead of n - 1 degrees of freedom, squared."""
    return (t_quantile(q, d) / t_quantile(q, n - 1)) ** 2
