"""Upper confidence bounds on the flip rate of a stratum, and sampling schedules.

All take flips k among n sampled of N cells, and the error probability delta. Driver-side numpy: what
reaches the cluster are small tables such as the largest certifying count of each look.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np


@lru_cache(8)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))]) if n else np.zeros(1)


def log_factorials(n: int) -> np.ndarray:
    return _log_factorials(1 << max(4, n.bit_length()))


def hypergeometric_cdf(k: int, n: int, total: int, bad: int) -> float:
    """P(at most k bad among n drawn without replacement from total with so many bad)."""
    lo, hi = max(0, n - (total - bad)), min(k, n, bad)
    if k >= min(n, bad):
        return 1.0
    if hi < lo:
        return 0.0
    f, i = log_factorials(total), np.arange(lo, hi + 1)
    logs = f[bad] - f[i] - f[bad - i] + f[total - bad] - f[n - i] - f[total - bad - n + i] - f[total] + f[n] + f[total - n]
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    f, i = log_factorials(n), np.arange(0, k + 1)
    return float(min(1.0, np.exp(f[n] - f[i] - f[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def exact(k: int, n: int, total: int, delta: float) -> float:
    """Finite-population Clopper-Pearson: the most bad cells that would still show k or fewer with
    probability above delta."""
    if n <= 0 or total <= 0:
        return 1.0
    if n >= total:
        return k / total
    lo, hi = k, total - (n - k)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if hypergeometric_cdf(k, n, total, mid) > delta:
            lo = mid
        else:
            hi = mid - 1
    return lo / total


def clopper_pearson(k: int, n: int, total: int, delta: float) -> float:
    if n <= 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(k, n, mid) > delta else (lo, mid)
    return hi


def _variance(k: int, n: int) -> float:
    return k * (n - k) / (n * (n - 1)) if n > 1 else 0.0


def empirical_bernstein(k: int, n: int, total: int, delta: float) -> float:
    """Maurer and Pontil."""
    if n < 2:
        return 1.0
    ln = math.log(2 / delta)
    return min(1.0, k / n + math.sqrt(2 * _variance(k, n) * ln / n) + 7 * ln / (3 * (n - 1)))


def without_replacement(k: int, n: int, total: int, delta: float) -> float:
    """Bardenet and Maillard."""
    if n <= 0:
        return 1.0
    if n >= total:
        return k / n
    ln, kappa = math.log(5 / delta), 7 / 3 + 3 / math.sqrt(2)
    rho = 1 - (n - 1) / total if n <= total / 2 else (1 - n / total) * (1 + 1 / n)
    x = k / n
    return min(1.0, x + math.sqrt(2 * x * (1 - x) * rho * ln / n) + kappa * ln / n)


def betting(flips: Sequence[int], delta: float, grid: int = 400) -> float:
    """Upper bound by a capital process (Waudby-Smith and Ramdas) over flips in sampling order.

    The stake on each flip depends only on those before it, so the bound holds at every sample size at
    once. A rate is refuted when the capital of a bet that the true rate is lower reaches 1/delta;
    the least refuted rate is found by halving and rounded to 1/grid.
    """
    x = np.asarray(flips, float)
    if not len(x):
        return 1.0
    i = np.arange(len(x))
    past = np.concatenate([[0.0], np.cumsum(x)[:-1]])  # flips are 0 or 1: their squares have the same sum
    mean = (0.5 + past) / (1 + i)
    variance = np.maximum((0.25 + past - i * mean**2) / (1 + i), 1e-6)
    stake = np.sqrt(2 * math.log(1 / delta) / (variance * (i + 1) * np.log(i + 2)))

    def refuted(m: float) -> bool:
        gain = 1 + np.minimum(stake, 0.5 / max(1 - m, 1e-9)) * (m - x)
        if (gain <= 0).any():
            return True
        return bool(np.cumsum(np.log(gain)).max() >= math.log(1 / delta))

    if not refuted(1.0):
        return 1.0
    return min(1.0, round(bisect_up(refuted, math.ceil(math.log2(grid))) * grid) / grid)


def bisect_up(f: Callable[[float], bool], steps: int) -> float:
    """The upper end, after so many halvings of 0 to 1, of where f turns from false to true."""
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) else (mid, hi)
    return hi


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, qab, qap, qam = 1e-300, a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((qam + 2 * m) * (a + 2 * m)), -(a + m) * (qab + m) * x / ((a + 2 * m) * (qap + 2 * m))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def bisect(f: Callable[[float], bool], lo: float, hi: float, steps: int = 200) -> float:
    """Where f turns from true to false."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return (lo + hi) / 2


def dispersed(k: int, n: int, total: int, delta: float, phi: float = 1.0) -> float:
    """Clopper-Pearson with counts and sample shrunk by a dispersion factor of 1 or more."""
    if phi < 1:
        raise ValueError("dispersion below 1")
    if n <= 0 or k >= n:
        return 1.0
    return bisect(lambda p: incomplete_beta(k / phi + 1, (n - k) / phi, p) < 1 - delta, 0.0, 1.0, 80)


BOUNDS: dict[str, Callable[[int, int, int, float], float]] = {"exact": exact, "clopper_pearson": clopper_pearson, "empirical_bernstein": empirical_bernstein, "without_replacement": without_replacement, "dispersed": dispersed}


def min_zero(alpha: float, delta: float) -> int:
    """Sample size at which the empirical-Bernstein bound of no flips comes down to alpha."""
    return math.ceil(7 * math.log(2 / delta) / (3 * alpha)) + 1


def plan_fixed(size: int, alpha: float, delta: float, strata: int) -> int:
    return min(size, max(30, min_zero(alpha, delta / strata)))


def look_schedule(size: int, alpha: float, delta: float, first: int = 45, most: int = 6) -> list[int]:
    """Sample sizes of the looks: doubling until the stratum is drawn or looks run out, the last one
    raised to what certifies a stratum without flips."""
    need, looks, n = min_zero(alpha, delta / most), [], first
    while len(looks) < most:
        looks.append(min(n, size))
        if n >= max(need, size):
            break
        n *= 2
    looks[-1] = max(looks[-1], min(need, size))
    return sorted(set(looks))


def k_max(n: int, total: int, alpha: float, delta: float, bound: str = "exact", reuse_set: bool = False) -> int:
    """The most flips among n with which a stratum is certified; -1: not even with none."""
    limit = alpha * (total - n) / total if reuse_set else alpha
    if n >= total:
        return -1
    f = BOUNDS[bound]
    lo, hi = -1, n
    while lo < hi:  # bounds rise with k
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if f(mid, n, total, delta) <= limit else (lo, mid - 1)
    return lo


def looks_table(sizes: dict[str, int], alpha: float, delta: float, first: int = 45, most: int = 6, bound: str = "exact", reuse_set: bool = False) -> list[tuple[str, int, int, int]]:
    """(stratum, look, n, k_max) for strata of these sizes; delta is shared among strata and looks."""
    out = []
    for stratum, size in sizes.items():
        own = delta / len(sizes)
        ns = look_schedule(size, alpha, own, first, most)
        out += [(stratum, i, n, k_max(n, size, alpha, own / len(ns), bound, reuse_set)) for i, n in enumerate(ns, 1)]
    return out


def unsafe_probability(total: int, bad: int, alpha: float, delta: float, first: int = 45, most: int = 6, reuse_set: bool = False) -> float:
    """Exact probability that a stratum with so many bad cells is certified, looks and early stops included."""
    ns = look_schedule(total, alpha, delta, first, most)
    alive, drawn, certified = {0: 1.0}, 0, 0.0
    for n in ns:
        f, new = log_factorials(total), {}
        for k, p in alive.items():
            left, bad_left, m = total - drawn, bad - k, n - drawn
            for i in range(max(0, m - (left - bad_left)), min(m, bad_left) + 1):
                q = math.exp(f[bad_left] - f[i] - f[bad_left - i] + f[left - bad_left] - f[m - i] - f[left - bad_left - m + i] - f[left] + f[m] + f[left - m])
                new[k + i] = new.get(k + i, 0.0) + p * q
        top = k_max(n, total, alpha, delta / len(ns), "exact", reuse_set)
        certified += sum(p for k, p in new.items() if k <= top)
        alive, drawn = {k: p for k, p in new.items() if k > top and k / n <= alpha}, n
    return certified
