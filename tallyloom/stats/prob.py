"""Tail probabilities from the standard library's functions, for tables of a few hundred rows."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    """Chance of a standard normal above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """The standard normal's quantile, by bisection on its tail."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_sf(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float | None, dof: int) -> float | None:
    """Chance of a chi-square above x."""
    if x is None or dof < 1:
        return None
    return math.erfc(math.sqrt(x / 2)) if dof == 1 else gamma_q(dof / 2, x / 2)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float | None, float]:
    """Sample odds ratio and two-sided p of a 2x2 table: all tables no likelier than this one, with 1e-7 of tolerance."""
    row, col, n = a + b, a + c, a + b + c + d
    odds = a * d / (b * c) if b * c else (math.inf if a * d else None)
    lo, hi = max(0, row + col - n), min(row, col)
    whole = log_choose(n, col)
    logs = [log_choose(row, k) + log_choose(n - row, col - k) - whole for k in range(lo, hi + 1)]
    bound = logs[a - lo] + math.log1p(1e-7)
    return odds, min(1.0, sum(math.exp(x) for x in logs if x <= bound))


def binomial_ppf(q: float, n: int, p: float = 0.5) -> int:
    """The least k with at least q of the distribution up to it."""
    # Sums begin where the distribution does: what lies forty standard deviations below the mean is 0 in double precision.
    begin = max(0, int(n * p - 40 * math.sqrt(n * p * (1 - p)) - 40))
    total = 0.0
    for k in range(begin, n + 1):
        total += math.exp(log_choose(n, k) + (k * math.log(p) if k else 0) + ((n - k) * math.log1p(-p) if n - k else 0))
        if total >= q * (1 - 1e-12):
            return k
    return n
