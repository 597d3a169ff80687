"""Distribution functions for p-values (scipy is not available): the regularised incomplete beta
and gamma functions from their continued fractions and series (NIST Digital Library of
Mathematical Functions, 8.17.22, 8.9.2 in its contracted form, and 8.11.4), the normal law via
``erfc``, the studentized range by Gauss-Legendre quadrature. Scalars only: every test reduces the
data to a handful of statistics on Spark first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

PRECISION = 1e-15


def continued_fraction(terms: Iterator[tuple[float, float]]) -> float:
    """a1 / (b1 + a2 / (b2 + ...)) of pairs (a, b): numerators and denominators of the convergents follow one
    recurrence, scaled so that the denominator stays 1, until the value settles."""
    before, now, value = (1.0, 0.0), (0.0, 1.0), 0.0
    for a, b in terms:
        before, now = now, (b * now[0] + a * before[0], b * now[1] + a * before[1])
        if now[1]:
            before, now = (before[0] / now[1], before[1] / now[1]), (now[0] / now[1], 1.0)
            if abs(now[0] - value) <= PRECISION * abs(now[0]):
                return now[0]
            value = now[0]
    return value


def _beta_terms(a: float, b: float, x: float) -> Iterator[tuple[float, float]]:
    yield 1.0, 1.0
    for k in range(1, 20_000):
        m, odd = divmod(k, 2)
        yield (-(a + m) * (a + b + m) if odd else m * (b - m)) * x / ((a + k - 1) * (a + k)), 1.0


def _gamma_terms(a: float, x: float) -> Iterator[tuple[float, float]]:
    yield 1.0, x + 1.0 - a
    for k in range(1, 100_000):
        yield k * (a - k), x + 2 * k + 1.0 - a


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * continued_fraction(_beta_terms(a, b, x)) / a
    return 1.0 - bt * continued_fraction(_beta_terms(b, a, 1.0 - x)) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _power_factor(a: float, x: float) -> float:
    """x ** a * exp(-x) / gamma(a)."""
    return math.exp(a * math.log(x) - x - math.lgamma(a))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): the series of the lower one up to about its mean, the
    continued fraction beyond."""
    if x <= 0:
        return 1.0
    if x >= a + 1.0:
        return _power_factor(a, x) * continued_fraction(_gamma_terms(a, x))
    term = total = 1.0 / a
    k = a
    while term > PRECISION * total:
        k += 1.0
        term *= x / k
        total += term
    return 1.0 - _power_factor(a, x) * total


def chi2_sf(x: float, df: float) -> float:
    if x is None or math.isnan(x) or df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    return gamma_upper(df / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the CDF (for confidence intervals)."""
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        cdf = 1 - 0.5 * t_sf2(mid, df) if mid >= 0 else 0.5 * t_sf2(mid, df)
        if cdf < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def ptukey_sf(q: float, k: int, df: float, n_nodes: int = 64) -> float:
    """Upper tail of the studentized range distribution, P(Q > q), by Gauss-Legendre
    quadrature over the range of k normals (inner) and the scaled chi variable (outer)."""
    if q <= 0:
        return 1.0
    xs, ws = np.polynomial.legendre.leggauss(n_nodes)

    def prange(w):  # P(range of k std normals < w)
        if w <= 0:
            return 0.0
        lo, hi = -8.0, 8.0
        z = (hi - lo) / 2 * xs + (hi + lo) / 2
        phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        cdf_hi = 0.5 * np.vectorize(math.erfc)(-(z + w) / math.sqrt(2))
        cdf_lo = 0.5 * np.vectorize(math.erfc)(-z / math.sqrt(2))
        inner = np.clip(cdf_hi - cdf_lo, 0, 1) ** (k - 1)
        return float(k * (hi - lo) / 2 * np.sum(ws * phi * inner))

    if df is None or math.isinf(df) or df > 5000:
        return 1.0 - prange(q)
    # s ~ chi_df / sqrt(df); integrate P(range < q s) f(s) ds over s in (0, smax)
    smax = 1 + 10 / math.sqrt(df)
    s = (smax / 2) * xs + smax / 2
    logf = (math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
            + (df - 1) * np.log(s) - df * s * s / 2)
    dens = np.exp(logf)
    vals = np.array([prange(q * si) for si in s])
    cdf = float(smax / 2 * np.sum(ws * dens * vals))
    return min(1.0, max(0.0, 1.0 - cdf))


def kendall_exact_p(n: int, discordant: int) -> float:
    """Two-sided p-value of Kendall's tau without ties: the share of the n! orders whose number of inversions is
    at least as far out. Orders by inversions follow from adding one element at a time, which brings 0, 1, ... new ones."""
    pairs = n * (n - 1) // 2
    low = min(discordant, pairs - discordant)
    ways = [1] + [0] * low  # orders with 0 ... low inversions, as whole numbers
    for m in range(2, n + 1):
        run, new = 0, []
        for k in range(low + 1):
            run += ways[k] - (ways[k - m] if k >= m else 0)
            new.append(run)
        ways = new
    if 2 * low == pairs:
        return 1.0
    return min(1.0, 2 * sum(ways) / math.factorial(n))
