"""Distribution functions and small-sample tests in plain Python, and as vectorised UDFs.

They run on rows that are already aggregated (one per test), so their cost does not grow with the data.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EPS = 3e-16


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1.0) < EPS:
            break
    return front * h / a


def gammaincc(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > abs(total) * EPS:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - s, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - s)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < EPS:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or not df > 0:
        return math.nan
    return 0.0 if math.isinf(t) else betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or not (d1 > 0 and d2 > 0):
        return math.nan
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) or not df > 0 else gammaincc(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection and Newton steps."""
    lo, hi = -40.0, 40.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_upper(mid) < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=8)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    x, wt = _nodes(96)
    z = x * 8.5
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    base = cdf(z)
    shifted = cdf(z[None, :] - np.atleast_1d(w)[:, None])
    return np.clip(k * 8.5 * np.sum(wt * phi * np.maximum(base - shifted, 0.0) ** (k - 1), axis=1), 0.0, 1.0)


def studentized_range_upper(q: float, k: int, df: float) -> float:
    """P(Q > q) of the studentized range of k means with df degrees of freedom, by quadrature over the scale."""
    if math.isnan(q) or k < 2 or not df > 0:
        return math.nan
    if q <= 0:
        return 1.0
    if df > 20_000:
        return float(1.0 - _range_cdf(np.array([q]), k)[0])
    # scale s = sqrt(chi2_df / df): integrate over its logarithm around the mode
    x, wt = _nodes(80)
    half = min(6.0, 9.0 / math.sqrt(2 * df) + 0.2) if df >= 1 else 8.0
    u = x * half
    s = np.exp(u)
    log_density = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + df * u - df * s * s / 2
    inner = _range_cdf(q * s, k)
    return float(min(1.0, max(0.0, 1.0 - half * np.sum(wt * np.exp(log_density) * inner))))


def mann_whitney_p(u1: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided: exact without ties if a group has at most 8 values, else normal with both corrections."""
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and tie_term == 0:
        return min(1.0, 2.0 * _u_upper(n1, n2, int(round(u))))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))
    return 1.0 if var <= 0 else min(1.0, 2 * normal_upper((u - n1 * n2 / 2 - 0.5) / math.sqrt(var)))


def _u_upper(n1: int, n2: int, u: int) -> float:
    """P(U >= u) without ties, by counting subsets of ranks."""
    m, n = min(n1, n2), max(n1, n2)
    counts = np.zeros((m + 1, m * n + 1))
    counts[0, 0] = 1.0
    for j in range(1, m + n + 1):  # rank j joins the smaller group in place of its smallest possible ranks
        for i in range(min(m, j), 0, -1):
            shift = j - i
            if shift <= n:
                counts[i, shift:] += counts[i - 1, : m * n + 1 - shift]
    row = counts[m]
    return float(row[u:].sum() / row.sum())


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table: all tables at most as likely as the observed one."""
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
    base = choose(n, c1)
    logs = np.array([choose(r1, k) + choose(n - r1, c1 - k) - base for k in range(lo, hi + 1)])
    p = np.exp(logs)
    return float(min(1.0, p[logs <= logs[a - lo] + 1e-7].sum()))


def shapiro_wilk_p(x: np.ndarray) -> float:
    """Royston's approximation of the Shapiro-Wilk p-value for 3 to 5,000 values; NaN for a constant."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return math.nan
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    a = np.zeros(n)
    if n == 3:
        a[2], a[0] = math.sqrt(0.5), -math.sqrt(0.5)
    else:
        u = 1 / math.sqrt(n)
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(ss)], u)
        if n > 5:
            before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ss)], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / np.sum((x - x.mean()) ** 2))
    w = min(w, 1.0)
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(1 - w) if w < 1 else -40.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return normal_upper((y - mu) / sd)
