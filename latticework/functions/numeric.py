"""Tail probabilities, multiple-testing adjustment and small optimisers in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection on the complementary error function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_sf(mid) < p else (low, mid)
    return (low + high) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def adjust(p: np.ndarray, method: str = "BH") -> np.ndarray:
    """Adjusted p-values: BH, BY, holm, bonferroni or none; missing ones stay missing."""
    p = np.asarray(p, dtype=float)
    out, at = np.full(len(p), np.nan), np.flatnonzero(~np.isnan(p))
    own, n = p[at], len(at)
    if method == "none" or not n:
        out[at] = own
        return out
    if method == "bonferroni":
        out[at] = np.minimum(1, own * n)
        return out
    order = np.argsort(own, kind="stable")
    rank = np.arange(1, n + 1)
    if method == "holm":
        found = np.maximum.accumulate(own[order] * (n - rank + 1))
    elif method in ("BH", "BY"):
        extra = (1 / rank).sum() if method == "BY" else 1
        found = np.minimum.accumulate((own[order] * n / rank * extra)[::-1])[::-1]
    else:
        raise ValueError(f"unknown adjustment {method!r}")
    out[at[order]] = np.minimum(1, found)
    return out


def permutation_p(observed: float, simulated: np.ndarray, expected: float = 0.0, alternative: str = "two.sided") -> float:
    """(extreme + 1) / (draws + 1); two-sided around the expectation."""
    simulated = np.asarray(simulated, dtype=float)
    if alternative == "greater":
        extreme = simulated >= observed
    elif alternative == "less":
        extreme = simulated <= observed
    elif alternative == "two.sided":
        extreme = np.abs(simulated - expected) >= abs(observed - expected)
    else:
        raise ValueError(f"unknown alternative {alternative!r}")
    return (int(extreme.sum()) + 1) / (len(simulated) + 1)


def golden(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-10) -> float:
    """Minimum of a unimodal function on an interval."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance * (1 + abs(low) + abs(high)):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 4000, tolerance: float = 1e-13) -> np.ndarray:
    """Bounded Nelder-Mead minimum."""
    clip = lambda x: np.clip(x, low, high)
    n = len(start)
    points = [clip(np.asarray(start, dtype=float))]
    for k in range(n):
        x = points[0].copy()
        x[k] = x[k] * 1.2 + 0.05 * (high[k] - low[k] if np.isfinite(high[k]) else 1)
        points.append(clip(x))
    values = [f(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + 1e-300):
            break
        centre = np.mean(points[:-1], axis=0)
        away = clip(centre + (centre - points[-1]))
        fa = f(away)
        if fa < values[0]:
            far = clip(centre + 2 * (centre - points[-1]))
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < values[-2]:
            points[-1], values[-1] = away, fa
        else:
            near = clip(centre + 0.5 * (points[-1] - centre))
            fn = f(near)
            if fn < values[-1]:
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [clip(points[0] + 0.5 * (x - points[0])) for x in points[1:]]
                values = [values[0]] + [f(x) for x in points[1:]]
    return points[int(np.argmin(values))]


def weighted_quantile(x: np.ndarray, w: np.ndarray, p: float) -> float:
    """The first sorted value whose share of the weight reaches p."""
    order = np.argsort(x, kind="stable")
    share = np.cumsum(w[order]) / w.sum()
    return float(x[order][np.searchsorted(share, p - 1e-15)])


def least_squares(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse cross product and residual sum of squares."""
    root = np.sqrt(w)[:, None] if w is not None else 1.0
    a, b = x * root, y * (root[:, 0] if w is not None else 1.0)
    inverse = np.linalg.pinv(a.T @ a)
    beta = inverse @ (a.T @ b)
    return beta, inverse, float(((b - a @ beta) ** 2).sum())


def streams(seed: int | None, n: int) -> list[int]:
    """One seed for each draw, all drawn before any work: results don't depend on how it is split."""
    return np.random.default_rng(seed).integers(0, 2**63 - 1, size=n).tolist()
