"""Small solvers on the driver: their inputs are sums that Spark has aggregated, never rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame


def matrix_of(entries: DataFrame, n: int, columns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """X'WX (n x n) and X'Wy (n x columns) from ``normal_equations``."""
    a, b = np.zeros((n, n)), np.zeros((n, columns))
    for r in entries.collect():  # (n + columns) * n numbers at most
        i, j, v = r["i"], r["j"], r["value"] or 0.0
        if j < n:
            a[i, j] = a[j, i] = v
        else:
            b[i, j - n] = v
    return a, b


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, b, rcond=None)[0]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 that minimises ``x'ax/2 - b'x``, by an active set."""
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-10 * max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(rounds):
        g = b - a @ x
        g[free] = -np.inf
        k = int(g.argmax())
        if g[k] <= tol:
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[np.ix_(free, free)], b[free], rcond=None)[0]
            if s[free].min(initial=0.0) >= 0:
                x = s
                break
            bad = free & (s < 0)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            free &= x > 1e-14
            x[~free] = 0.0
    return x


def newton(f: Callable, x: np.ndarray, rounds: int = 60, tol: float = 1e-10) -> np.ndarray:
    """Damped Newton with backtracking; ``f`` gives value, gradient and Hessian of a convex function."""
    v, g, h = f(x)
    for _ in range(rounds):
        step = np.linalg.lstsq(h + 1e-12 * np.eye(len(x)), -g, rcond=None)[0]
        if np.abs(step).max() < tol:
            break
        t = 1.0
        while t > 1e-10:
            w, gn, hn = f(x + t * step)
            if np.isfinite(w) and w <= v + 1e-4 * t * float(g @ step):
                x, v, g, h = x + t * step, w, gn, hn
                break
            t /= 2
        else:
            break
    return x


def solve_scales(c: np.ndarray, gaussian: np.ndarray, rhs: np.ndarray, weight: np.ndarray, prior: np.ndarray | None = None, centre: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Component scales from observations: Gaussian rows by weighted squares, Poisson rows by likelihood, with a quadratic prior on the logs."""
    n = c.shape[1]
    prior = np.zeros((n, n)) if prior is None else prior
    centre = np.zeros(n) if centre is None else centre

    def f(u):
        k = np.exp(u)
        m = c @ k
        mg, mp = m[gaussian], np.maximum(m[~gaussian], 1e-30)
        r = mg - rhs[gaussian]
        d = u - centre
        value = 0.5 * (weight[gaussian] * r * r).sum() + (mp - rhs[~gaussian] * np.log(mp)).sum() + 0.5 * d @ prior @ d
        jac = c * k
        slope, curve = np.empty(len(m)), np.empty(len(m))
        slope[gaussian], curve[gaussian] = weight[gaussian] * r, weight[gaussian]
        slope[~gaussian], curve[~gaussian] = 1 - rhs[~gaussian] / mp, rhs[~gaussian] / mp**2
        return value, jac.T @ slope + prior @ d, (jac * curve[:, None]).T @ jac + np.diag(np.maximum(jac.T @ slope, 0)) + prior

    return np.exp(newton(f, np.zeros(n) if start is None else np.log(start)))


def powell(f: Callable[[np.ndarray], float], x: np.ndarray, rounds: int = 100, tol: float = 1e-8, reach: float = 1.0) -> np.ndarray:
    """Derivative-free minimum by line searches along directions that learn from each round."""
    x = np.asarray(x, float)
    dirs, best = np.eye(len(x)), f(x)
    for _ in range(rounds):
        start, first, drop, worst = x.copy(), best, 0.0, 0
        for i, d in enumerate(dirs):
            before = best
            x, best = _line(f, x, d, best, reach)
            if before - best > drop:
                drop, worst = before - best, i
        if 2 * (first - best) <= tol * (abs(first) + abs(best)) + 1e-20:
            break
        move = x - start
        if f(x + move) < first and np.abs(move).max() > 0:
            x, best = _line(f, x, move, best, reach)
            dirs[worst] = move / np.linalg.norm(move)
    return x


def _line(f, x, d, best, reach):
    ratio = (5**0.5 - 1) / 2
    lo, hi = -reach, reach
    for _ in range(8):  # widen while the edge is best
        if f(x + hi * d) < best:
            hi *= 2
        elif f(x + lo * d) < best:
            lo *= 2
        else:
            break
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = f(x + a * d), f(x + b * d)
    for _ in range(80):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = f(x + a * d)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = f(x + b * d)
        if hi - lo < 1e-10:
            break
    t = (lo + hi) / 2
    value = f(x + t * d)
    return (x + t * d, value) if value < best else (x, best)


def levenberg_marquardt(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, rounds: int = 200, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounded nonlinear least squares: the parameters and their covariance."""
    x = np.asarray(x, float)
    clip = lambda y: np.clip(y, -np.inf if low is None else low, np.inf if high is None else high)

    def jacobian(y, r):
        out = np.empty((len(r), len(y)))
        for i in range(len(y)):
            h = 1e-6 * max(1.0, abs(y[i]))
            z = y.copy()
            z[i] += h
            out[:, i] = (residual(z) - r) / h
        return out

    r, damp = residual(x), 1e-3
    for _ in range(rounds):
        j = jacobian(x, r)
        a = j.T @ j
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -j.T @ r, rcond=None)[0]
        y = clip(x + step)
        s = residual(y)
        if s @ s < r @ r:
            done = r @ r - s @ s < 1e-14 * (r @ r + 1e-30)
            x, r, damp = y, s, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    j = jacobian(x, r)
    return x, np.linalg.pinv(j.T @ j) * (r @ r) / max(1, len(r) - len(x))


def fit_double_exponential(t: np.ndarray, y: np.ndarray, w: np.ndarray, starts: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(w, tau_s, tau_l) with tau_l >= tau_s of a mix of two exponentials through weighted logs, the best of several starts."""
    root = np.sqrt(w)

    def residual(p):
        mix = 1 / (1 + np.exp(-p[0]))
        ts, tl = np.exp(p[1]), np.exp(p[1]) + np.exp(p[2])
        return root * (np.log(np.maximum(mix * np.exp(-t / ts) + (1 - mix) * np.exp(-t / tl), 1e-300)) - np.log(y) - p[3])

    best = None
    for m, ts, tl in starts:
        p, cov = levenberg_marquardt(residual, np.array([np.log(m / (1 - m)), np.log(ts), np.log(max(tl - ts, 1e-3)), 0.0]))
        v = float((residual(p) ** 2).sum())
        if best is None or v < best[0]:
            best = v, p, cov
    _, p, cov = best
    ts = np.exp(p[1])
    grad = np.diag([1 / (1 + np.exp(-p[0])) * (1 - 1 / (1 + np.exp(-p[0]))), ts, np.exp(p[2])])
    grad[2, 1] = ts
    return np.array([1 / (1 + np.exp(-p[0])), ts, ts + np.exp(p[2])]), delta_covariance(grad, cov[:3, :3])


def delta_covariance(jacobian: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    return jacobian @ covariance @ jacobian.T


def prior_precision(*covariances: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Pseudo-inverse of summed covariances with a floor on the diagonal."""
    total = np.sum(covariances, axis=0)
    return np.linalg.pinv(total + floor * np.eye(len(total)))


def loglog_polynomial(sums: np.ndarray) -> np.ndarray:
    """Coefficients 1, x, x**2 from the sums n, x, x2, x3, x4, y, xy, x2y of logs."""
    n, s1, s2, s3, s4, y0, y1, y2 = sums
    return np.linalg.solve(np.array([[n, s1, s2], [s1, s2, s3], [s2, s3, s4]]), np.array([y0, y1, y2]))


def interpolate_loglog(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Log-log interpolation, constant beyond the ends."""
    return np.exp(np.interp(np.log(x), np.log(xs), np.log(ys)))


def damped(old: dict[str, float], new: dict[str, float], part: float, linear: tuple[str, ...] = ("w",)) -> dict[str, float]:
    """A step from old to new parameters: linear for those named, geometric for the others."""
    return {k: (1 - part) * old[k] + part * new[k] if k in linear else old[k] ** (1 - part) * new[k] ** part for k in old}


def furness(o: np.ndarray, d: np.ndarray, f: np.ndarray, tol: float = 1e-9, rounds: int = 3000) -> np.ndarray:
    """Balanced flows of a matrix that fits the driver; stops when the largest row error is ``tol`` of the mean row."""
    reach = f.sum(axis=1) > 0
    d = d * o[reach].sum() / max(d[f.sum(axis=0) > 0].sum(), 1e-300)
    inv = lambda s: np.where(s > 0, 1 / np.where(s > 0, s, 1), 0.0)
    b = np.ones(len(d))
    for _ in range(rounds):
        a = inv(f @ (b * d))
        b = inv(f.T @ (a * o))
        err = np.abs(a * o * (f @ (b * d)) - np.where(reach, o, 0)).max(initial=0.0)
        if err < tol * max(o[o > 0].mean() if (o > 0).any() else 0.0, 1e-300):
            break
    a = inv(f @ (b * d))
    return (a * o)[:, None] * f * (b * d)[None, :]
