"""Gaussian maximum likelihood for one GARCH(1,1) window: the small numeric helper of the grouped fit job."""

from __future__ import annotations

import math

import numpy as np

SCALE = 100.0
MIN_OBS = 30
_BLOCK = 50
_MAX_PERSISTENCE = 0.9999
_LAGS = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
_LOWER = _LAGS >= 0
_EXPONENTS = np.where(_LOWER, _LAGS, 0)


def variance_path(eps2: np.ndarray, omega: float, alpha: float, beta: float, seed: float) -> np.ndarray:
    """The variance recursion, in blocks of 50 rows solved by one matrix product."""
    n = len(eps2)
    drive = omega + alpha * np.concatenate(([seed], eps2[:-1]))
    drive[0] += beta * seed
    padded = np.zeros(-(-n // _BLOCK) * _BLOCK)
    padded[:n] = drive
    powers = np.where(_LOWER, np.power(beta, _EXPONENTS), 0.0)
    local = padded.reshape(-1, _BLOCK) @ powers.T
    decay = np.power(beta, np.arange(1, _BLOCK + 1))
    carry = 0.0
    for row in local:
        row += decay * carry
        carry = row[-1]
    return local.ravel()[:n]


def log_likelihood(x: np.ndarray, mu: float, omega: float, alpha: float, beta: float) -> float:
    eps = x - mu
    sigma2 = variance_path(eps * eps, omega, alpha, beta, float(np.var(eps, ddof=1)))
    if not np.all(np.isfinite(sigma2)) or sigma2.min() <= 0:
        return -math.inf
    return float(-0.5 * np.sum(math.log(2 * math.pi) + np.log(sigma2) + eps * eps / sigma2))


def _unpack(point: np.ndarray) -> tuple[float, float, float, float]:
    """Free coordinates to (mu, omega, alpha, beta): persistence and the share of alpha in it are logistic."""
    persistence = _MAX_PERSISTENCE / (1 + math.exp(-min(max(point[2], -40), 40)))
    share = 1 / (1 + math.exp(-min(max(point[3], -40), 40)))
    return point[0], math.exp(min(max(point[1], -60), 60)), persistence * share, persistence * (1 - share)


def _minimise(f, start: np.ndarray, step: float, max_iter: int = 800, tol: float = 1e-9) -> tuple[np.ndarray, float, bool]:
    """Nelder-Mead with the standard coefficients."""
    size = len(start)
    points = np.vstack([start] + [start + step * np.eye(size)[i] for i in range(size)])
    values = np.array([f(p) for p in points])
    for _ in range(max_iter):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if abs(values[-1] - values[0]) <= tol * (1 + abs(values[0])) and np.abs(points[1:] - points[0]).max() <= 1e-5:
            return points[0], values[0], True
        centre = points[:-1].mean(axis=0)
        reflected = 2 * centre - points[-1]
        value = f(reflected)
        if value < values[0]:
            far = 3 * centre - 2 * points[-1]
            far_value = f(far)
            points[-1], values[-1] = (far, far_value) if far_value < value else (reflected, value)
        elif value < values[-2]:
            points[-1], values[-1] = reflected, value
        else:
            inner = (centre + reflected) / 2 if value < values[-1] else (centre + points[-1]) / 2
            inner_value = f(inner)
            if inner_value < min(value, values[-1]):
                points[-1], values[-1] = inner, inner_value
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best], False


def _std_errors(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Square roots of the inverse numeric Hessian's diagonal; NaN where it is not positive definite."""
    step = np.maximum(np.abs(theta), 1e-3) * 1e-3
    f = lambda t: -log_likelihood(x, *t) if min(t[1:]) > 0 else math.inf
    hessian = np.empty((4, 4))
    for i in range(4):
        for j in range(i, 4):
            total = 0.0
            for si, sj in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                moved = theta.copy()
                moved[i] += si * step[i]
                moved[j] += sj * step[j]
                total += si * sj * f(moved)
            hessian[i, j] = hessian[j, i] = total / (4 * step[i] * step[j])
    try:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.diag(np.linalg.inv(hessian)))
    except np.linalg.LinAlgError:
        return np.full(4, np.nan)


def fit(returns: np.ndarray) -> dict[str, float | int | bool]:
    """Parameters in return units; likelihood, AIC and BIC in the x100 units they were maximised in."""
    n = len(returns)
    if n < MIN_OBS:
        raise ValueError(f"a GARCH fit needs at least {MIN_OBS} observations, got {n}")
    x = np.asarray(returns, dtype=float) * SCALE
    variance, mean = float(np.var(x, ddof=1)), float(x.mean())
    objective = lambda p: -log_likelihood(x, *_unpack(p))
    logit = lambda v: math.log(v / (1 - v))
    starts = [
        np.array([mean, math.log(variance * (1 - p)), logit(p / _MAX_PERSISTENCE), logit(a)])
        for p in (0.5, 0.8, 0.95, 0.99) for a in (0.05, 0.15, 0.4)
    ]
    start = min(starts, key=objective)
    point, value, _ = _minimise(objective, start, 0.25)
    point, value, converged = _minimise(objective, point, 0.05)
    mu, omega, alpha, beta = _unpack(point)
    errors = _std_errors(x, np.array([mu, omega, alpha, beta]))
    return {
        "omega": omega / SCALE**2, "alpha": alpha, "beta": beta, "mu": mu / SCALE,
        "n_obs": n, "log_likelihood": -value, "aic": 2 * 4 + 2 * value, "bic": 4 * math.log(n) + 2 * value,
        "converged": converged,
        "se_omega": errors[1] / SCALE**2, "se_alpha": errors[2], "se_beta": errors[3], "se_mu": errors[0] / SCALE,
    }
