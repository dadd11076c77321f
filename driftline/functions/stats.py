"""Small numeric helpers that run on the driver or inside grouped functions."""

from __future__ import annotations

import hashlib
import math

import numpy as np


def stable_seed(master: int, *parts) -> int:
    """A seed from names: the same on every machine."""
    name = ":".join(map(str, (master, *parts)))
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") % (2**32 - 1)


def draws(master: int, label: str, replicates: int, n: int) -> np.ndarray:
    """[replicates, n] indices drawn with replacement, a generator of its own for each replicate."""
    return np.stack([np.random.default_rng(stable_seed(master, label, r)).integers(0, n, size=n) for r in range(replicates)])


def _beta_fraction(a: float, b: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    if not len(x):
        return x
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    x = np.clip(np.atleast_1d(np.asarray(x, float)), 0.0, 1.0)
    front = np.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300))
    )
    # each side of the mean has the fraction that converges fast there
    low = x < (a + 1) / (a + b + 2)
    value = np.empty_like(x)
    value[low] = front[low] * _beta_fraction(a, b, x[low]) / a
    value[~low] = 1 - front[~low] * _beta_fraction(b, a, 1 - x[~low]) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def t_two_sided(t: np.ndarray, dof: float) -> np.ndarray:
    """P(|T| > |t|) of Student's distribution."""
    t = np.asarray(t, float)
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def factor(x: np.ndarray) -> np.ndarray:
    """The triangular factor of [1, columns]: all that least squares needs of the rows, at their own condition."""
    z = np.column_stack([np.ones(len(x)), x])
    out = np.zeros((z.shape[1], z.shape[1]))
    if len(z):
        r = np.linalg.qr(z, mode="r")
        out[: len(r)] = r
    return out


def joined_factor(factors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The factor of all rows behind [n, size, size] factors put together, each as often as its weight says."""
    own = factors[weights > 0] * np.sqrt(weights[weights > 0])[:, None, None]
    return np.linalg.qr(own.reshape(-1, factors.shape[-1]), mode="r") if len(own) else np.zeros(factors.shape[1:])


def standardised_fit(r: np.ndarray, response: int, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and p values of the standardised least squares of column `response` on columns `terms`.

    From the triangular factor alone: its first row holds the means, the rest the centred columns.
    Columns that do not vary get 0 and 1, as do all if rows are too few or the response does not vary;
    collinear columns share by the least norm.
    """
    beta, p = np.zeros(len(terms)), np.ones(len(terms))
    n = round(float(r[0, 0]) ** 2)
    if n <= len(terms) + 2:
        return beta, p
    centred = r[1:, 1:]
    norms = np.sqrt((centred * centred).sum(axis=0))
    sd = norms / np.sqrt(n - 1)
    use = np.flatnonzero(sd[terms] > 1e-12)
    if not sd[response] > 1e-12 or not len(use):
        return beta, p
    own = np.asarray(terms)[use]
    y = centred[:, response] / norms[response]
    u, s, v = np.linalg.svd(centred[:, own] / norms[own], full_matrices=False)
    keep = s > s[0] * np.finfo(float).eps * max(n, len(own))
    u, s, v = u[:, keep], s[keep], v[keep]
    along = u.T @ y
    b = v.T @ (along / s)
    rest = y - u @ along
    error = np.sqrt(((v / s[:, None]) ** 2).sum(axis=0) * (rest @ rest) / max(n - len(s), 1))
    t = np.divide(b, error, out=np.zeros_like(b), where=error > 0)
    beta[use], p[use] = b, np.clip(t_two_sided(t, max(n - len(s), 1)), 0, 1)
    return beta, p
