"""Resampling of one volume on a new grid with the same centre, in numpy: nearest, linear and cubic B-splines."""

from __future__ import annotations

import math

import numpy as np

LEAST_WEIGHT = 0.01


def _prefilter(x: np.ndarray, axis: int) -> np.ndarray:
    """Cubic B-spline coefficients along an axis with mirrored ends: a tridiagonal system, solved by elimination."""
    v = np.moveaxis(x, axis, 0).astype(float)
    n = v.shape[0]
    if n < 2:
        return x.astype(float)
    upper, out = np.zeros(n), np.empty_like(v)
    for i in range(n):  # rows (1, 4, 1) / 6; the ends' missing neighbour is the one inside
        low = 0.0 if i == 0 else (2.0 if i == n - 1 else 1.0)
        high = 2.0 if i == 0 else (0.0 if i == n - 1 else 1.0)
        den = 4.0 - low * (upper[i - 1] if i else 0.0)
        upper[i] = high / den
        out[i] = (6 * v[i] - low * (out[i - 1] if i else 0.0)) / den
    for i in range(n - 2, -1, -1):
        out[i] -= upper[i] * out[i + 1]
    return np.moveaxis(out, 0, axis)


def _weights(n: int, m: int, r: float, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(input index, weight) of each tap for m outputs; places beyond the border are those of the border."""
    x = np.clip(r * np.arange(m) + ((n - 1) / 2 - r * (m - 1) / 2), 0, n - 1)
    if order == 0:
        return [(np.floor(x + 0.5).astype(int).clip(0, n - 1), np.ones(m))]
    lo = np.floor(x).astype(int)
    f = x - lo
    if order == 1:
        return [(lo, 1 - f), ((lo + 1).clip(0, n - 1), f)]
    taps = [(lo - 1, (1 - f) ** 3 / 6), (lo, (4 - 6 * f**2 + 3 * f**3) / 6), (lo + 1, (1 + 3 * f + 3 * f**2 - 3 * f**3) / 6), (lo + 2, f**3 / 6)]
    mirror = lambda i: np.abs((i + (n - 1)) % max(1, 2 * (n - 1)) - (n - 1)) if n > 1 else np.zeros_like(i)
    return [(mirror(i), w) for i, w in taps]


def _pass(x: np.ndarray, shape: list[int], ratio: list[float], order: int) -> np.ndarray:
    for axis in range(3):
        if order == 3:
            x = _prefilter(x, axis)
        v = np.moveaxis(x, axis, 0)
        out = sum(w.reshape(-1, 1, 1) * v[i] for i, w in _weights(v.shape[0], shape[axis], ratio[axis], order))
        x = np.moveaxis(out, 0, axis)
    return x


def resampled(x: np.ndarray, spacing: tuple, new_spacing: tuple, interpolation: str = "linear", valid: np.ndarray | None = None, origin: tuple = (0, 0, 0)) -> tuple[np.ndarray, np.ndarray | None, tuple]:
    """Array, its valid voxels (if there were any marked) and origin on the new grid."""
    order = {"nearest": 0, "linear": 1, "cubic": 3}[interpolation]
    shape = [math.ceil(n * s / t - 1e-9) for n, s, t in zip(x.shape, spacing, new_spacing, strict=True)]
    ratio = [t / s for s, t in zip(spacing, new_spacing, strict=True)]
    at = tuple(o + s * ((n - 1) / 2 - r * (m - 1) / 2) for o, s, n, r, m in zip(origin, spacing, x.shape, ratio, shape, strict=True))
    if valid is None:
        return _pass(x.astype(float), shape, ratio, order), None, at
    weight = _pass(valid.astype(float), shape, ratio, min(order, 1))
    out = _pass(np.where(valid, x, 0.0), shape, ratio, min(order, 1))
    good = weight >= LEAST_WEIGHT
    return np.where(good, out / np.where(good, weight, 1), 0.0), good, at
