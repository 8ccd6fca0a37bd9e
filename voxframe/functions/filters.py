"""Image filters, in numpy: separable stencils and Fourier kernels.

The last three axes are those of the volume; equal shapes may be stacked before them.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np

#: Names of boundary conditions; `mirror` repeats the border voxel.
BOUNDARIES = {"zero": "constant", "constant": "constant", "nearest": "edge", "periodic": "wrap", "wrap": "wrap", "mirror": "symmetric", "reflect": "symmetric"}

# Integer kernels, scaled to unit length below; low-pass taps of wavelets.
LAWS = {
    "L3": (1, 2, 1), "L5": (1, 4, 6, 4, 1), "E3": (-1, 0, 1), "E5": (-1, -2, 0, 2, 1), "S3": (-1, 2, -1), "S5": (-1, 0, 2, 0, -1), "W5": (-1, 2, 0, -2, 1), "R5": (1, -4, 6, -4, 1),
}
LOW_PASS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db1": (0.7071067811865476, 0.7071067811865476),
    "db2": (-0.12940952255092145, 0.22414386804185735, 0.836516303737469, 0.48296291314469025),
    "db3": (0.035226291882100656, -0.08544127388224149, -0.13501102001039084, 0.4598775021193313, 0.8068915093133388, 0.3326705529509569),
    "coif1": (-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539),
}
#: A normalised response counts where at least this share of the weights fell on valid voxels.
LEAST_WEIGHT = 0.01


def convolve1d(x: np.ndarray, kernel: np.ndarray, axis: int, boundary: str = "zero") -> np.ndarray:
    """True convolution along one of the last three axes; the middle (of even kernels: the later one) is the origin."""
    k = len(kernel)
    left = k // 2
    axis += x.ndim - 3
    pad = [(0, 0)] * x.ndim
    pad[axis] = (k - 1 - left, left) if k % 2 == 0 else (left, left)
    wide = np.moveaxis(np.pad(x, pad, BOUNDARIES[boundary]), axis, 0)
    n = x.shape[axis]
    out = sum(w * wide[i : i + n] for i, w in enumerate(kernel[::-1]) if w)
    return np.moveaxis(out if not isinstance(out, int) else np.zeros_like(wide[:n]), 0, axis)


def separable(x: np.ndarray, kernels: list[np.ndarray], boundary: str, valid: np.ndarray | None = None) -> np.ndarray:
    """Three passes; with a mask of valid voxels, normalised by the weights that fell on them."""
    if valid is not None:
        weight = separable(valid.astype(float), [np.abs(k) for k in kernels], boundary) / math.prod(float(np.abs(k).sum()) for k in kernels)
        raw = separable(np.where(valid, x, 0.0), kernels, boundary)
        return np.where(weight >= LEAST_WEIGHT, raw / np.maximum(weight, LEAST_WEIGHT), 0.0)
    for axis, k in enumerate(kernels):
        x = convolve1d(x, np.asarray(k, float), axis, boundary)
    return x


def mean_filter(x: np.ndarray, support: int = 15, boundary: str = "zero", valid: np.ndarray | None = None) -> np.ndarray:
    if support < 1 or support % 2 == 0:
        raise ValueError("support must be odd and positive")
    k = np.full(support, 1 / support)
    return separable(x.astype(float), [k] * 3, boundary, valid)


def laplacian_of_gaussian(x: np.ndarray, sigma_mm: float, spacing: tuple[float, ...] = (1, 1, 1), truncate: float = 4.0, boundary: str = "zero", valid: np.ndarray | None = None) -> np.ndarray:
    smooth, second = [], []
    for s in spacing:
        sigma = sigma_mm / s
        at = np.arange(-int(truncate * sigma + 0.5), int(truncate * sigma + 0.5) + 1)
        g = np.exp(-(at**2) / (2 * sigma**2))
        g /= g.sum()
        smooth.append(g)
        second.append(g * (at**2 / sigma**4 - 1 / sigma**2))
    own = np.where(valid, x, 0.0) if valid is not None else x.astype(float)
    out = sum(separable(own, [second[a] if a == axis else smooth[a] for a in range(3)], boundary) for axis in range(3))
    if valid is not None:
        weight = separable(valid.astype(float), smooth, boundary)
        out = np.where(weight >= LEAST_WEIGHT, out / np.maximum(weight, LEAST_WEIGHT), 0.0)
    return out


def rotations() -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """The 24 right-angle rotations as (axis order, signs) of determinant 1."""
    out = []
    for perm in itertools.permutations(range(3)):
        parity = (-1) ** sum(perm[i] > perm[j] for i in range(3) for j in range(i + 1, 3))
        out += [(perm, signs) for signs in itertools.product((1, -1), repeat=3) if parity * math.prod(signs) == 1]
    return out


def pooled(responses, how: str) -> np.ndarray:  # noqa: ANN001
    """Maximum, average or minimum over responses that come one by one."""
    out, n = None, 0
    for r in responses:
        n += 1
        out = r if out is None else np.maximum(out, r) if how == "max" else np.minimum(out, r) if how == "min" else out + r
    return out / n if how in ("average", "mean") else out


def _turned(kernels: list[np.ndarray]):  # noqa: ANN202
    for perm, signs in rotations():
        yield [kernels[a][:: s] for a, s in zip(perm, signs, strict=True)]


def laws_filter(x: np.ndarray, kernels: str = "L5E5E5", boundary: str = "zero", rotation_invariant: bool = False, pooling: str = "max", compute_energy: bool = False, energy_distance: int = 7, valid: np.ndarray | None = None) -> np.ndarray:
    names = re.findall(r"[LESWR][35]", kernels.upper())
    if len(names) != 3 or "".join(names) != kernels.upper():
        raise ValueError(f"three kernels of {', '.join(LAWS)} are asked for, not {kernels}")
    ks = [np.array(LAWS[n], float) / np.linalg.norm(LAWS[n]) for n in names]
    x = x.astype(float)
    out = pooled((separable(x, k, boundary) for k in _turned(ks)), pooling) if rotation_invariant else separable(x, ks, boundary, valid)
    if compute_energy:
        out = separable(np.abs(out), [np.full(2 * energy_distance + 1, 1 / (2 * energy_distance + 1))] * 3, boundary)
    return out


def wavelet_transform(x: np.ndarray, wavelet: str = "db2", level: int = 1, decomposition: str = "LHL", boundary: str = "zero", rotation_invariant: bool = False, pooling: str = "average", valid: np.ndarray | None = None) -> np.ndarray:
    """Undecimated: kernels of level k have 2 ** (k - 1) - 1 zeros after each tap; lower levels pass low on all axes."""
    if wavelet not in LOW_PASS:
        raise ValueError(f"wavelet must be one of {', '.join(LOW_PASS)}")
    low = np.array(LOW_PASS[wavelet])
    high = low[::-1] * np.array([(-1) ** (k + 1) for k in range(len(low))])
    x = np.where(valid, x, 0.0) if valid is not None else x.astype(float)

    def spread(k: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(len(k) * 2 ** (level - 1))
        out[:: 2 ** (level - 1)] = k
        return out

    def through(order: list[np.ndarray], low_turn: list[np.ndarray]) -> np.ndarray:
        y = x
        for k in range(1, level):
            y = separable(y, [spread(t, k) for t in low_turn], boundary)
        return separable(y, [spread(t, level) for t in order], boundary)

    bands = [low if c == "L" else high for c in decomposition.upper()]
    if not rotation_invariant:
        return through(bands, [low] * 3)
    return pooled((through(a, b) for a, b in zip(_turned(bands), _turned([low] * 3), strict=True)), pooling)


def gabor_filter(x: np.ndarray, sigma_mm: float, lambda_mm: float, gamma: float = 1.0, theta: float = 0.0, spacing: float = 1.0, boundary: str = "zero", rotation_invariant: bool = False, delta_theta: float | None = None, pooling: str = "average", average_over_planes: bool = False, valid: np.ndarray | None = None) -> np.ndarray:
    """Modulus of the complex response in each slice; over angles and planes if asked for."""
    sigma, wave = sigma_mm / spacing, lambda_mm / spacing
    x = np.where(valid, x, 0.0) if valid is not None else x.astype(float)
    r = math.ceil(6 * sigma)
    u, v = np.meshgrid(np.arange(-r, r + 1), np.arange(-r, r + 1), indexing="ij")

    def kernel(t: float) -> np.ndarray:
        a, b = u * math.cos(t) + v * math.sin(t), -u * math.sin(t) + v * math.cos(t)
        return np.exp(-(a**2 + (gamma * b) ** 2) / (2 * sigma**2) + 2j * np.pi * a / wave)

    def responses(y: np.ndarray) -> Iterator[np.ndarray]:
        """The modulus at each angle. What wraps around in the transforms lies before what is kept."""
        wide = np.pad(y, [(0, 0)] * (y.ndim - 3) + [(r, r), (r, r), (0, 0)], BOUNDARIES[boundary])
        own = np.fft.fft2(wide, axes=(-3, -2))
        for t in angles:
            full = np.fft.ifft2(own * np.fft.fft2(kernel(t), wide.shape[-3:-1])[..., None], axes=(-3, -2))
            yield np.abs(full[..., 2 * r :, 2 * r :, :])

    angles = [theta]
    if rotation_invariant and delta_theta:
        angles = [k * delta_theta for k in range(round(2 * np.pi / delta_theta))]
    planes = [(0, 1, 2), (0, 2, 1), (1, 2, 0)] if average_over_planes else [(0, 1, 2)]
    turn = lambda y, p: np.transpose(y, [*range(y.ndim - 3), *(y.ndim - 3 + k for k in p)])
    each = [turn(pooled(responses(turn(x, p)), pooling), np.argsort(p).tolist()) for p in planes]
    return sum(each) / len(each)


def simoncelli_wavelet(x: np.ndarray, level: int = 1, valid: np.ndarray | None = None) -> np.ndarray:
    """Isotropic band of one octave around its peak, in the Fourier domain; periodic."""
    x = np.where(valid, x, 0.0) if valid is not None else x.astype(float)
    axes = [(np.arange(n) - (n - 1) / 2) / ((n - 1) / 2) if n > 1 else np.zeros(1) for n in x.shape[-3:]]
    r = np.sqrt(sum(g**2 for g in np.meshgrid(*axes, indexing="ij")))
    top = 2.0 ** -(level - 1)
    band = (r >= top / 4) & (r <= top)
    with np.errstate(divide="ignore"):
        gain = np.where(band, np.cos(np.pi / 2 * np.log2(np.where(r > 0, 2 * r / top, 1))), 0.0)
    axes = (-3, -2, -1)
    return np.fft.ifftn(np.fft.fftn(x, axes=axes) * np.fft.ifftshift(gain), axes=axes).real


def riesz_orders(most: int, ndim: int = 3) -> list[tuple[int, ...]]:
    return [o for o in itertools.product(range(most + 1), repeat=ndim) if sum(o) == most]


def riesz_transform(x: np.ndarray, order: tuple[int, int, int] = (1, 0, 0), valid: np.ndarray | None = None) -> np.ndarray:
    total = sum(order)
    if total < 1:
        raise ValueError("the order must be at least 1")
    x = np.where(valid, x, 0.0) if valid is not None else x.astype(float)
    grid = np.meshgrid(np.fft.fftfreq(x.shape[-3]), np.fft.fftfreq(x.shape[-2]), np.fft.rfftfreq(x.shape[-1]), indexing="ij")
    norm = np.sqrt(sum(g**2 for g in grid))
    norm[0, 0, 0] = 1.0
    gain = (-1j) ** total * math.sqrt(math.factorial(total) / math.prod(map(math.factorial, order))) * math.prod(g**k for g, k in zip(grid, order, strict=True)) / norm**total
    gain[0, 0, 0] = 0
    axes = (-3, -2, -1)
    return np.fft.irfftn(np.fft.rfftn(x, axes=axes) * gain, x.shape[-3:], axes=axes)


def riesz_log(x: np.ndarray, sigma_mm: float, spacing: tuple[float, ...] = (1, 1, 1), order: tuple[int, int, int] = (1, 0, 0), truncate: float = 4.0, valid: np.ndarray | None = None) -> np.ndarray:
    return riesz_transform(laplacian_of_gaussian(x, sigma_mm, spacing, truncate, "zero", valid), order)


def riesz_simoncelli(x: np.ndarray, level: int = 1, order: tuple[int, int, int] = (1, 0, 0), valid: np.ndarray | None = None) -> np.ndarray:
    return riesz_transform(simoncelli_wavelet(x, level, valid), order)


def apply_filter(x: np.ndarray, spacing: tuple[float, ...], params: dict, valid: np.ndarray | None = None) -> np.ndarray:
    """One filter step by its type; pipelines mirror at the border by default."""
    p = dict(params)
    kind = p.pop("type")
    side = {"boundary": str(p.pop("boundary", "mirror")).lower()}
    if side["boundary"] not in BOUNDARIES:
        side["boundary"] = "mirror"
    if kind == "mean":
        return mean_filter(x, valid=valid, **p, **side)
    if kind == "log":
        return laplacian_of_gaussian(x, spacing=spacing, valid=valid, **p, **side)
    if kind == "laws":
        return laws_filter(x, valid=valid, **({"kernels": p.pop("kernel")} if "kernel" in p else {}), **p, **side)
    if kind == "gabor":
        return gabor_filter(x, spacing=spacing[0], valid=valid, **p, **side)
    if kind == "wavelet":
        return wavelet_transform(x, valid=valid, **p, **side)
    if kind == "simoncelli":
        return simoncelli_wavelet(x, valid=valid, **p)
    if kind == "riesz":
        variant = p.pop("variant", "base")
        p["order"] = tuple(p.get("order", (1, 0, 0)))
        if variant == "log":
            return riesz_log(x, spacing=spacing, valid=valid, **p)
        return (riesz_simoncelli if variant == "simoncelli" else riesz_transform)(x, valid=valid, **p)
    raise ValueError(f"no filter type {kind}")
