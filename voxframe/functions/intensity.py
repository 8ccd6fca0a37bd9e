"""First-order, histogram, volume-histogram, spatial and local features of one region, in numpy."""

from __future__ import annotations

import numpy as np

RADIUS_MM = 6.2035

# Published names, raw values and bins.
INTENSITY = {
    "mean": "mean_intensity_Q4LE", "var": "intensity_variance_ECT3", "skew": "intensity_skewness_KE2A", "kurt": "intensity_kurtosis_IPH6", "median": "median_intensity_Y12H",
    "min": "minimum_intensity_1GSF", "p10": "10th_intensity_percentile_QG58", "p90": "90th_intensity_percentile_8DWT", "max": "maximum_intensity_84IY",
    "iqr": "intensity_interquartile_range_SALO", "range": "intensity_range_2OJQ", "mad": "intensity_mean_absolute_deviation_4FUA",
    "rmad": "intensity_robust_mean_absolute_deviation_1128", "medad": "intensity_median_absolute_deviation_N72L", "cov": "intensity_coefficient_of_variation_7TET",
    "qcod": "intensity_quartile_coefficient_of_dispersion_9S40", "energy": "intensity_energy_N8CA", "rms": "root_mean_square_intensity_5ZWQ",
}
HISTOGRAM = {
    "mean": "mean_discretised_intensity_X6K6", "var": "discretised_intensity_variance_CH89", "skew": "discretised_intensity_skewness_88K1", "kurt": "discretised_intensity_kurtosis_C3I7",
    "median": "median_discretised_intensity_WIFQ", "min": "minimum_discretised_intensity_1PR8", "p10": "10th_discretised_intensity_percentile_1PR",
    "p90": "90th_discretised_intensity_percentile_GPMT", "max": "maximum_discretised_intensity_3NCY", "mode": "intensity_histogram_mode_AMMC",
    "iqr": "discretised_intensity_interquartile_range_WR0O", "range": "discretised_intensity_range_5Z3W", "mad": "intensity_histogram_mean_absolute_deviation_D2ZX",
    "rmad": "intensity_histogram_robust_mean_absolute_deviation_WRZB", "medad": "intensity_histogram_median_absolute_deviation_4RNL",
    "cov": "intensity_histogram_coefficient_of_variation_CWYJ", "qcod": "intensity_histogram_quartile_coefficient_of_dispersion_SLWD",
    "entropy": "discretised_intensity_entropy_TLU2", "uniformity": "discretised_intensity_uniformity_BJ5W", "max_grad": "maximum_histogram_gradient_12CE",
    "max_grad_at": "maximum_histogram_gradient_intensity_8E6O", "min_grad": "minimum_histogram_gradient_VQB3", "min_grad_at": "minimum_histogram_gradient_intensity_RHQZ",
}
IVH = {
    "v10": "volume_at_intensity_fraction_0.10_BC2M_10", "v90": "volume_at_intensity_fraction_0.90_BC2M_90",
    "vdiff": "volume_fraction_difference_between_intensity_0.10_and_0.90_fractions_DDTU", "i10": "intensity_at_volume_fraction_0.10_GBPN_10",
    "i90": "intensity_at_volume_fraction_0.90_GBPN_90", "idiff": "intensity_fraction_difference_between_volume_0.10_and_0.90_fractions_CNV2", "auc": "area_under_the_ivh_curve_9CMM",
}


def statistics(x: np.ndarray) -> dict[str, float]:
    """The moments and order statistics that raw values and bins share; {} for no values."""
    x = np.asarray(x, float)
    if not len(x):
        return {}
    mean, dev = x.mean(), x - x.mean()
    m2, m3, m4 = (float((dev**k).mean()) for k in (2, 3, 4))
    p10, p25, med, p75, p90 = np.percentile(x, [10, 25, 50, 75, 90])
    mid = x[(x >= p10) & (x <= p90)]
    nan = float("nan")
    out = {
        "mean": mean, "var": m2, "skew": m3 / m2**1.5 if m2 > 0 else nan, "kurt": m4 / m2**2 - 3 if m2 > 0 else nan, "median": med, "min": x.min(), "p10": p10, "p90": p90,
        "max": x.max(), "iqr": p75 - p25, "range": x.max() - x.min(), "mad": np.abs(dev).mean(), "rmad": np.abs(mid - mid.mean()).mean() if len(mid) else 0.0,
        "medad": np.abs(x - med).mean(), "cov": np.sqrt(m2) / mean if mean else nan, "qcod": (p75 - p25) / (p75 + p25) if p75 + p25 else nan,
        "energy": (x**2).sum(), "rms": np.sqrt((x**2).mean()),
    }
    return {k: float(v) for k, v in out.items()}


def intensity_features(x: np.ndarray) -> dict[str, float]:
    got = statistics(x)
    return {name: got[k] for k, name in INTENSITY.items()} if got else {}


def histogram_features(g: np.ndarray) -> dict[str, float]:
    got = statistics(g)
    if not got:
        return {}
    g = np.asarray(g, np.int64)
    low = int(g.min())
    count = np.bincount(g - low)
    p = count[count > 0] / len(g)
    got |= {"mode": float(low + int(count.argmax())), "entropy": float(-(p * np.log2(p)).sum()), "uniformity": float((p**2).sum())}
    got |= dict.fromkeys(("max_grad", "max_grad_at", "min_grad", "min_grad_at"), float("nan"))
    if len(count) > 1:
        slope = np.gradient(count.astype(float))
        got |= {"max_grad": float(slope.max()), "max_grad_at": float(low + slope.argmax()), "min_grad": float(slope.min()), "min_grad_at": float(low + slope.argmin())}
    return {name: got[k] for k, name in HISTOGRAM.items()}


def ivh_features(x: np.ndarray, bin_width: float | None = None, min_val: float | None = None, max_val: float | None = None, target_min: float | None = None, target_max: float | None = None) -> dict[str, float]:
    """Volume histogram. x holds bins if bin_width is given (with min_val: bins of that origin, reported at their centres)."""
    x = np.sort(np.asarray(x))
    n = len(x)
    if not n:
        return {}
    physical = bin_width is not None and min_val is not None
    share = lambda t: (n - int(np.searchsorted(x, t, "left"))) / n
    lo = target_min if target_min is not None else min_val
    hi = target_max if target_max is not None else max_val
    if lo is None or hi is None:
        lo, hi, in_bins = float(x[0]), float(x[-1]), True
    else:
        in_bins = False

    def volume(f: float) -> float:
        t = lo + f * (hi - lo)
        return share(np.floor((t - min_val) / bin_width) + 1 if physical and not in_bins else t)

    def intensity(f: float) -> float:
        target = int(np.floor(f * n))
        if bin_width is not None and bin_width > 0:
            first = min_val if min_val is not None else float(x[0])
            last = max_val if max_val is not None else (min_val + float(x[-1]) * bin_width if min_val is not None else float(x[-1]))
            steps = int(np.round((last - first) / bin_width))
            at = first + (np.arange(steps) + 0.5) * bin_width if physical else first + np.arange(steps + 1) * bin_width
        else:
            at = x.astype(float)
        as_bins = np.floor((at - min_val) / bin_width) + 1 if physical else at
        ok = (n - np.searchsorted(x, as_bins, "left")) <= target
        return float(at[ok.argmax()] if ok.any() else at[-1]) if len(at) else float("nan")

    values, count = np.unique(x, return_counts=True)
    held = (n - np.concatenate([[0], np.cumsum(count)[:-1]])) / n
    where = min_val + (values - 0.5) * bin_width if physical else values.astype(float)
    auc = float((np.diff(where) * (held[1:] + held[:-1]) / 2).sum()) if len(values) > 1 else 0.0
    got = {"v10": volume(0.1), "v90": volume(0.9), "i10": intensity(0.1), "i90": intensity(0.9), "auc": auc}
    got |= {"vdiff": got["v10"] - got["v90"], "idiff": got["i10"] - got["i90"]}
    return {name: float(got[k]) for k, name in IVH.items()}


def spatial_features(image: np.ndarray, mask: np.ndarray, spacing: tuple[float, float, float]) -> dict[str, float]:
    """Moran's I and Geary's C with weights 1 / distance in mm.

    The weight of a pair depends on its offset alone, so sums over all pairs are sums over offsets of the weight times
    a correlation of the region with itself, which two transforms give: n log n for n voxels, not n squared.
    """
    out = {"morans_i_index_N365": float("nan"), "gearys_c_measure_NPT7": float("nan")}
    own = np.argwhere(mask)
    if len(own) < 2:
        return out
    box = tuple(slice(a, b + 1) for a, b in zip(own.min(0), own.max(0), strict=True))
    inside = mask[box]
    x = image[box].astype(float)
    n, mean = len(own), float(x[inside].mean())
    dev = np.where(inside, x - mean, 0.0)
    denom = float((dev**2).sum())
    if denom == 0:
        return out
    shape = [2 * k for k in inside.shape]
    lag = [np.minimum(np.arange(k), k - np.arange(k)) * s for k, s in zip(shape, spacing, strict=True)]
    far = np.sqrt(sum(g**2 for g in np.meshgrid(*lag, indexing="ij", sparse=True)))
    w = np.divide(1.0, far, out=np.zeros_like(far), where=far > 0)
    at = np.fft.rfftn(w)
    ones, values, squares = (np.fft.rfftn(v, shape, axes=(0, 1, 2)) for v in (inside.astype(float), dev, dev**2))
    # Sums of products in the spectrum; its inner half stands for both.
    twice = np.full(at.shape[2], 2.0)
    twice[0] = twice[-1] = 1.0
    total = lambda a, b: float(((a.conj() * b * at).real * twice).sum()) / w.size
    weight, cross, square = total(ones, ones), total(values, values), total(squares, ones)
    return {"morans_i_index_N365": n / weight * cross / denom, "gearys_c_measure_NPT7": (n - 1) / (2 * weight) * 2 * (square - cross) / denom}


def local_features(image: np.ndarray, mask: np.ndarray, spacing: tuple[float, float, float], radius: float = RADIUS_MM) -> dict[str, float]:
    """Peaks of the mean over a sphere of the whole image around the voxels of the region."""
    if not mask.any():
        return {}
    reach = [min(int(radius // s), n - 1) for s, n in zip(spacing, image.shape, strict=True)]
    own = np.argwhere(mask)
    box = tuple(slice(max(0, a - r), b + r + 1) for a, b, r in zip(own.min(0), own.max(0), reach, strict=True))
    image, mask = image[box].astype(float), mask[box]
    shape = [n + r for n, r in zip(image.shape, reach, strict=True)]
    lag = [np.minimum(np.arange(k), k - np.arange(k)) * s for k, s in zip(shape, spacing, strict=True)]
    near = [np.minimum(np.arange(k), k - np.arange(k)) <= r for k, r in zip(shape, reach, strict=True)]
    ball = sum(g**2 for g in np.meshgrid(*lag, indexing="ij", sparse=True)) <= radius**2
    for a, ok in enumerate(near):
        ball = ball & ok.reshape([-1 if i == a else 1 for i in range(3)])
    at = np.fft.rfftn(ball.astype(float))
    middle = float(image.mean())  # sums of small numbers lose less
    here = tuple(slice(0, n) for n in image.shape)
    total = np.fft.irfftn(np.fft.rfftn(image - middle, shape, axes=(0, 1, 2)) * at, shape, axes=(0, 1, 2))[here]
    count = np.rint(np.fft.irfftn(np.fft.rfftn(np.ones(image.shape), shape, axes=(0, 1, 2)) * at, shape, axes=(0, 1, 2))[here])
    mean = (total / count + middle)[mask]
    inside = image[mask]
    return {"global_intensity_peak_0F91": float(mean.max()), "local_intensity_peak_VJGA": float(mean[inside == inside.max()].max())}
