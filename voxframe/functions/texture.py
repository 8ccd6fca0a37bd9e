"""Texture matrices and their features for one volume, in numpy; run on Arrow batches, one row for each volume.

Grey levels count from 1; voxels outside the mask or outside 1..n take no part. Matrices are sparse: arrays
(i, j, n) of the cells that occur.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict

import numpy as np

#: The 13 directions whose first component other than 0 is +1, and all 26 neighbours.
DIRECTIONS = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
NEIGHBOURS = [d for d in itertools.product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]

Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def views(shape: tuple[int, ...], d: tuple[int, ...]) -> tuple[tuple[slice, ...], tuple[slice, ...]]:
    """Slices of the voxels with a neighbour at d, and of those neighbours."""
    here = tuple(slice(max(0, -k), n - max(0, k)) for n, k in zip(shape, d, strict=True))
    there = tuple(slice(max(0, k), n - max(0, -k)) for n, k in zip(shape, d, strict=True))
    return here, there


def cells(i: np.ndarray, j: np.ndarray) -> Sparse:
    """Counts of pairs."""
    if not len(i):
        z = np.zeros(0, np.int64)
        return z, z, z
    wide = int(j.max()) + 1
    key = i.astype(np.int64) * wide + j
    if i.min() >= 0 and j.min() >= 0 and key.max() < 4 * len(key) + 4096:  # no sort where few places are possible
        every = np.bincount(key)
        key = np.flatnonzero(every)
        return key // wide, key % wide, every[key]
    key, n = np.unique(key, return_counts=True)
    return key // wide, key % wide, n


def glcm(g: np.ndarray, mask: np.ndarray, key: np.ndarray | None = None) -> Sparse:
    """Pairs of neighbours over all directions, both ways. A key stands for the first level where it is given."""
    key = g if key is None else key
    a, b = [], []
    for d in DIRECTIONS:
        x, y = views(g.shape, d)
        both = mask[x] & mask[y]
        a += [key[x][both], key[y][both]]
        b += [g[y][both], g[x][both]]
    return cells(np.concatenate(a), np.concatenate(b))


def glrlm(g: np.ndarray, mask: np.ndarray) -> Sparse:
    """Runs of equal levels over all directions: level, length, count."""
    level, length = [], []
    flat = g.ravel()
    stride = (g.shape[1] * g.shape[2], g.shape[2], 1)
    for d in DIRECTIONS:
        x, y = views(g.shape, d)
        goes_on = np.zeros(g.shape, bool)  # the next voxel continues this one's run
        goes_on[x] = mask[x] & mask[y] & (g[x] == g[y])
        came = np.zeros(g.shape, bool)
        came[y] = goes_on[x]
        at = np.flatnonzero(mask & ~came)
        size = np.ones(len(at), np.int64)
        on, step = goes_on.ravel(), sum(k * t for k, t in zip(d, stride, strict=True))
        live = np.flatnonzero(on[at])
        place = at[live]
        while len(live):
            place = place + step
            size[live] += 1
            more = on[place]
            live, place = live[more], place[more]
        level.append(flat[at])
        length.append(size)
    return cells(np.concatenate(level), np.concatenate(length))


def label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least vertex of the component of each vertex 0..n-1 under edges (a, b): hooking and pointer jumping on whole arrays."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def zones(g: np.ndarray, mask: np.ndarray, directions: list[tuple[int, ...]] = DIRECTIONS) -> np.ndarray:
    """Label of the connected zone of equal level, -1 outside the mask: the least flat index of the zone."""
    index = np.arange(g.size).reshape(g.shape)
    a, b = [], []
    for d in directions:
        x, y = views(g.shape, d)
        same = mask[x] & mask[y] & (g[x] == g[y])
        a.append(index[x][same])
        b.append(index[y][same])
    root = label(g.size, np.concatenate(a), np.concatenate(b)).reshape(g.shape)
    return np.where(mask, root, -1)


def taxicab(mask: np.ndarray) -> np.ndarray:
    """City-block distance to the nearest voxel outside the mask; outside of the volume counts as such."""
    far = int(sum(mask.shape)) + 2
    out = np.where(np.pad(mask, 1), far, 0)
    for axis in range(3):
        v = np.moveaxis(out, axis, 0)
        for k in range(1, v.shape[0]):
            np.minimum(v[k], v[k - 1] + 1, out=v[k])
        for k in range(v.shape[0] - 2, -1, -1):
            np.minimum(v[k], v[k + 1] + 1, out=v[k])
    return out[1:-1, 1:-1, 1:-1]


def glszm_gldzm(g: np.ndarray, mask: np.ndarray, distance_mask: np.ndarray) -> tuple[Sparse, Sparse]:
    zone = zones(g, mask)[mask]
    ids, first, which, size = np.unique(zone, return_index=True, return_inverse=True, return_counts=True)
    level = g[mask][first]
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, which, taxicab(distance_mask)[mask])
    inside = least > 0
    return cells(level, size), cells(level[inside], least[inside])


def neighbourhood(g: np.ndarray, mask: np.ndarray, alpha: float = 0, key: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], Sparse]:
    """NGTDM as (level, n, s) and NGLDM as (level, dependence, count); the dependence counts the voxel itself.

    A key stands for the level in both where it is given.
    """
    total, count, like = (np.zeros(g.shape, np.int64) for _ in range(3))
    for d in NEIGHBOURS:
        x, y = views(g.shape, d)
        total[x] += np.where(mask[y], g[y], 0)
        count[x] += mask[y]
        like[x] += mask[y] & (np.abs(g[y] - g[x]) <= alpha)
    level = g[mask]
    n, t = count[mask], total[mask]
    some = n > 0
    own = level if key is None else key[mask]
    ids, which = np.unique(own[some], return_inverse=True)
    s = np.bincount(which, np.abs(level[some] - t[some] / n[some]), len(ids))
    return (ids, np.bincount(which, minlength=len(ids)), s), cells(own, like[mask] + 1)


# --- features of matrices -------------------------------------------------------------------------------------


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def _by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, which = np.unique(key, return_inverse=True)
    return ids, np.bincount(which, n, len(ids))


def glcm_features(m: Sparse, levels: int) -> dict[str, float]:
    """levels: greatest less least level in the region, and one."""
    i, j, n = m
    if not len(n):
        return {}
    p = n / n.sum()
    i, j = i.astype(float), j.astype(float)
    diff, plus = np.abs(i - j), i + j
    mu = float((i * p).sum())
    var = float(((i - mu) ** 2 * p).sum())
    kd, pd_ = _by(diff, p)
    ks, ps = _by(plus, p)
    li, px = _by(i, p)
    mu_d, mu_s = float((kd * pd_).sum()), float((ks * ps).sum())
    row = dict(zip(li.tolist(), px.tolist(), strict=True))
    pij = np.array([row[a] * row[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    hxy, hx = _entropy(p), _entropy(px)
    hxy1 = float(-(p * np.log2(pij)).sum())
    hxy2 = float(-(np.outer(px, px) * np.log2(np.outer(px, px))).sum())
    apart = diff > 0
    out = {
        "joint_maximum_GYBY": p.max(), "joint_average_60VM": mu, "joint_variance_UR99": var, "joint_entropy_TU9B": hxy,
        "difference_average_TF7R": mu_d, "difference_variance_D3YU": ((kd - mu_d) ** 2 * pd_).sum(), "difference_entropy_NTRS": _entropy(pd_),
        "sum_average_ZGXS": mu_s, "sum_variance_OEEB": ((ks - mu_s) ** 2 * ps).sum(), "sum_entropy_P6QZ": _entropy(ps),
        "angular_second_moment_8ZQL": (p**2).sum(), "contrast_ACUI": (diff**2 * p).sum(), "dissimilarity_8S9J": (diff * p).sum(),
        "inverse_difference_IB1Z": (p / (1 + diff)).sum(), "normalised_inverse_difference_NDRX": (p / (1 + diff / levels)).sum(),
        "inverse_difference_moment_WF0Z": (p / (1 + diff**2)).sum(), "normalised_inverse_difference_moment_1QCO": (p / (1 + diff**2 / levels**2)).sum(),
        "inverse_variance_E8JP": (p[apart] / diff[apart] ** 2).sum(),
        "correlation_NI2N": ((i - mu) * (j - mu) * p).sum() / var if var > 0 else 1.0,
        "autocorrelation_QWB0": (i * j * p).sum(), "cluster_tendency_DG8W": ((plus - 2 * mu) ** 2 * p).sum(),
        "cluster_shade_7NFM": ((plus - 2 * mu) ** 3 * p).sum(), "cluster_prominence_AE86": ((plus - 2 * mu) ** 4 * p).sum(),
        "information_correlation_1_R8DG": (hxy - hxy1) / hx if hx > 0 else np.nan,
        "information_correlation_2_JN9H": _second(hxy2 - hxy),
    }
    return {k: float(v) for k, v in out.items()}


def _second(gap: float) -> float:
    inside = 1 - np.exp(-2 * gap)
    if -1e-12 < inside < 0:
        inside = 0.0
    return float(np.sqrt(inside)) if inside >= 0 else float("nan")


def emphases(m: Sparse, voxels: float) -> dict[str, float]:
    """The shared statistics of run, zone, distance and dependence matrices, by short names."""
    i, j, n = m
    if not len(n):
        return {}
    total = float(n.sum())
    i, j, p = i.astype(float), j.astype(float), n / total
    _, si = _by(i, n)
    _, sj = _by(j, n)
    mi, mj = (i * p).sum(), (j * p).sum()
    out = {
        "short": (p / j**2).sum(), "long": (p * j**2).sum(), "gln": (si**2).sum() / total, "glnn": (si**2).sum() / total**2,
        "sn": (sj**2).sum() / total, "snn": (sj**2).sum() / total**2, "share": total / voxels if voxels else np.nan,
        "glv": ((i - mi) ** 2 * p).sum(), "sv": ((j - mj) ** 2 * p).sum(), "entropy": _entropy(p), "energy": (p**2).sum(),
        "low": (p / i**2).sum(), "high": (p * i**2).sum(), "short_low": (p / (i**2 * j**2)).sum(), "short_high": (p * i**2 / j**2).sum(),
        "long_low": (p * j**2 / i**2).sum(), "long_high": (p * i**2 * j**2).sum(),
    }
    return {k: float(v) for k, v in out.items()}


# Published names of those statistics in each family.
NAMES = {
    "glrlm": {
        "short": "short_runs_emphasis_22OV", "long": "long_runs_emphasis_W4KF", "gln": "grey_level_non_uniformity_R5YN", "glnn": "normalised_grey_level_non_uniformity_OVBL",
        "sn": "run_length_non_uniformity_W92Y", "snn": "normalised_run_length_non_uniformity_IC23", "share": "run_percentage_9ZK5", "glv": "grey_level_variance_8CE5",
        "sv": "run_length_variance_SXLW", "entropy": "run_entropy_HJ9O", "low": "low_grey_level_run_emphasis_V3SW", "high": "high_grey_level_run_emphasis_G3QZ",
        "short_low": "short_run_low_grey_level_emphasis_HTZT", "short_high": "short_run_high_grey_level_emphasis_GD3A",
        "long_low": "long_run_low_grey_level_emphasis_IVPO", "long_high": "long_run_high_grey_level_emphasis_3KUM",
    },
    "glszm": {
        "short": "small_zone_emphasis_P001", "long": "large_zone_emphasis_48P8", "gln": "grey_level_non_uniformity_JNSA", "glnn": "normalised_grey_level_non_uniformity_Y1RO",
        "sn": "zone_size_non_uniformity_4JP3", "snn": "normalised_zone_size_non_uniformity_VB3A", "share": "zone_percentage_P30P", "glv": "grey_level_variance_BYLV",
        "sv": "zone_size_variance_3NSA", "entropy": "zone_size_entropy_GU8N", "low": "low_grey_level_zone_emphasis_XMSY", "high": "high_grey_level_zone_emphasis_5GN9",
        "short_low": "small_zone_low_grey_level_emphasis_5RAI", "short_high": "small_zone_high_grey_level_emphasis_HW1V",
        "long_low": "large_zone_low_grey_level_emphasis_YH51", "long_high": "large_zone_high_grey_level_emphasis_J17V",
    },
    "gldzm": {
        "short": "small_distance_emphasis_0GBI", "long": "large_distance_emphasis_MB4I", "gln": "grey_level_non_uniformity_VFT7", "glnn": "normalised_grey_level_non_uniformity_7HP3",
        "sn": "zone_distance_non_uniformity_V294", "snn": "normalised_zone_distance_non_uniformity_IATH", "share": "zone_percentage_VIWW", "glv": "grey_level_variance_QK93",
        "sv": "zone_distance_variance_7WT1", "entropy": "zone_distance_entropy_GBDU", "low": "low_grey_level_zone_emphasis_S1RA", "high": "high_grey_level_zone_emphasis_K26C",
        "short_low": "small_distance_low_grey_level_emphasis_RUVG", "short_high": "small_distance_high_grey_level_emphasis_DKNJ",
        "long_low": "large_distance_low_grey_level_emphasis_A7WM", "long_high": "large_distance_high_grey_level_emphasis_KLTH",
    },
    "ngldm": {
        "short": "low_dependence_emphasis_SODN", "long": "high_dependence_emphasis_IMOQ", "low": "low_grey_level_count_emphasis_TL9H", "high": "high_grey_level_count_emphasis_OAE7",
        "short_low": "low_dependence_low_grey_level_emphasis_EQ3F", "short_high": "low_dependence_high_grey_level_emphasis_JA6D",
        "long_low": "high_dependence_low_grey_level_emphasis_NBZI", "long_high": "high_dependence_high_grey_level_emphasis_9QMG",
        "gln": "grey_level_non_uniformity_FP8K", "glnn": "normalised_grey_level_non_uniformity_5SPA", "sn": "dependence_count_non_uniformity_Z87G",
        "snn": "normalised_dependence_count_non_uniformity_OKJI", "share": "dependence_count_percentage_6XV8", "glv": "grey_level_variance_1PFV",
        "sv": "dependence_count_variance_DNX2", "entropy": "dependence_count_entropy_FCBV", "energy": "dependence_count_energy_CAS9",
    },
}


def named(family: str, m: Sparse, voxels: float) -> dict[str, float]:
    got = emphases(m, voxels)
    return {name: got[k] for k, name in NAMES[family].items()} if got else {}


def ngtdm_features(m: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, float]:
    i, n, s = m
    if not n.sum():
        return {}
    total = float(n.sum())
    p = n / total
    i = i.astype(float)
    ps, sum_s = float((p * s).sum()), float(s.sum())
    pi, pj = p[:, None], p[None]
    ii, ij = i[:, None], i[None]
    gap = np.abs(ii - ij)
    busy = float(np.abs(ii * pi - ij * pj).sum())
    k = len(p)
    return {
        "coarseness_QCDE": 1 / ps if ps > 1e-10 else 1e6,
        "contrast_65HE": float((pi * pj * gap**2).sum()) / (k * (k - 1)) * sum_s / total if k > 1 else 0.0,
        "busyness_NQ30": ps / busy if busy > 1e-10 else 0.0,
        "complexity_HDEZ": float((gap * (pi * s[:, None] + pj * s[None]) / (pi + pj)).sum()) / total,
        "strength_1X9X": float(((pi + pj) * gap**2).sum()) / sum_s if sum_s > 1e-10 else 0.0,
    }


def texture_features(g: np.ndarray, mask: np.ndarray, n_bins: int, distance_mask: np.ndarray | None = None, families: tuple[str, ...] = ("glcm", "glrlm", "glszm", "gldzm", "ngtdm", "ngldm"), alpha: float = 0) -> dict[str, float]:
    """All asked families of one volume; mask and distance_mask are boolean."""
    box = np.argwhere(mask | (distance_mask if distance_mask is not None else mask))
    if not len(box):
        return {}
    cut = tuple(slice(a, b + 1) for a, b in zip(box.min(0), box.max(0), strict=True))
    own = mask[cut]
    far = distance_mask[cut] if distance_mask is not None else own
    g = g[cut].astype(np.int64)
    voxels = float(own.sum())
    inside = own & (g >= 1) & (g <= n_bins)
    if not inside.any():
        return {}
    out: dict[str, float] = {}
    if "glcm" in families:
        out |= glcm_features(glcm(g, inside), int(g[inside].max() - g[inside].min()) + 1)
    if "glrlm" in families:
        out |= named("glrlm", glrlm(g, inside), 13 * voxels)
    if "glszm" in families or "gldzm" in families:
        size, distance = glszm_gldzm(g, inside, far)
        out |= named("glszm", size, voxels) if "glszm" in families else {}
        out |= named("gldzm", distance, voxels) if "gldzm" in families else {}
    if "ngtdm" in families or "ngldm" in families:
        tone, dependence = neighbourhood(g, inside, alpha)
        out |= ngtdm_features(tone) if "ngtdm" in families else {}
        out |= named("ngldm", dependence, voxels) if "ngldm" in families else {}
    return out


# --- many volumes ---------------------------------------------------------------------------------------------

#: Results of small volumes that were met before are looked up: at most so many voxels, and at most so many results.
KNOWN_VOXELS, KNOWN_TEXTURES = 4096, 256
_known: OrderedDict[tuple, dict[str, float]] = OrderedDict()


def _shares(key: np.ndarray, of: np.ndarray, n: np.ndarray, volumes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each volume, the volume that each is of, and their sums of n."""
    wide = int(key.max()) + 1
    ids, which = np.unique(of * wide + key, return_inverse=True)
    return ids % wide, ids // wide, np.bincount(which, n, len(ids))


def many_glcm_features(m: Sparse, of: np.ndarray, volumes: int, levels: np.ndarray) -> list[dict[str, float]]:
    """glcm_features of the cells of many volumes, `of` which each is."""
    i, j, n = m
    if not len(n):
        return [{} for _ in range(volumes)]
    add = lambda x, o=of: np.bincount(o, x, volumes)
    total = add(n)
    p = n / total[of]
    diff, plus = np.abs(i - j), i + j
    kd, od, pd_ = _shares(diff, of, p, volumes)
    ks, os, ps = _shares(plus, of, p, volumes)
    li, oi, px = _shares(i, of, p, volumes)
    i, j, diff, plus, wide = i.astype(float), j.astype(float), diff.astype(float), plus.astype(float), levels[of].astype(float)
    mu = add(i * p)
    far_i, far_j, away = i - mu[of], j - mu[of], plus - 2 * mu[of]
    var = add(far_i**2 * p)
    mu_d, mu_s = add(kd * pd_, od), add(ks * ps, os)
    width = int(li.max()) + 1
    share = lambda level: px[np.searchsorted(oi * width + li, of * width + level.astype(np.int64))]
    pij = share(i) * share(j)
    ends = np.searchsorted(oi, np.arange(volumes + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        hxy, hx = -add(p * np.log2(p)), -add(px * np.log2(px), oi)
        hxy1 = -add(p * np.log2(pij))
        hxy2 = np.array([_entropy(np.outer(px[a:b], px[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)])
        apart = diff > 0
        most = np.zeros(volumes)
        np.maximum.at(most, of, p)
        out = {
            "joint_maximum_GYBY": most, "joint_average_60VM": mu, "joint_variance_UR99": var, "joint_entropy_TU9B": hxy,
            "difference_average_TF7R": mu_d, "difference_variance_D3YU": add((kd - mu_d[od]) ** 2 * pd_, od), "difference_entropy_NTRS": -add(pd_ * np.log2(pd_), od),
            "sum_average_ZGXS": mu_s, "sum_variance_OEEB": add((ks - mu_s[os]) ** 2 * ps, os), "sum_entropy_P6QZ": -add(ps * np.log2(ps), os),
            "angular_second_moment_8ZQL": add(p**2), "contrast_ACUI": add(diff**2 * p), "dissimilarity_8S9J": add(diff * p),
            "inverse_difference_IB1Z": add(p / (1 + diff)), "normalised_inverse_difference_NDRX": add(p / (1 + diff / wide)),
            "inverse_difference_moment_WF0Z": add(p / (1 + diff**2)), "normalised_inverse_difference_moment_1QCO": add(p / (1 + diff**2 / wide**2)),
            "inverse_variance_E8JP": add(p[apart] / diff[apart] ** 2, of[apart]),
            "correlation_NI2N": np.where(var > 0, add(far_i * far_j * p) / var, 1.0),
            "autocorrelation_QWB0": add(i * j * p), "cluster_tendency_DG8W": add(away**2 * p),
            "cluster_shade_7NFM": add(away**3 * p), "cluster_prominence_AE86": add(away**4 * p),
            "information_correlation_1_R8DG": np.where(hx > 0, (hxy - hxy1) / hx, np.nan),
            "information_correlation_2_JN9H": np.array([_second(x) for x in hxy2 - hxy]),
        }
    return _rows(out, total)


def _rows(columns: dict[str, np.ndarray], total: np.ndarray) -> list[dict[str, float]]:
    """A table of columns as one for each volume; {} where the volume has no cells."""
    names, values = list(columns), np.stack(list(columns.values()), 1).tolist()
    return [dict(zip(names, v, strict=True)) if t else {} for v, t in zip(values, total.tolist(), strict=True)]


def many_named(family: str, m: Sparse, of: np.ndarray, volumes: int, voxels: np.ndarray) -> list[dict[str, float]]:
    """named of the cells of many volumes, `of` which each is."""
    i, j, n = m
    if not len(n):
        return [{} for _ in range(volumes)]
    add = lambda x, o=of: np.bincount(o, x, volumes)
    total = add(n)
    _, oi, si = _shares(i, of, n, volumes)
    _, oj, sj = _shares(j, of, n, volumes)
    i, j, p = i.astype(float), j.astype(float), n / total[of]
    i2, j2, own, none = i**2, j**2, np.where(total > 0, total, 1.0), total == 0
    mi, mj = add(i * p), add(j * p)
    gln, sn = add(si**2, oi), add(sj**2, oj)
    got = {
        "short": add(p / j2), "long": add(p * j2), "gln": gln / own, "glnn": gln / own**2,
        "sn": sn / own, "snn": sn / own**2, "share": np.where(none, np.nan, total / voxels),
        "glv": add((i - mi[of]) ** 2 * p), "sv": add((j - mj[of]) ** 2 * p), "entropy": -add(p * np.log2(p)), "energy": add(p**2),
        "low": add(p / i2), "high": add(p * i2), "short_low": add(p / (i2 * j2)), "short_high": add(p * i2 / j2),
        "long_low": add(p * j2 / i2), "long_high": add(p * i2 * j2),
    }
    return _rows({name: got[k] for k, name in NAMES[family].items()}, total)


def many_features(volumes: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]], families: tuple[str, ...], alpha: float = 0) -> list[dict[str, float]]:
    """texture_features of many volumes (g, mask, n_bins, distance_mask): equal small ones are worked on once, the others

    lie along the first axis of one, with an empty plane between them, and their levels are told apart by volume.
    """

    def key_of(k: int) -> tuple:
        g, mask, n, far = volumes[k]
        return (families, alpha, n, g.shape, g.dtype.str, g.tobytes(), np.packbits(mask).tobytes(), np.packbits(far).tobytes()) if g.size <= KNOWN_VOXELS else (k,)

    keys = [key_of(k) for k in range(len(volumes))]
    out = {k: _known[k] for k in keys if k in _known}
    groups: dict[tuple, list] = {}
    for key, (g, mask, n, far) in zip(keys, volumes, strict=True):
        if key in out:
            continue
        out[key] = {}
        box = np.argwhere(mask | far)
        if len(box):
            cut = tuple(slice(a, b + 1) for a, b in zip(box.min(0), box.max(0), strict=True))
            g = g[cut].astype(np.int64)
            inside = mask[cut] & (g >= 1) & (g <= n)
            if inside.any():
                groups.setdefault(g.shape[1:], []).append((key, g, inside, far[cut], float(mask[cut].sum())))
    for plane, own in groups.items():
        first = np.concatenate([[0], np.cumsum([len(g) + 1 for _, g, *_ in own])])
        g, inside, far = np.zeros((first[-1], *plane), np.int64), np.zeros((first[-1], *plane), bool), np.zeros((first[-1], *plane), bool)
        for at, (_, x, m, f, _) in zip(first.tolist(), own, strict=False):
            g[at : at + len(x)], inside[at : at + len(x)], far[at : at + len(x)] = x, m, f
        n, voxels = len(own), np.array([v for *_, v in own])
        g[~inside] = 0
        wide = int(g.max()) + 1
        key = g + (np.repeat(np.arange(n), np.diff(first)) * wide)[:, None, None]
        got: list[dict[str, float]] = [{} for _ in own]

        def add(each: list[dict[str, float]], got: list[dict[str, float]] = got) -> None:
            for a, b in zip(got, each, strict=True):
                a |= b

        part = lambda m, wide=wide: ((m[0] % wide, *m[1:]), m[0] // wide)
        if "glcm" in families:
            levels = np.array([int(x[m].max() - x[m].min()) + 1 for _, x, m, *_ in own])
            cell, of = part(glcm(g, inside, key))
            add(many_glcm_features(cell, of, n, levels))
        if "glrlm" in families:
            add(many_named("glrlm", *part(glrlm(key, inside)), n, 13 * voxels))
        if "glszm" in families or "gldzm" in families:
            for family, m in zip(("glszm", "gldzm"), glszm_gldzm(key, inside, far), strict=True):
                if family in families:
                    add(many_named(family, *part(m), n, voxels))
        if "ngtdm" in families or "ngldm" in families:
            tone, dependence = neighbourhood(g, inside, alpha, key)
            if "ngtdm" in families:
                (i, many, s), of = part(tone)
                ends = np.searchsorted(of, np.arange(n + 1))
                add([ngtdm_features((i[a:b], many[a:b], s[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            if "ngldm" in families:
                add(many_named("ngldm", *part(dependence), n, voxels))
        for (k, *_), x in zip(own, got, strict=True):
            out[k] = x
    for k in dict.fromkeys(keys):
        if len(k) > 1:
            _known[k] = out[k]
            _known.move_to_end(k)
    while len(_known) > KNOWN_TEXTURES:
        _known.popitem(last=False)
    return [out[k] for k in keys]
