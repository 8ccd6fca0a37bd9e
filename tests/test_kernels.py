"""Closed forms and properties of the numpy kernels."""

import numpy as np
import pytest

from voxframe.functions import filters, intensity, morphology, texture
from voxframe.functions.spline import resampled
from voxframe.plans import catalogue, run
from voxframe.plans.config import Config, Configs, plan


def test_intensity_values():
    f = intensity.intensity_features(np.array([1, 2, 3, 4, 5]))
    assert (f["mean_intensity_Q4LE"], f["intensity_variance_ECT3"], f["intensity_skewness_KE2A"], f["median_intensity_Y12H"], f["intensity_range_2OJQ"]) == (3, 2, 0, 3, 4)
    flat = intensity.intensity_features(np.array([5, 5, 5]))
    assert flat["intensity_variance_ECT3"] == 0 and np.isnan(flat["intensity_skewness_KE2A"]) and np.isnan(flat["intensity_kurtosis_IPH6"])
    even = intensity.intensity_features(np.array([-1, 1]))
    assert np.isnan(even["intensity_coefficient_of_variation_7TET"]) and np.isnan(even["intensity_quartile_coefficient_of_dispersion_9S40"])
    assert intensity.intensity_features(np.array([])) == {}


def test_histogram_values():
    f = intensity.histogram_features(np.array([1, 1, 2, 2, 2, 3, 4, 5]))
    assert (f["intensity_histogram_mode_AMMC"], f["minimum_discretised_intensity_1PR8"], f["maximum_discretised_intensity_3NCY"], f["discretised_intensity_uniformity_BJ5W"]) == (2, 1, 5, 0.25)
    flat = intensity.histogram_features(np.array([1, 1, 1, 1]))
    assert np.isnan(flat["maximum_histogram_gradient_12CE"]) and flat["intensity_histogram_coefficient_of_variation_CWYJ"] == 0


def test_coarseness_of_a_flat_region():
    assert texture.ngtdm_features((np.array([1, 2]), np.array([10, 10]), np.zeros(2)))["coarseness_QCDE"] == 1e6


def volume(seed=0, n=6, levels=4):
    rng = np.random.default_rng(seed)
    return rng.integers(1, levels + 1, (n, n, n)), rng.random((n, n, n)) > 0.3


@pytest.mark.parametrize("seed", range(4))
def test_matrix_properties(seed):
    g, m = volume(seed)
    pairs = sum(int((m[texture.views(g.shape, d)[0]] & m[texture.views(g.shape, d)[1]]).sum()) for d in texture.DIRECTIONS)
    assert texture.glcm(g, m)[2].sum() == 2 * pairs
    _, j, n = texture.glrlm(g, m)
    assert (j * n).sum() == 13 * m.sum()
    size, distance = texture.glszm_gldzm(g, m, m)
    assert (size[1] * size[2]).sum() == m.sum() and distance[2].sum() == size[2].sum()
    assert texture.neighbourhood(g, m)[1][2].sum() == m.sum()


def test_zones_against_flooding():
    g, m = volume(7)
    seen = np.where(m, -1, -2)
    n = 0
    for start in np.argwhere(m):
        if seen[tuple(start)] != -1:
            continue
        stack = [tuple(start)]
        seen[tuple(start)] = n
        while stack:
            at = stack.pop()
            for d in texture.NEIGHBOURS:
                to = tuple(np.add(at, d))
                if all(0 <= k < 6 for k in to) and seen[to] == -1 and g[to] == g[at]:
                    seen[to] = n
                    stack.append(to)
        n += 1
    zone = texture.zones(g, m)
    assert len(np.unique(zone[m])) == n and len({(a, b) for a, b in zip(zone[m], seen[m], strict=True)}) == n


def test_cube_and_box():
    f = morphology.morphology_features(np.ones((3, 3, 3), np.uint8), (1, 1, 1), image=np.ones((3, 3, 3)))
    # 12 edges of 2 cells lose an eighth each, 8 corners all but a 48th of an eighth
    assert f["volume_voxel_counting_YEKZ"] == 27 and f["volume_RNU0"] == pytest.approx(27 - 24 / 8 - 8 * (1 / 8 - 1 / 48))
    assert f["volume_density_convex_hull_R3ER"] == pytest.approx(1, abs=1e-6) and f["maximum_3d_diameter_L0JK"] == pytest.approx(np.sqrt(9 + 4 + 4), abs=1e-6)
    assert f["elongation_Q3CK"] == pytest.approx(1) and f["center_of_mass_shift_KLMA"] == pytest.approx(0)
    assert set(f) == set(catalogue.MORPHOLOGY)
    box = morphology.morphology_features(np.ones((2, 3, 8), np.uint8), (1, 1, 1))
    assert box["elongation_Q3CK"] < 0.5


def test_sphere():
    x = np.indices((25, 25, 25)) - 12
    f = morphology.morphology_features(((x**2).sum(0) <= 100).astype(np.uint8), (1, 1, 1))
    assert f["volume_RNU0"] == pytest.approx(4 / 3 * np.pi * 1000, rel=0.02) and 0.9 < f["sphericity_QCFX"] < 1
    assert morphology.ellipsoid_area(2, 2, 2) == pytest.approx(16 * np.pi)
    e = np.sqrt(0.75)
    assert morphology.ellipsoid_area(2, 2, 1) == pytest.approx(8 * np.pi + np.pi / e * np.log((1 + e) / (1 - e)))
    # the published series takes both eccentricities against the longest axis, here with P2 and P3 written out
    a2, b2 = 1 - 4 / 9, 1 - 1 / 9
    x, ab = (a2 + b2) / (2 * np.sqrt(a2 * b2)), np.sqrt(a2 * b2)
    few = 1 - ab * x / 3 - ab**2 * (3 * x**2 - 1) / 2 / 15 - ab**3 * (5 * x**3 - 3 * x) / 2 / 35
    assert morphology.ellipsoid_area(3, 2, 1, 3) == pytest.approx(24 * np.pi * few)


def test_closed_surfaces():
    """Every cell code gives as many edges one way as the other over a closed volume."""
    rng = np.random.default_rng(1)
    m = rng.random((5, 5, 5)) > 0.5
    area, size, vertices = morphology.mesh(m, np.ones(3))
    shifted = morphology.mesh(np.pad(m, ((3, 0), (0, 0), (0, 0))), np.ones(3))
    assert area == pytest.approx(shifted[0]) and size == pytest.approx(shifted[1])  # only a closed surface has a volume that doesn't depend on the origin


def impulse():
    x = np.zeros((9, 9, 9))
    x[4, 4, 4] = 1
    return x


def test_filters():
    x = impulse()
    assert filters.mean_filter(x, 3)[3, 3, 3] == pytest.approx(1 / 27)
    assert abs(filters.laplacian_of_gaussian(x, 1.0).sum()) < 1e-3 and filters.laplacian_of_gaussian(x, 1.0)[4, 4, 4] < 0
    assert filters.laws_filter(x, "L5E5S5").sum() == pytest.approx(0, abs=1e-9)
    assert len(filters.rotations()) == 24
    assert filters.wavelet_transform(np.ones((8, 8, 8)), "db2", boundary="periodic", decomposition="LLL").max() == pytest.approx(2**1.5)
    assert np.abs(filters.wavelet_transform(np.ones((8, 8, 8)), "coif1", boundary="mirror")).max() < 1e-9
    assert filters.simoncelli_wavelet(x).sum() == pytest.approx(0, abs=1e-9)
    assert filters.riesz_orders(2) == [(0, 0, 2), (0, 1, 1), (0, 2, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0)]
    energy = sum((filters.riesz_transform(x - x.mean(), o) ** 2).sum() for o in filters.riesz_orders(1))
    assert energy == pytest.approx(((x - x.mean()) ** 2).sum(), rel=0.05)
    with pytest.raises(ValueError):
        filters.mean_filter(x, 4)
    with pytest.raises(ValueError):
        filters.riesz_transform(x, (0, 0, 0))


def test_valid_voxels_only():
    x = np.full((7, 7, 7), 5.0)
    valid = np.ones(x.shape, bool)
    valid[0] = False
    x[0] = -1000
    assert filters.mean_filter(x, 3, "zero", valid)[1:].round(9).min() == 5


@pytest.mark.parametrize("how", ["nearest", "linear", "cubic"])
def test_resampling(how):
    ramp = np.indices((8, 8, 8)).sum(0).astype(float)
    same = resampled(ramp, (1, 1, 1), (1, 1, 1), how)[0]
    assert np.allclose(same, ramp)
    half, _, origin = resampled(ramp, (1, 1, 1), (2, 2, 2), how)
    assert half.shape == (4, 4, 4) and origin == (0.5, 0.5, 0.5)
    if how != "nearest":
        assert np.allclose(half[1:3, 1:3, 1:3], np.indices((4, 4, 4)).sum(0)[1:3, 1:3, 1:3] * 2 + 1.5, atol=0.1)


def test_plan_and_results_do_not_depend_on_sharing():
    configs = Configs().resolve(["all_standard"])
    assert len(configs) == 6 and sum(r for *_, r in plan(configs)) == 10
    x = np.random.default_rng(0).normal(size=(4, 4, 4))
    a = list(run.run_volume(x, None, None, (1, 1, 1), (0, 0, 0), configs))
    b = list(run.run_volume(x, None, None, (1, 1, 1), (0, 0, 0), configs, memo=False))
    assert len(a) == 6 * (174 - 4) and repr(a) == repr(b)


def test_catalogue():
    assert sum(map(len, catalogue.FAMILIES.values())) == 174
    steps = [{"step": "discretise", "params": {"method": "FBN", "n_bins": 8}}, {"step": "extract_features", "params": {"families": ["intensity", "histogram", "ivh", "morphology", "texture"], "include_spatial_intensity": True, "include_local_intensity": True}}]
    x = np.random.default_rng(0).normal(size=(6, 6, 6))
    got = {k: v for _, _, k, v, _ in run.run_volume(x, None, None, (1, 1, 1), (0, 0, 0), {"c": Config(steps)})}
    assert len(got) == 174 and not any(np.isnan(v) for v in got.values())


def test_empty_region_is_nan():
    c = Config([{"step": "resegment", "params": {"range_min": 99}}, {"step": "extract_features", "params": {"families": ["intensity", "glcm"]}}])
    rows = list(run.run_volume(np.ones((3, 3, 3)), None, None, (1, 1, 1), (0, 0, 0), {"c": c}))
    assert len(rows) == 18 + 25 and all(np.isnan(r[3]) and "EmptyRegion" in r[4] for r in rows)


def test_configs_round_trip():
    c = Configs().add("mine", [{"step": "filter", "params": {"type": "log", "sigma_mm": 1.5}}, {"step": "extract_features", "params": {"families": ["texture"]}}], "auto")
    for back in (Configs.from_yaml(c.to_yaml()), Configs.from_json(c.to_json())):
        assert back.to_dict() == c.to_dict()
    with pytest.raises(ValueError):
        c.add("bad", [{"step": "nothing"}])
    with pytest.raises(ValueError):
        c.resolve(["absent"])
    assert Config([{"step": "resegment", "params": {"odd": 1}}]).warnings


def test_sentinel_modes():
    x = np.full((4, 4, 4), 7.0)
    x[0] = -2048
    steps = [{"step": "extract_features", "params": {"families": ["intensity"]}}]
    mean = lambda c: next(v for _, _, k, v, _ in run.run_volume(x, None, None, (1, 1, 1), (0, 0, 0), {"c": c}) if k == "mean_intensity_Q4LE")
    assert mean(Config(steps, "auto")) == 7 and mean(Config(steps)) < 0


def mixed_volumes(seed=3):
    """Small volumes of several shapes, with and without masks; one has an empty mask, two are equal."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(24):
        shape = (8, 8, 8) if k % 2 else tuple(rng.integers(1, 7, 3))
        m = (rng.random(shape) < 0.7).astype(np.uint8)
        out.append((np.round(rng.normal(20, 30, shape)), None if k % 3 == 0 else m, m if k % 3 == 1 else None, (1.0, 2.0, 1.5), (0.0, 1.0, 2.0)))
    empty = np.zeros((3, 3, 3), np.uint8)
    return [*out, (np.ones((3, 3, 3)), empty, empty, (1.0,) * 3, (0.0,) * 3), out[-1]]


def test_volumes_side_by_side_and_alone():
    """what small volumes give together is what each gives alone."""
    configs = Configs().resolve(["all_standard"])
    volumes = mixed_volumes()
    got = list(run.run_volumes(volumes, configs))
    for k, v in enumerate(volumes):
        alone = [r for r in run.run_volume(*v, configs)]
        both = [(c, f, x, np.nan if isinstance(e[k], Exception) else e[k].get(x, np.nan), run.failure(e[k])) for c, f, e in got for x in catalogue.FAMILIES[f]]
        assert [(r[:3], r[4]) for r in alone] == [(r[:3], r[4]) for r in both]
        np.testing.assert_allclose([r[3] for r in both], [r[3] for r in alone], rtol=1e-9, atol=1e-7)


def test_textures_of_many_bins_side_by_side():
    rng = np.random.default_rng(5)
    volumes = [(rng.integers(0, 5000, (5, 4, 3)), rng.random((5, 4, 3)) < 0.8, 4000, np.ones((5, 4, 3), bool)) for _ in range(9)]
    for got, (g, m, n, far) in zip(texture.many_features(volumes, catalogue.TEXTURE), volumes, strict=True):
        want = texture.texture_features(g, m, n, far)
        assert set(got) == set(want)
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-7)


FILTERS = [
    {"type": "wavelet", "wavelet": "coif1", "level": 2, "rotation_invariant": True}, {"type": "wavelet", "wavelet": "db2", "decomposition": "LHL"}, {"type": "mean", "support": 3}, {"type": "log", "sigma_mm": 1.0},
    {"type": "laws", "kernel": "L5E5E5", "rotation_invariant": True, "compute_energy": True}, {"type": "simoncelli"}, {"type": "riesz", "order": [1, 1, 1]}, {"type": "riesz", "variant": "log", "sigma_mm": 1.0},
]


@pytest.mark.parametrize("params", FILTERS)
@pytest.mark.parametrize("valid", [False, True])
def test_filters_of_stacked_volumes(params, valid):
    """a stack of volumes gives what each gives alone."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5, 5, 3, 7))
    real = rng.random(x.shape) < 0.8 if valid else None
    each = [filters.apply_filter(v, (1.0,) * 3, params, None if real is None else real[k]) for k, v in enumerate(x)]
    np.testing.assert_allclose(filters.apply_filter(x, (1.0,) * 3, params, real), each, atol=1e-12)


@pytest.mark.parametrize("shape", [(3, 4, 4, 4), (3, 5, 2, 9)])
def test_gabor_of_stacked_volumes(shape):
    """one transform of a stack serves all angles; against sums over the padded slices."""
    x = np.random.default_rng(2).normal(size=shape)
    got = filters.gabor_filter(x, 1.0, 2.0, theta=0.3, boundary="mirror")
    wide = np.pad(x, [(0, 0), (6, 6), (6, 6), (0, 0)], "symmetric")
    want = np.zeros(shape, complex)
    for u in range(-6, 7):
        for v in range(-6, 7):
            a, b = u * np.cos(0.3) + v * np.sin(0.3), -u * np.sin(0.3) + v * np.cos(0.3)
            want += np.exp(-(a**2 + b**2) / 2 + 1j * np.pi * a) * wide[:, 6 - u : 6 - u + shape[1], 6 - v : 6 - v + shape[2]]
    np.testing.assert_allclose(got, np.abs(want), atol=1e-12)
    params = {"type": "gabor", "sigma_mm": 1.0, "lambda_mm": 2.0, "rotation_invariant": True, "delta_theta": np.pi / 4, "average_over_planes": True}
    np.testing.assert_allclose(filters.apply_filter(x, (1.0,) * 3, params), [filters.apply_filter(v, (1.0,) * 3, params) for v in x], atol=1e-12)


def random_regions(n=30, seed=4):
    rng = np.random.default_rng(seed)
    shapes = [(4, 4, 4), (1, 1, 1), (1, 5, 6), (2, 3, 8), (7, 6, 5)]
    return [(rng.random(shapes[k % 5]) < (0.3, 0.8, 1.0)[k % 3]).astype(np.uint8) for k in range(n)]


def test_hulls_and_ellipsoids_together_and_alone():
    """hulls and ellipsoids of many clouds at once are those of each alone."""
    clouds = [v for m in random_regions() if len(v := morphology.mesh(m > 0, np.array([1.0, 2.0, 0.5]))[2]) > 3]
    hulls = morphology.convex_hulls(clouds)
    for cloud, (area, volume, on) in zip(clouds, hulls, strict=True):
        a, v, points = morphology.convex_hull(cloud)
        assert (area, volume) == (pytest.approx(a, rel=1e-12), pytest.approx(v, rel=1e-12)) and np.array_equal(on, points)
    for hull, radii in zip(hulls, morphology.enclosing_ellipsoids([h[2] for h in hulls]), strict=True):
        np.testing.assert_allclose(radii, morphology.enclosing_ellipsoid(hull[2]), rtol=1e-9)


def test_equal_regions_are_worked_on_once(monkeypatch):
    """a region's shape is worked out once for equal masks and spacings; what depends on the image is not shared."""
    met = []
    surface = morphology._surface
    monkeypatch.setattr(morphology, "_surface", lambda own, s: met.append(own.shape) or surface(own, s))
    monkeypatch.setattr(morphology, "_known", type(morphology._known)())
    rng = np.random.default_rng(6)
    regions = [(np.ones((2 + k % 3, 2, 3), np.uint8) * (1 + k % 2), (1.0, 1.0, 1.0 + k % 2), (0.0,) * 3, rng.random((2 + k % 3, 2, 3)), None) for k in range(24)]
    got = morphology.many_features(regions[:12]) + morphology.many_features(regions[12:])
    assert len(met) == 6
    for r, f in zip(regions, got, strict=True):
        monkeypatch.setattr(morphology, "_known", type(morphology._known)())
        assert f == pytest.approx(morphology.morphology_features(*r), rel=1e-9, abs=1e-12)
    assert len({f["integrated_intensity_99N0"] for f in got}) == len(got)


def test_known_shapes_are_bounded(monkeypatch):
    monkeypatch.setattr(morphology, "_known", type(morphology._known)())
    monkeypatch.setattr(morphology, "KNOWN_SHAPES", 5)
    masks = [m > 0 for m in random_regions(20) if m.any()]
    each = morphology.shape_features(masks, [np.ones(3)] * len(masks))
    assert len(each) == len(masks) and len(morphology._known) <= 5
