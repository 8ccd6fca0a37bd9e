"""Runs configurations over volumes: one Arrow pass, one row in for each volume, long feature rows out, no shuffle.

Within a volume, states after equal step prefixes and equal (family, signature) results are computed once. Small volumes
go through the steps side by side, so that kernels which take many regions at once get them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxframe.functions import filters, intensity, morphology, texture
from voxframe.functions.spline import resampled
from voxframe.operators.steps import SENTINELS
from voxframe.plans import catalogue
from voxframe.plans.config import Config, Rules, signature

OUT = "subject_id string, config string, family string, feature_name string, value double, error string"


class EmptyRegion(ValueError):
    pass


@dataclass(frozen=True)
class State:
    image: np.ndarray  # what histogram and texture read: bins after discretise
    raw: np.ndarray
    morph: np.ndarray
    inten: np.ndarray
    valid: np.ndarray | None
    spacing: tuple[float, ...]
    origin: tuple[float, ...]
    generated: bool
    n_bins: int | None = None
    bin_width: float | None = None
    method: str | None = None


def _masks(s: State, apply_to: str) -> list[str]:
    return {"both": ["morph", "inten"], "morph": ["morph"], "intensity": ["inten"]}[apply_to]


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 6-connected part of the mask; among equal ones the first in scanning order."""
    own = mask > 0
    zone = texture.zones(own.astype(int), own, [(0, 0, 1), (0, 1, 0), (1, 0, 0)])
    ids, n = np.unique(zone[own], return_counts=True)
    return mask if len(ids) <= 1 else np.where(zone == ids[n.argmax()], mask, 0)


def bins_of(x: np.ndarray, roi: np.ndarray, method: str = "FBN", n_bins: int | None = None, bin_width: float | None = None, min_val: float | None = None, max_val: float | None = None, cutoffs: list[float] | None = None) -> np.ndarray:
    if method == "FIXED_CUTOFFS":
        return np.digitize(x, cutoffs)
    base = x[roi] if roi.any() else x
    lo = np.nanmin(base) if min_val is None else min_val
    hi = np.nanmax(base) if max_val is None else max_val
    with np.errstate(invalid="ignore"):
        if method == "FBS":
            out = np.maximum(np.floor((x - lo) / bin_width) + 1, 1)
        elif hi <= lo:
            out = np.ones(x.shape)
        else:
            out = np.where(x >= hi, n_bins, np.clip(np.floor(n_bins * (x - lo) / (hi - lo)) + 1, 1, n_bins))
    return np.nan_to_num(np.where(np.isnan(x), 0, out)).astype(np.int64)


def apply_step(s: State, step: str, p: dict) -> State:
    if step == "resample":
        new = tuple(float(x) for x in p["new_spacing"])
        how, soft = p.get("interpolation", "linear"), p.get("mask_interpolation", "nearest")
        image, valid, origin = resampled(s.image, s.spacing, new, how, s.valid, s.origin)
        if p.get("round_intensities"):
            image = np.rint(image)

        def mask(m: np.ndarray) -> np.ndarray:
            out = resampled(m.astype(float), s.spacing, new, soft, None, s.origin)[0]
            return (out >= p.get("mask_threshold", 0.5)).astype(np.uint8) if soft != "nearest" else np.rint(out).astype(m.dtype)

        inten = mask(s.inten)
        return replace(s, image=image, raw=image, morph=mask(s.morph), inten=inten if valid is None else inten * valid, valid=valid, spacing=new, origin=origin)
    if step == "resegment":
        lo, hi = p.get("range_min"), p.get("range_max")
        out = np.zeros(s.image.shape, bool)
        with np.errstate(invalid="ignore"):
            out |= s.image < lo if lo is not None else False
            out |= s.image > hi if hi is not None else False
        return replace(s, inten=np.where(out, 0, s.inten), morph=np.where(out, 0, s.morph) if s.generated else s.morph)
    if step == "filter_outliers":
        x = s.image[s.inten == 1]
        far = np.abs(s.image - x.mean()) > p.get("sigma", 3.0) * x.std() if len(x) else np.zeros(s.image.shape, bool)
        return replace(s, inten=np.where(far, 0, s.inten))
    if step == "round_intensities":
        return replace(s, image=np.rint(s.image), raw=np.rint(s.raw))
    if step == "keep_largest_component":
        return replace(s, **{m: largest_component(getattr(s, m)) for m in _masks(s, p.get("apply_to", "both"))})
    if step == "binarize_mask":
        values = p.get("mask_values")

        def hit(m: np.ndarray) -> np.ndarray:
            if values is None:
                return m >= p.get("threshold", 0.5)
            if isinstance(values, tuple) and len(values) == 2:
                return (m >= values[0]) & (m <= values[1])
            return np.isin(m, values)

        return replace(s, **{m: hit(getattr(s, m)).astype(np.uint8) for m in _masks(s, p.get("apply_to", "both"))})
    if step == "discretise":
        method = p.get("method", "FBN")
        roi = s.inten > 0
        g = bins_of(s.image, roi, method, p.get("n_bins"), p.get("bin_width"), p.get("min_val"), p.get("max_val"), p.get("cutoffs"))
        n = int(p["n_bins"]) if method == "FBN" else int(g[roi].max()) if roi.any() else int(g.max())
        return replace(s, image=g, n_bins=n, bin_width=p.get("bin_width"), method=method)
    if step == "filter":
        x = filters.apply_filter(s.image, s.spacing, p, s.valid)
        return replace(s, image=x, raw=x)
    raise ValueError(f"no step {step}")


def cropped(s: State) -> State:
    """The state within the box of its masks: what lies outside counts for no family but the local peaks."""
    own = np.argwhere((s.morph > 0) | (s.inten > 0))
    if not len(own):
        return s
    box = tuple(slice(a, b + 1) for a, b in zip(own.min(0), own.max(0), strict=True))
    if all(k.start == 0 and k.stop == n for k, n in zip(box, s.image.shape, strict=True)):
        return s
    origin = tuple(o + k.start * t for o, k, t in zip(s.origin, box, s.spacing, strict=True))
    return replace(s, image=s.image[box], raw=s.raw[box], morph=s.morph[box], inten=s.inten[box], valid=None if s.valid is None else s.valid[box], origin=origin)


def compute_families(s: State, families: list[str], p: dict) -> dict[str, dict[str, float]]:
    """Features by family; texture families that are asked for together share their neighbourhoods, zones and distances."""
    if families[0] != "local_intensity":
        s = cropped(s)
    if families[0] not in catalogue.TEXTURE:
        return {families[0]: compute_family(s, families[0], p)}
    roi = s.inten == 1
    g = s.image if s.n_bins else bins_of(s.image, roi, "FBN", 32)
    got = texture.texture_features(g, s.inten > 0, s.n_bins or 32, s.morph > 0, tuple(families), p.get("ngldm_alpha", 0))
    return {f: {k: got[k] for k in catalogue.FAMILIES[f] if k in got} for f in families}


def compute_family(s: State, family: str, p: dict) -> dict[str, float]:
    roi = s.inten == 1
    if family == "intensity":
        return intensity.intensity_features(s.raw[roi])
    if family == "spatial_intensity":
        return intensity.spatial_features(s.raw, s.inten > 0, s.spacing)
    if family == "local_intensity":
        return intensity.local_features(s.raw, s.inten > 0, s.spacing)
    if family == "morphology":
        return morphology.morphology_features(s.morph, s.spacing, s.origin, s.raw, s.inten)
    if family == "histogram":
        return intensity.histogram_features(s.image[roi]) if s.n_bins else {}
    if family == "ivh":
        q = dict(p.get("ivh_params") or {})
        if p.get("ivh_use_continuous"):
            return intensity.ivh_features(s.raw[roi], target_min=q.get("target_range_min"), target_max=q.get("target_range_max"))
        if how := p.get("ivh_discretisation"):
            how = dict(how)
            method = how.pop("method", "FBS")
            g = bins_of(s.raw, roi, method, **how)
            lo = how.get("min_val", float(np.nanmin(s.raw[roi])))
            return intensity.ivh_features(g[roi], how.get("bin_width", 1.0), lo if method == "FBS" else None, how.get("max_val"), q.get("target_range_min"), q.get("target_range_max"))
        if s.n_bins:
            return intensity.ivh_features(s.image[roi], q.get("bin_width", 1.0), q.get("min_val"), q.get("max_val"), q.get("target_range_min"), q.get("target_range_max"))
        return intensity.ivh_features(s.raw[roi], q.get("bin_width"), q.get("min_val"), q.get("max_val"), q.get("target_range_min"), q.get("target_range_max"))
    raise ValueError(f"no feature family {family}")


def source_state(data: np.ndarray, morph: np.ndarray | None, inten: np.ndarray | None, spacing: tuple, origin: tuple, c: Config) -> State:
    """full_image: every voxel is real; roi_only: those unlike the sentinel, or within the mask; auto: if a sentinel is found."""
    generated = morph is None
    morph = np.ones(data.shape, np.uint8) if morph is None else morph
    inten = morph.copy() if inten is None else inten
    valid = None
    if c.source_mode != "full_image":
        value = c.sentinel_value
        if value is None:
            for k in SENTINELS:
                hit = data == k
                inside = int((hit & (inten > 0)).sum())
                if hit.mean() >= 0.01 and (generated or int(hit.sum()) - inside > 2 * inside):
                    value = k
                    break
        if value is not None:
            valid = data != value
        elif c.source_mode == "roi_only":
            valid = inten > 0
        if valid is not None:
            inten = inten * valid
    return State(data, data, morph, inten, valid, tuple(spacing), tuple(origin), generated)


def families_of_many(states: list[State], families: list[str], p: dict) -> list[dict[str, dict[str, float]] | Exception]:
    """compute_families of every state; what fails for one leaves the others."""
    if families == ["morphology"] and len(states) > 1:
        try:
            own = [cropped(s) for s in states]
            return [{"morphology": got} for got in morphology.many_features([(s.morph, s.spacing, s.origin, s.raw, s.inten) for s in own])]
        except Exception:  # noqa: S110  # one of them; each alone tells which
            pass
    if families[0] in catalogue.TEXTURE and len(states) > 1:
        try:
            own = [cropped(s) for s in states]
            level = [s.image if s.n_bins else bins_of(s.image, s.inten == 1, "FBN", 32) for s in own]
            each = texture.many_features([(g, s.inten > 0, s.n_bins or 32, s.morph > 0) for g, s in zip(level, own, strict=True)], tuple(families), p.get("ngldm_alpha", 0))
            return [{f: {k: got[k] for k in catalogue.FAMILIES[f] if k in got} for f in families} for got in each]
        except Exception:  # noqa: S110
            pass
    out: list[dict[str, dict[str, float]] | Exception] = []
    for s in states:
        try:
            out.append(compute_families(s, families, p))
        except Exception as e:
            out.append(e)
    return out


def run_volumes(volumes: list[tuple], configs: dict[str, Config], memo: bool = True, rules: Rules | None = None) -> Iterator[tuple[str, str, list[dict[str, float] | Exception]]]:
    """(config, family, the features of each volume or what kept it from them) of volumes (data, morph, inten, spacing, origin)."""
    states: dict[str, list[State | Exception]] = {}
    results: dict[str, list[dict[str, float] | Exception]] = {}
    for name, c in configs.items():
        now: list[State | Exception] = [EmptyRegion("not begun")] * len(volumes)
        key = json.dumps([c.source_mode, c.sentinel_value])
        done: set[str] = set()
        for step in [{"step": ""}, *c.steps]:
            p = step.get("params", {})
            if step["step"] == "extract_features":
                wanted = catalogue.expand(p.get("families", []), bool(p.get("include_spatial_intensity")), bool(p.get("include_local_intensity")))
                for f in wanted:
                    if f in done:
                        continue
                    done.add(f)
                    sign = signature(c, f, rules) + ("" if memo else name)
                    if sign not in results:
                        together = {f: sign}
                        if f in catalogue.TEXTURE:
                            together = {x: signature(c, x, rules) + ("" if memo else name) for x in wanted if x in catalogue.TEXTURE}
                            together = {x: k for x, k in together.items() if k not in results}
                        good = [k for k, s in enumerate(now) if not isinstance(s, Exception)]
                        got = dict(zip(good, families_of_many([now[k] for k in good], list(together), p), strict=True))
                        each = [got.get(k, s) for k, s in enumerate(now)]
                        results |= {k: [g if isinstance(g, Exception) else g[x] for g in each] for x, k in together.items()}
                    yield name, f, results[sign]
                continue
            key += json.dumps(step, sort_keys=True, default=list)
            if key not in states or not memo:
                after: list[State | Exception] = []
                for s, v in zip(now, volumes, strict=True):
                    try:
                        if step["step"]:
                            if isinstance(s, Exception):
                                raise s
                            new = apply_step(s, step["step"], p)
                        else:
                            new = source_state(*v, c)
                        if not (new.inten == 1).any() or not (new.morph == 1).any():
                            raise EmptyRegion("no voxel is left in the mask")
                        after.append(new)
                    except Exception as e:
                        after.append(e)
                states[key] = after
            now = states[key]


def run_volume(data: np.ndarray, morph: np.ndarray | None, inten: np.ndarray | None, spacing: tuple, origin: tuple, configs: dict[str, Config], memo: bool = True, rules: Rules | None = None) -> Iterator[tuple[str, str, str, float, str | None]]:
    """(config, family, feature, value, error) for every expected feature; NaN where there is none."""
    for name, f, (got,) in run_volumes([(data, morph, inten, spacing, origin)], configs, memo, rules):
        bad = isinstance(got, Exception)
        for k in catalogue.FAMILIES[f]:
            yield name, f, k, float("nan") if bad else got.get(k, float("nan")), failure(got)


def failure(got: dict[str, float] | Exception) -> str | None:
    return f"{type(got).__name__}: {got}"[:200] if isinstance(got, Exception) else None


def spread(volumes: DataFrame) -> DataFrame:
    """Volumes cost far more to compute than to move, and how a file's rows fall to its splits can't be told beforehand:

    all rows of one large file's only row group are read by one task, however many splits it has. So they are dealt out.
    """
    cores = volumes.sparkSession.sparkContext.defaultParallelism
    return volumes.repartition(max(4 * cores, volumes.rdd.getNumPartitions()))


#: Volumes that a task works on side by side: at most so many, and so many voxels unless one alone has more.
SIDE_BY_SIDE, SIDE_BY_SIDE_VOXELS = 256, 16384


def chunks(b: pa.RecordBatch, at: int = 1) -> Iterator[range]:
    """Rows of a batch to be worked on together; the columns from `at` on are nx, ny, nz."""
    size = [int(np.prod(n)) for n in zip(*(b.column(at + k).to_pylist() for k in range(3)), strict=True)]
    begin = total = 0
    for k, n in enumerate(size):
        if k > begin and (total + n > SIDE_BY_SIDE_VOXELS or k - begin >= SIDE_BY_SIDE):
            yield range(begin, k)
            begin, total = k, 0
        total += n
    if size:
        yield range(begin, len(size))


def run(volumes: DataFrame, configs: dict[str, Config], memo: bool = True, rules: Rules | None = None) -> DataFrame:
    """Long features of all volumes (optional mask arrays `morph`, `intensity`) under all configurations.

    memo and rules say whether and by which rules equal results are computed once; plans.config.deduplication tells what that saves.

    The column set is complete: a feature without a value is NaN, with the error that caused it.
    """
    masks = [c for c in ("morph", "intensity") if c in volumes.columns]
    names = [p.split()[0] for p in OUT.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: list[pa.Array] = []  # config, family and feature of a volume's rows: the same for all volumes
        for b in batches:
            for rows in chunks(b):
                many, keys = [], []
                for i in rows:
                    r = {k: b.column(j)[i] for j, k in enumerate(b.schema.names)}
                    shape = tuple(r[k].as_py() for k in ("nx", "ny", "nz"))
                    array = lambda c, r=r, shape=shape: r[c].values.to_numpy(zero_copy_only=False).reshape(shape)
                    mask = lambda c, r=r, array=array: array(c).astype(np.uint8) if c in r and r[c].is_valid else None
                    many.append((array("data").astype(float), mask("morph"), mask("intensity"), tuple(r["spacing"].as_py()), tuple(r["origin"].as_py())))
                    keys.append(str(r["volume_id"].as_py()))
                got = list(run_volumes(many, configs, memo, rules))
                if not got:
                    continue
                if not labels:
                    labels = [pa.array(x) for x in zip(*((c, f, k) for c, f, _ in got for k in catalogue.FAMILIES[f]), strict=True)]
                nan = float("nan")
                value = np.concatenate([[[nan] * len(catalogue.FAMILIES[f]) if isinstance(g, Exception) else [g.get(k, nan) for k in catalogue.FAMILIES[f]] for g in each] for _, f, each in got], 1)
                n = value.shape[1]
                error = pa.nulls(value.size, pa.string())
                if any(isinstance(g, Exception) for _, _, each in got for g in each):
                    error = pa.array([failure(each[v]) for v in range(len(many)) for _, f, each in got for _ in catalogue.FAMILIES[f]], pa.string())
                every = pa.array(np.tile(np.arange(n), len(many)))
                yield pa.RecordBatch.from_arrays([pa.array(keys).take(pa.array(np.repeat(np.arange(len(many)), n))), *(x.take(every) for x in labels), pa.array(value.ravel()), error], names=names)

    return spread(volumes.select("volume_id", "nx", "ny", "nz", "spacing", "origin", "data", *masks)).mapInArrow(kernel, OUT)


def _voxel_rows(volumes: DataFrame, of, kind: pa.DataType, name: str) -> DataFrame:  # noqa: ANN001
    """volume_id, x, y, z and one value of the voxels that of(arrays, spacing) marks, of volumes of any shape.

    Arrays of one shape and spacing come stacked.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in chunks(b):
                alike: dict[tuple, list[int]] = {}
                for r in rows:
                    alike.setdefault((tuple(b.column(k)[r].as_py() for k in (1, 2, 3)), tuple(b.column(4)[r].as_py())), []).append(r)
                for (shape, spacing), own in alike.items():
                    x = np.stack([b.column(5)[r].values.to_numpy(zero_copy_only=False).reshape(shape) for r in own]).astype(float)
                    mark, value = of(x, spacing)
                    at = np.argwhere(mark).astype(np.int32)
                    ids = b.column(0).take(pa.array(own)).cast(volume_kind).take(pa.array(at[:, 0]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(at[:, k]) for k in (1, 2, 3)), pa.array(value[mark], kind)], names=["volume_id", "x", "y", "z", name])

    id_type = volumes.schema["volume_id"].dataType.simpleString()
    volume_kind = pa.string() if id_type == "string" else pa.int64()
    return spread(volumes.select("volume_id", "nx", "ny", "nz", "spacing", "data")).mapInArrow(kernel, f"volume_id {id_type}, x int, y int, z int, {name} {'double' if kind == pa.float64() else 'int'}")


def filtered(volumes: DataFrame, params: dict) -> DataFrame:
    """volume_id, x, y, z, v of volumes of any shape after a filter step."""

    def of(x: np.ndarray, spacing: tuple) -> tuple[np.ndarray, np.ndarray]:
        return np.ones(x.shape, bool), filters.apply_filter(x, spacing, params)

    return _voxel_rows(volumes, of, pa.float64(), "v")


def largest_components(volumes: DataFrame, above: float = 0.0) -> DataFrame:
    """volume_id, x, y, z, kept of the voxels in the largest 6-connected part of those above a value."""

    def of(x: np.ndarray, spacing: tuple) -> tuple[np.ndarray, np.ndarray]:
        got = np.stack([largest_component(v) for v in (x > above).astype(int)]) > 0
        return got, got.astype(np.int32)

    return _voxel_rows(volumes, of, pa.int32(), "kept")


def matrices(volumes: DataFrame, method: str = "FBN", n_bins: int | None = 8, bin_width: float | None = None, families: tuple[str, ...] = catalogue.TEXTURE) -> DataFrame:
    """volume_id, family, i, j, n: the sparse texture matrices of whole volumes (NGTDM: j is 0, n counts voxels).

    Only what the asked families need is computed: zones serve GLSZM and GLDZM, neighbourhoods NGTDM and NGLDM.
    """
    if unknown := set(families) - set(catalogue.TEXTURE):
        raise ValueError(f"no texture matrices {sorted(unknown)}")

    def of(g: np.ndarray, roi: np.ndarray) -> Iterator[tuple[str, tuple]]:
        if "glcm" in families:
            yield "glcm", texture.glcm(g, roi)
        if "glrlm" in families:
            yield "glrlm", texture.glrlm(g, roi)
        if {"glszm", "gldzm"} & set(families):
            yield from zip(("glszm", "gldzm"), texture.glszm_gldzm(g, roi, roi), strict=True)
        if {"ngtdm", "ngldm"} & set(families):
            tone, dependence = texture.neighbourhood(g, roi)
            yield "ngldm", dependence
            yield "ngtdm", (tone[0], np.zeros(len(tone[0]), int), tone[1])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                key, shape = b.column(0)[r].as_py(), tuple(b.column(k)[r].as_py() for k in (1, 2, 3))
                x = b.column(4)[r].values.to_numpy(zero_copy_only=False).reshape(shape).astype(float)
                roi = np.ones(shape, bool)
                for family, (a, c, n) in of(bins_of(x, roi, method, n_bins, bin_width), roi):
                    if family in families:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(a), key), pa.int64()), pa.array([family] * len(a), pa.string()), *(pa.array(np.asarray(v), pa.int64()) for v in (a, c, n))],
                            names=["volume_id", "family", "i", "j", "n"],
                        )

    return spread(volumes.select("volume_id", "nx", "ny", "nz", "data")).mapInArrow(kernel, "volume_id long, family string, i long, j long, n long")
