"""Preprocessing steps on voxel tables (volume_id, x, y, z, v, morph_mask, intensity_mask, source_valid).

All are projections, or projections over one grouped pass per volume that is joined back on the grouped key;
nothing else is shuffled. NaN values are never in a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "volume_id"
#: Values that scanners write where they measured nothing, in the order in which they are tried.
SENTINELS = (-2048.0, -1024.0, -1000.0, 0.0, -32768.0)


def _joined(voxels: DataFrame, stats: DataFrame) -> DataFrame:
    """Joins one row for each volume back; the volumes' table may be large, so the planner picks the side by its size."""
    stats = stats.withColumnRenamed(KEY, "_volume")
    return voxels.join(stats, F.col(KEY) == F.col("_volume"), "left").drop("_volume")


def in_values(mask: Column, values: int | list[int] | tuple) -> Column:
    return mask.isin([values] if isinstance(values, int) else list(values))


def apply_mask(voxels: DataFrame, values: int | list[int] = 1, mask: str = "intensity_mask") -> DataFrame:
    """Only the voxels whose mask is one of the values."""
    return voxels.filter(in_values(F.col(mask), values))


def extract_roi(voxels: DataFrame, values: int | list[int] = 1, mask: str = "intensity_mask") -> DataFrame:
    """All voxels; those outside are NaN."""
    return voxels.withColumn("v", F.when(in_values(F.col(mask), values), F.col("v")).otherwise(F.lit(float("nan"))))


def resegment(voxels: DataFrame, low: float | None = None, high: float | None = None, generated: bool = False) -> DataFrame:
    """Takes voxels outside [low, high] out of the intensity mask, and of a generated morphological mask too; NaN stays."""
    out = F.lit(False)
    if low is not None:
        out = out | (F.col("v") < low)
    if high is not None:
        out = out | (F.col("v") > high)
    out = out & ~F.isnan("v")
    for m in ("intensity_mask", "morph_mask")[: 2 if generated else 1]:
        voxels = voxels.withColumn(m, F.when(out, 0).otherwise(F.col(m)))
    return voxels


def filter_outliers(voxels: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Keeps the intensity mask within sigma population deviations of the region's mean."""
    roi = voxels.filter("intensity_mask = 1").groupBy(KEY).agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std"))
    out = _joined(voxels, roi)
    far = F.abs(F.col("v") - F.col("_mean")) > sigma * F.col("_std")
    return out.withColumn("intensity_mask", F.when(F.coalesce(far, F.lit(False)), 0).otherwise(F.col("intensity_mask"))).drop("_mean", "_std")


def round_intensities(voxels: DataFrame) -> DataFrame:
    """Half to even."""
    return voxels.withColumn("v", F.rint("v"))


def binarize_mask(voxels: DataFrame, threshold: float = 0.5, values: int | list[int] | tuple | None = None, apply_to: str = "both") -> DataFrame:
    """1 from the threshold on, or for listed values, or within a closed range given as a tuple of two."""
    for m in {"both": ("morph_mask", "intensity_mask"), "morph": ("morph_mask",), "intensity": ("intensity_mask",)}[apply_to]:
        c = F.col(m)
        if values is None:
            hit = c >= threshold
        elif isinstance(values, tuple) and len(values) == 2:
            hit = c.between(*values)
        else:
            hit = in_values(c, values)
        voxels = voxels.withColumn(m, F.when(hit, 1).otherwise(0))
    return voxels


def detect_sentinel(voxels: DataFrame, candidates: tuple[float, ...] = SENTINELS, least: float = 0.01, by_roi: bool = False) -> DataFrame:
    """volume_id, sentinel: the first candidate on at least that share of voxels (and more than twice as often outside the region)."""
    inside = F.col("intensity_mask") > 0
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(candidates):
        aggs += [F.count_if(F.col("v") == c).alias(f"_all{i}"), F.count_if((F.col("v") == c) & inside).alias(f"_in{i}")]
    got = voxels.groupBy(KEY).agg(*aggs)
    first = F.lit(None).cast("double")
    for i, c in reversed(list(enumerate(candidates))):
        ok = (F.col(f"_all{i}") > 0) & (F.col(f"_all{i}") >= least * F.col("_n"))
        if by_roi:
            ok = ok & (F.col(f"_all{i}") - F.col(f"_in{i}") > 2 * F.col(f"_in{i}"))
        first = F.when(ok, F.lit(c)).otherwise(first)
    return got.select(KEY, first.alias("sentinel"))


def source_mask(voxels: DataFrame, sentinel: float, tolerance: float = 0.0) -> DataFrame:
    return voxels.withColumn("source_valid", F.abs(F.col("v") - sentinel) > tolerance if tolerance else F.col("v") != sentinel)


def discretise(voxels: DataFrame, method: str = "FBN", n_bins: int | None = None, bin_width: float | None = None, cutoffs: list[float] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds the bin g. Missing ends of the range are those of the region, or of the volume where it is empty."""
    v = F.col("v")
    if method == "FIXED_CUTOFFS":
        return voxels.withColumn("g", F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c <= v)))
    roi = F.when(F.col("intensity_mask") > 0, v)
    ends = voxels.groupBy(KEY).agg(F.coalesce(F.min(roi), F.min("v")).alias("_lo"), F.coalesce(F.max(roi), F.max("v")).alias("_hi"))
    out = _joined(voxels, ends)
    lo = F.lit(float(low)) if low is not None else F.col("_lo")
    hi = F.lit(float(high)) if high is not None else F.col("_hi")
    if method == "FBN":
        g = F.floor(F.try_divide(n_bins * (v - lo), hi - lo)) + 1
        g = F.when(hi <= lo, 1).when(v >= hi, n_bins).otherwise(F.least(F.greatest(g, F.lit(1)), F.lit(n_bins)))
    elif method == "FBS":
        g = F.greatest(F.floor((v - lo) / bin_width) + 1, F.lit(1))
    else:
        raise ValueError(f"no discretisation {method}")
    return out.withColumn("g", F.when(F.isnan(v), 0).otherwise(g).cast("int")).drop("_lo", "_hi")


def empty_regions(voxels: DataFrame, mask: str = "intensity_mask") -> DataFrame:
    """volume_id, empty: whether no voxel is left in the mask."""
    return voxels.groupBy(KEY).agg((F.coalesce(F.max(F.when(F.col(mask) == 1, 1)), F.lit(0)) == 0).alias("empty"))


def window_level(voxels: DataFrame, centre: float, width: float) -> DataFrame:
    """Adds the grey value 0..255 of a display window, truncated; flat windows give 0."""
    lo, hi = centre - width / 2, centre + width / 2
    if hi <= lo:
        return voxels.withColumn("grey", F.lit(0))
    return voxels.withColumn("grey", ((F.greatest(F.least(F.col("v"), F.lit(hi)), F.lit(lo)) - lo) / (hi - lo) * 255).cast("int"))


def normalise(voxels: DataFrame) -> DataFrame:
    """Adds the grey value 0..255 between the volume's extremes, truncated; flat volumes give 0."""
    ends = voxels.groupBy(KEY).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    scaled = F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 255
    return _joined(voxels, ends).withColumn("grey", F.coalesce(scaled, F.lit(0.0)).cast("int")).drop("_lo", "_hi")


def overlay(greys: DataFrame, palette: list[tuple[int, int, int]], alpha: float = 0.25, mask: str = "morph_mask") -> DataFrame:
    """Adds r, g_, b: the grey value, blended with the palette's colour of the mask's label (labels wrap around)."""
    table = F.array(*[F.array(*map(F.lit, c)) for c in palette])
    colour = F.element_at(table, (F.pmod(F.col(mask) - 1, F.lit(len(palette))) + 1).cast("int"))
    for i, name in enumerate(("r", "g_", "b")):
        greys = greys.withColumn(name, F.when(F.col(mask) > 0, F.floor((1 - alpha) * F.col("grey") + alpha * F.get(colour, F.lit(i)))).otherwise(F.col("grey")).cast("int"))
    return greys


def select_slices(count: int, selection: str | int | list[int]) -> list[int]:
    """Indices of a selection: every_N, N (so many, evenly), N%, one index or a list."""
    if isinstance(selection, list):
        return [i for i in selection if 0 <= i < count]
    if isinstance(selection, int):
        return [selection] if 0 <= selection < count else []
    s = selection.strip()
    if s.startswith("every_"):
        return list(range(0, count, max(1, int(s[6:]))))
    step = max(1, int(100 / float(s[:-1]))) if s.endswith("%") else max(1, count // max(1, int(s)))
    out = list(range(0, count, step))
    return out if s.endswith("%") else out[: int(s)]
