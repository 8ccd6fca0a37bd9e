"""Resampling, positioning and merging of volumes as coordinate joins on (volume_id, x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "volume_id"


def new_shape(shape: tuple[int, int, int], spacing: tuple[float, ...], new_spacing: tuple[float, ...]) -> list[int]:
    return [math.ceil(n * s / t - 1e-9) for n, s, t in zip(shape, spacing, new_spacing, strict=True)]


def _axis(n: int, m: int, s: float, t: float, order: int) -> list[tuple[int, int, float]]:
    """(output, input, weight) along one axis; grids share their centre, places beyond the border take its value."""
    out = []
    r = t / s
    for k in range(m):
        x = r * k + ((n - 1) / 2 - r * (m - 1) / 2)
        if order == 0:
            out.append((k, min(max(math.floor(x + 0.5), 0), n - 1), 1.0))
            continue
        lo = math.floor(x)
        f = x - lo
        for i, w in ((lo, 1 - f), (lo + 1, f)):
            if w > 0:
                out.append((k, min(max(i, 0), n - 1), w))
    return out


def resample(voxels: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, ...], new_spacing: tuple[float, ...], interpolation: str = "linear", threshold: float | None = None) -> DataFrame:
    """volume_id, x, y, z, v on the new grid; three joins with the axes' weights, each bounded by a volume's edge.

    A nearest place takes the value of one voxel, so nothing is summed, and no row is moved.

    With source_valid, values are averaged over valid voxels only, and are null where their weight is below 0.01.
    """
    order = {"nearest": 0, "linear": 1}[interpolation]
    spark = voxels.sparkSession
    m = new_shape(shape, spacing, new_spacing)
    valid = "source_valid" in voxels.columns
    out = voxels.select(KEY, "x", "y", "z", "v", (F.col("source_valid").cast("double") if valid else F.lit(1.0)).alias("_w"))
    out = out.withColumn("v", F.col("v") * F.col("_w"))
    for a, axis in enumerate("xyz"):
        table = spark.createDataFrame(_axis(shape[a], m[a], spacing[a], new_spacing[a], order), f"_o int, _i int, _f double")
        rest = [c for c in "xyz" if c != axis]
        if not order:
            out = out.join(F.broadcast(table), F.col(axis) == F.col("_i")).select(KEY, *rest, F.col("_o").alias(axis), "v", "_w")
            continue
        out = out.join(F.broadcast(table), F.col(axis) == F.col("_i")).groupBy(KEY, *rest, F.col("_o").alias(axis)).agg(
            F.sum(F.col("v") * F.col("_f")).alias("v"), F.sum(F.col("_w") * F.col("_f")).alias("_w")
        )
    v = F.when(F.col("_w") >= 0.01, F.col("v") / F.col("_w")) if valid else F.col("v")
    if threshold is not None:
        v = (v >= threshold).cast("double")
    return out.select(KEY, "x", "y", "z", v.alias("v"))


def reposition(voxels: DataFrame, origin: tuple[float, ...], spacing: tuple[float, ...], shape: tuple[int, ...], reference_origin: tuple[float, ...], fill: float = 0.0) -> DataFrame:
    """Every volume on the reference grid: shifted by whole voxels, cut to it, and filled where it has none."""
    off = [round((o - r) / s) for o, r, s in zip(origin, reference_origin, spacing, strict=True)]
    moved = voxels.select(KEY, *[(F.col(c) + k).alias(c) for c, k in zip("xyz", off, strict=True)], "v")
    grid = voxels.select(KEY).distinct()
    for c, n in zip("xyz", shape, strict=True):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(moved, [KEY, "x", "y", "z"], "left").select(KEY, "x", "y", "z", F.coalesce("v", F.lit(fill)).alias("v"))


def resample_each(voxels: DataFrame, headers: DataFrame, new_spacing: tuple[float, ...], interpolation: str = "linear") -> DataFrame:
    """As resample, for volumes of any shapes and spacings: headers (volume_id, nx, ny, nz, spacing) tell each one's.

    The weights of an axis are one row for each output and tap of a volume's edge, joined by volume and coordinate.
    """
    order = {"nearest": 0, "linear": 1}[interpolation]
    out = voxels.select(KEY, "x", "y", "z", "v")
    for a, axis in enumerate("xyz"):
        t = float(new_spacing[a])
        n, s = F.col(f"n{axis}"), F.get("spacing", F.lit(a))
        m = F.ceil(n * s / t - 1e-9).cast("int")
        place = F.col("_o") * (t / s) + ((n - 1) / 2 - t / s * (m - 1) / 2)
        at = headers.select(F.col(KEY).alias("_id"), n, "spacing", F.explode(F.sequence(F.lit(0), m - 1)).alias("_o")).select("_id", n, "_o", place.alias("_p"))
        low = F.floor("_p")
        taps = F.array(F.struct(F.floor(F.col("_p") + 0.5).alias("i"), F.lit(1.0).alias("f"))) if not order else F.array(F.struct(low.alias("i"), (1 - (F.col("_p") - low)).alias("f")), F.struct((low + 1).alias("i"), (F.col("_p") - low).alias("f")))
        table = at.select("_id", "_o", F.col(f"n{axis}").alias("_n"), F.explode(taps).alias("t")).filter("t.f > 0")
        table = table.select("_id", "_o", F.least(F.greatest(F.col("t.i"), F.lit(0)), F.col("_n") - 1).cast("int").alias("_i"), F.col("t.f").alias("_f"))
        rest = [c for c in "xyz" if c != axis]
        out = out.join(table, (F.col(KEY) == F.col("_id")) & (F.col(axis) == F.col("_i")))
        if order:
            out = out.groupBy(KEY, *rest, F.col("_o").alias(axis)).agg(F.sum(F.col("v") * F.col("_f")).alias("v"))
        else:  # one voxel for each place
            out = out.select(KEY, *rest, F.col("_o").alias(axis), (F.col("v") * F.col("_f")).alias("v"))
    return out.select(KEY, "x", "y", "z", "v")


def on_reference(voxels: DataFrame, headers: DataFrame, reference: DataFrame, fill: float = 0.0, transpose: tuple[int, int, int] | None = None) -> DataFrame:
    """volume_id, x, y, z, v, turned of every volume on its own reference grid.

    reference has volume_id, nx, ny, nz, spacing, origin and (if known) direction of the grid for each volume. Origins
    tell the shift in whole voxels; what lies outside is cut, what is missing is filled. Spacings that differ by over a
    hundredth are an error; `turned` says where directions differ by over a hundredth, so that the place may be wrong.
    """
    axes = transpose or (0, 1, 2)
    own = voxels.select(KEY, *[F.col("xyz"[k]).alias("xyz"[i]) for i, k in enumerate(axes)], "v")
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in (KEY, "nx", "ny", "nz", "spacing", "origin")], (F.col("direction") if "direction" in df.columns else F.lit(None).cast("array<double>")).alias(f"{p}direction"))
    both = side(headers, "_").join(side(reference, "r_"), F.col(f"_{KEY}") == F.col(f"r_{KEY}"))
    apart = F.exists(F.zip_with("_spacing", "r_spacing", lambda a, b: F.abs(a - b) > 1e-8 + 0.01 * F.abs(b)), lambda t: t)
    eye = F.array(*[F.lit(float(i in (0, 4, 8))) for i in range(9)])
    turned = F.exists(F.zip_with(F.coalesce("_direction", eye), F.coalesce("r_direction", eye), lambda a, b: F.abs(a - b) > 0.01), lambda t: t)
    both = both.select("*", F.when(apart, F.raise_error(F.lit("spacings of image and reference differ; resample first")).cast("boolean")).otherwise(turned).alias("turned"))
    shift = [F.rint((F.get("_origin", F.lit(i)) - F.get("r_origin", F.lit(i))) / F.get("r_spacing", F.lit(i))).cast("int") for i in range(3)]
    at = both.select(F.col(f"_{KEY}").alias("_id"), *[s.alias(f"_s{i}") for i, s in enumerate(shift)])
    moved = own.join(at, F.col(KEY) == F.col("_id")).select(F.col(KEY).alias("_id"), *[(F.col(c) + F.col(f"_s{i}")).alias(f"_{c}") for i, c in enumerate("xyz")], "v")
    grid = both.select(F.col(f"_{KEY}").alias(KEY), "turned", "r_nx", "r_ny", "r_nz")
    for c in "xyz":
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(f"r_n{c}") - 1)))
    on = (F.col(KEY) == F.col("_id")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")) & (F.col("z") == F.col("_z"))
    return grid.join(moved, on, "left").select(KEY, "x", "y", "z", F.coalesce("v", F.lit(float(fill))).alias("v"), "turned")


def _binarized(v: Column, how: bool | int | list | tuple) -> Column:
    """True: above 0; a number: equal to it; a list: one of it; a pair: within it, ends included."""
    if how is True:
        hit = v > 0
    elif isinstance(how, tuple):
        hit = v.between(*how)
    elif isinstance(how, list):
        hit = v.isin(how)
    else:
        hit = v == how
    return F.when(hit, 1.0).otherwise(0.0)


def merge(voxels: DataFrame, by: str, ord_: str, conflict: str = "max", fill: float = 0.0, binarize: bool | int | list | tuple | None = None, relabel: bool = False) -> DataFrame:
    """Union of the volumes of each `by`, in the order `ord_`: where several have a value other than fill, the rule decides.

    With relabel, the values of a volume become its number in that order, from 1. binarize is applied to the union.
    """
    if relabel:
        w = W.partitionBy(by).orderBy(ord_)
        number = voxels.select(by, ord_).distinct().select(F.col(by).alias("_by"), F.col(ord_).alias("_ord"), F.row_number().over(w).cast("double").alias("_label"))
        voxels = voxels.join(number, F.col(by).eqNullSafe(F.col("_by")) & (F.col(ord_) == F.col("_ord"))).withColumn("v", F.when(F.col("v") != fill, F.col("_label")).otherwise(F.lit(fill)))
    v, o = F.col("v"), F.col(ord_)
    rule = {"max": F.max(v), "min": F.min(v), "first": F.min_by(v, o), "last": F.max_by(v, o)}[conflict]
    real = voxels.filter(v != fill).groupBy(by, "x", "y", "z").agg(rule.alias("v"), F.count("*").alias("sources"))
    return real if binarize is None or binarize is False else real.withColumn("v", _binarized(F.col("v"), binarize))


def same_geometry(headers: DataFrame, atol: float = 1e-5, rtol: float = 1e-5) -> DataFrame:
    """volume_id, same: whether shape, spacing and origin agree with the first volume's within numpy's tolerances."""
    first = headers.orderBy(KEY).limit(1).select(*[F.col(c).alias(f"_{c}") for c in ("nx", "ny", "nz", "spacing", "origin")])
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda t: t)
    shape = (F.col("nx") == F.col("_nx")) & (F.col("ny") == F.col("_ny")) & (F.col("nz") == F.col("_nz"))
    return headers.join(F.broadcast(first)).select(KEY, (shape & near("spacing", "_spacing") & near("origin", "_origin")).alias("same"))
