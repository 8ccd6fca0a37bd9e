"""The 174 features: family and key, in the order of their families."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from voxframe.functions.intensity import HISTOGRAM, INTENSITY, IVH
from voxframe.functions.texture import NAMES

# Published names of the families without a shared table.
SPATIAL = ["morans_i_index_N365", "gearys_c_measure_NPT7"]
LOCAL = ["global_intensity_peak_0F91", "local_intensity_peak_VJGA"]
MORPHOLOGY = [
    "volume_voxel_counting_YEKZ", "surface_area_C0JK", "volume_RNU0", "surface_to_volume_ratio_2PR5", "compactness_1_SKGS", "compactness_2_BQWJ", "spherical_disproportion_KRCK",
    "sphericity_QCFX", "asphericity_25C7", "major_axis_length_TDIC", "minor_axis_length_P9VJ", "least_axis_length_7J51", "elongation_Q3CK", "flatness_N17B", "volume_density_aee_6BDE",
    "area_density_aee_RDD2", "volume_density_convex_hull_R3ER", "area_density_convex_hull_7T7F", "maximum_3d_diameter_L0JK", "volume_density_aabb_PBX1", "area_density_aabb_R59B",
    "volume_density_ombb_ZH1A", "area_density_ombb_IQYR", "volume_density_mvee_SWZ1", "area_density_mvee_BRI8", "integrated_intensity_99N0", "center_of_mass_shift_KLMA",
]
GLCM = [
    "joint_maximum_GYBY", "joint_average_60VM", "joint_variance_UR99", "joint_entropy_TU9B", "difference_average_TF7R", "difference_variance_D3YU", "difference_entropy_NTRS", "sum_average_ZGXS",
    "sum_variance_OEEB", "sum_entropy_P6QZ", "angular_second_moment_8ZQL", "contrast_ACUI", "dissimilarity_8S9J", "inverse_difference_IB1Z", "normalised_inverse_difference_NDRX",
    "inverse_difference_moment_WF0Z", "normalised_inverse_difference_moment_1QCO", "inverse_variance_E8JP", "correlation_NI2N", "autocorrelation_QWB0", "cluster_tendency_DG8W",
    "cluster_shade_7NFM", "cluster_prominence_AE86", "information_correlation_1_R8DG", "information_correlation_2_JN9H",
]
NGTDM = ["coarseness_QCDE", "contrast_65HE", "busyness_NQ30", "complexity_HDEZ", "strength_1X9X"]

FAMILIES: dict[str, list[str]] = {
    "intensity": list(INTENSITY.values()), "histogram": list(HISTOGRAM.values()), "ivh": list(IVH.values()), "spatial_intensity": SPATIAL, "local_intensity": LOCAL, "morphology": MORPHOLOGY,
    "glcm": GLCM, "glrlm": list(NAMES["glrlm"].values()), "glszm": list(NAMES["glszm"].values()), "gldzm": list(NAMES["gldzm"].values()), "ngtdm": NGTDM, "ngldm": list(NAMES["ngldm"].values()),
}
TEXTURE = ("glcm", "glrlm", "glszm", "gldzm", "ngtdm", "ngldm")


def expand(families: list[str], spatial: bool = False, local: bool = False) -> list[str]:
    """Family names with `texture` spelt out, and what the intensity flags include."""
    out: list[str] = []
    for f in families:
        out += TEXTURE if f == "texture" else [f]
    out += ["spatial_intensity"] * spatial + ["local_intensity"] * local
    for f in out:
        if f not in FAMILIES:
            raise ValueError(f"no feature family {f}")
    return list(dict.fromkeys(out))


def parts(key: str) -> tuple[str, str]:
    """The plain name of a feature and its published code, which some keys follow by a number."""
    m = re.search(r"_([A-Z0-9]{3,4})(?:_\d+)?$", key)
    return (key[: m.start()], m[1]) if m else (key, "")


def describe(spark: SparkSession) -> DataFrame:
    """ord, family, feature_name, code of every feature."""
    rows = [(f, k) for f, keys in FAMILIES.items() for k in keys]
    return spark.createDataFrame([(i, f, k, parts(k)[1]) for i, (f, k) in enumerate(rows)], "ord int, family string, feature_name string, code string")
