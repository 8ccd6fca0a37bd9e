"""Imaging metadata: hierarchy roll-ups, completeness of series, phases, and structured measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tags that tell the phases of a series apart, in the order in which they are tried.
PHASE_TAGS = ("NominalPercentageOfCardiacPhase", "TemporalPositionIdentifier", "TriggerTime", "AcquisitionNumber", "EchoNumber", "EchoNumbers")


def instances(headers: DataFrame) -> DataFrame:
    """The flat instance table of (file_path, tags): the last file of a SOP instance counts. Files without tags are left out."""
    headers = headers.filter(F.size("tags") > 0)
    tag = lambda k: F.col("tags").getItem(k)
    nums = lambda k: F.transform(F.split(tag(k), r"\\"), lambda x: x.try_cast("double"))
    d = headers.select(
        tag("PatientID").alias("patient_id"), tag("StudyInstanceUID").alias("study_uid"), tag("SeriesInstanceUID").alias("series_uid"), tag("SOPInstanceUID").alias("sop_uid"), "file_path",
        tag("InstanceNumber").try_cast("int").alias("instance_number"), nums("ImagePositionPatient").alias("position"), nums("ImageOrientationPatient").alias("orientation"),
        tag("SliceLocation").try_cast("double").alias("slice_location"), tag("Modality").alias("modality"), tag("StudyDate").alias("study_date"), tag("StudyTime").alias("study_time"), "tags",
    )
    o = lambda i: F.get("orientation", F.lit(i))
    normal = [o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)]
    score = sum((F.get("position", F.lit(i)) * n for i, n in enumerate(normal)), F.lit(0.0))
    d = d.withColumn("projection_score", score)
    last = d.groupBy("sop_uid").agg(F.max_by(F.struct(*d.columns), "file_path").alias("r"))
    return last.select("r.*")


def combine_datetime(date: Column, time: Column) -> Column:
    """date, or dateTtime; null without a date."""
    return F.when(date.isNotNull(), F.concat_ws("T", date, time))


def patients(inst: DataFrame) -> DataFrame:
    return inst.groupBy("patient_id").agg(
        F.countDistinct("study_uid").alias("num_studies"), F.countDistinct("series_uid").alias("num_series"), F.count("*").alias("num_instances"),
        F.min("study_date").alias("earliest_study_date"), F.max("study_date").alias("latest_study_date"),
    )


def studies(inst: DataFrame) -> DataFrame:
    return inst.groupBy("patient_id", "study_uid").agg(
        F.countDistinct("series_uid").alias("num_series"), F.count("*").alias("num_instances"), F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("modalities"), F.min("study_date").alias("study_date"),
    )


def series(inst: DataFrame) -> DataFrame:
    return inst.groupBy("patient_id", "study_uid", "series_uid").agg(F.count("*").alias("num_instances"), F.min("modality").alias("modality"))


def file_paths(inst: DataFrame, by: str = "series_uid") -> DataFrame:
    """The files of each group, sorted along the slices."""
    order = F.struct(F.coalesce("projection_score", F.col("instance_number").cast("double"), F.lit(float("inf"))).alias("at"), "file_path")
    return inst.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["file_path"]).alias("file_paths"))


def common_tags(inst: DataFrame, by: str) -> DataFrame:
    """by, key, value of the tags that all rows of a group have, with one value."""
    n = inst.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    tags = inst.select(by, F.explode("tags").alias("key", "value")).groupBy(by, "key").agg(F.count("value").alias("_c"), F.min("value").alias("value"), F.max("value").alias("_max"))
    return tags.join(n, F.col(by) == F.col("_by")).filter((F.col("_c") == F.col("_n")) & (F.col("value") == F.col("_max"))).select(by, "key", "value")


def completeness(inst: DataFrame, by: str = "series_uid", at: str = "projection_score", tolerance: float = 0.1) -> DataFrame:
    """Spacing of the slices of each group: median, whether it is even, and the gaps wider than 1.5 * (1 + tolerance) of it."""
    w = W.partitionBy(by).orderBy(at)
    gap = inst.filter(F.col(at).isNotNull()).select(by, at, (F.col(at) - F.lag(at).over(w)).alias("gap"))
    s = gap.groupBy(by).agg(F.count("*").alias("n"), F.median("gap").alias("median_gap"), F.stddev_pop("gap").alias("_std"), F.avg("gap").alias("_mean"))
    s = s.withColumnRenamed(by, "_by")
    wide = gap.join(s, F.col(by) == F.col("_by")).filter(F.col("gap") > F.col("median_gap") * (1 + tolerance) * 1.5).groupBy(by).agg(F.count("*").alias("_gaps"))
    out = s.join(wide, F.col(by) == F.col("_by"), "left")
    even = F.coalesce(F.try_divide(F.col("_std"), F.col("_mean")) < tolerance, F.lit(True))
    return out.select(F.col("_by").alias(by), "n", "median_gap", even.alias("is_even"), F.coalesce("_gaps", F.lit(0)).alias("num_gaps"), (F.coalesce("_gaps", F.lit(0)) == 0).alias("is_complete"))


def missing_numbers(inst: DataFrame, by: str = "series_uid", number: str = "instance_number") -> DataFrame:
    """by, missing: the instance numbers between the least and the greatest that no row has."""
    ends = inst.groupBy(by).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.collect_set(number).alias("_have"))
    return ends.select(by, F.explode(F.array_except(F.sequence("_lo", "_hi"), "_have")).alias("missing"))


def split_phases(inst: DataFrame, by: str = "series_uid", tags: tuple[str, ...] = PHASE_TAGS) -> DataFrame:
    """Adds split_tag, phase and phase_uid: by the first tag with several values that all rows of the group have,

    else by turns where slices share a position, else one phase. Several phases give the uid a suffix.
    """
    aggs = [F.count("*").alias("_n")]
    for i, t in enumerate(tags):
        v = F.col("tags").getItem(t)
        aggs += [F.countDistinct(v).alias(f"_d{i}"), F.count(v).alias(f"_c{i}")]
    aggs += [F.countDistinct("projection_score").alias("_pos"), F.count("projection_score").alias("_posn")]
    which = F.lit(None).cast("string")
    g = inst.groupBy(by).agg(*aggs)
    for i, t in reversed(list(enumerate(tags))):
        which = F.when((F.col(f"_d{i}") > 1) & (F.col(f"_c{i}") == F.col("_n")), F.lit(t)).otherwise(which)
    g = g.select(F.col(by).alias("_by"), which.alias("split_tag"), (F.col("_pos") < F.col("_posn")).alias("_shared"))
    out = inst.join(g, F.col(by) == F.col("_by")).drop("_by")
    value = F.col("tags").getItem(F.col("split_tag"))
    number = value.try_cast("double")
    by_tag = F.dense_rank().over(W.partitionBy(by).orderBy(number, value))
    by_turn = F.row_number().over(W.partitionBy(by, "projection_score").orderBy("instance_number", "sop_uid"))
    out = out.withColumn("phase", F.when(F.col("split_tag").isNotNull(), by_tag).when(F.col("_shared"), by_turn).otherwise(1))
    many = F.max("phase").over(W.partitionBy(by)) > 1
    return out.withColumn("phase_uid", F.when(many, F.concat_ws(".", F.col(by), F.col("phase").cast("string"))).otherwise(F.col(by))).drop("_shared")


def phases(split: DataFrame, by: str = "series_uid") -> DataFrame:
    """One row for each phase with its label, files and split."""
    label = F.when(F.col("split_tag") == "NominalPercentageOfCardiacPhase", F.concat(F.lit("Phase "), F.col("_v"), F.lit("%"))).when(
        F.col("split_tag").isNotNull(), F.concat_ws(" ", "split_tag", "_v")
    ).otherwise(F.concat(F.lit("Phase "), F.col("phase").cast("string")))
    g = split.withColumn("_v", F.col("tags").getItem(F.col("split_tag"))).groupBy(by, "phase", "phase_uid", "split_tag").agg(F.count("*").alias("num_slices"), F.min("_v").alias("_v"), F.sort_array(F.collect_list("file_path")).alias("file_paths"))
    return g.select(by, "phase", "phase_uid", "num_slices", label.alias("label"), "split_tag", F.col("_v").alias("split_value"), "file_paths")


def measurements(items: DataFrame, text: str, document: str, group: str = "group_id") -> DataFrame:
    """Flat measurements of a JSON object of name to number in each row; units default to 1, names to Unknown."""
    pairs = F.explode(F.from_json(F.col(text), "map<string,string>")).alias("measurement_name", "raw")
    flat = items.select(document, group, pairs)
    return flat.select(document, group, F.coalesce(F.nullif("measurement_name", F.lit("")), F.lit("Unknown")).alias("measurement_name"), F.col("raw").try_cast("double").alias("value"), F.lit("1").alias("unit"))


def database(headers: DataFrame, split_multiseries: bool = True) -> dict[str, DataFrame]:
    """The four levels of a folder's headers: patients, studies, series, instances. Phases of a series are series of their own unless told."""
    inst = instances(headers)
    if split_multiseries:
        split = split_phases(inst)
        inst = split.withColumn("series_uid", F.col("phase_uid")).select(*inst.columns)
    return {"patients": patients(inst), "studies": studies(inst), "series": series(inst), "instances": inst}


def nested(inst: DataFrame) -> DataFrame:
    """patient_id and one JSON document of its studies, series and instances; a document is as large as its patient."""
    leaf = F.struct("sop_uid", "instance_number", "file_path")
    s = inst.groupBy("patient_id", "study_uid", "series_uid").agg(F.min("modality").alias("modality"), F.sort_array(F.collect_list(leaf)).alias("instances"))
    t = s.groupBy("patient_id", "study_uid").agg(F.sort_array(F.collect_list(F.struct("series_uid", "modality", "instances"))).alias("series"))
    p = t.groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("study_uid", "series"))).alias("studies"))
    return p.select("patient_id", F.to_json(F.struct("patient_id", "studies")).alias("document"))
