"""Feature results: complete columns, wide and long forms, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(long: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected (config, feature_name) for every key row; NaN where nothing was computed."""
    subjects = long.select(*keys).distinct()
    grid = subjects.join(F.broadcast(expected)) if not set(keys) & set(expected.columns) else subjects.join(F.broadcast(expected), [c for c in keys if c in expected.columns])
    on = [c for c in (*keys, "config", "feature_name") if c in grid.columns]
    return grid.join(long.select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def wide(long: DataFrame, subject: str = "subject_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each subject, one column config__feature for each pair; give the columns to save a pass that lists them."""
    named = long.select(subject, F.concat_ws("__", "config", "feature_name").alias("_c"), "value")
    return named.groupBy(subject).pivot("_c", columns).agg(F.first("value"))


def rows_by_config(long: DataFrame, subject: str = "subject_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each subject and configuration, one column for each feature."""
    return long.groupBy(subject, "config").pivot("feature_name", columns).agg(F.first("value"))


def unpivot(table: DataFrame, keys: list[str]) -> DataFrame:
    """Wide columns config__feature back to rows (keys, config, feature_name, value)."""
    rest = [c for c in table.columns if c not in keys]
    out = table.unpivot(keys, rest, "_c", "value")
    return out.select(*keys, F.substring_index("_c", "__", 1).alias("config"), F.expr("substring(_c, instr(_c, '__') + 2)").alias("feature_name"), "value")


def as_json(long: DataFrame, subject: str = "subject_id") -> DataFrame:
    """subject, json: {config: {feature: value}}."""
    one = long.groupBy(subject, "config").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature_name", "value")))).alias("m"))
    return one.groupBy(subject).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", F.to_json("m").alias("j")))))).alias("json"))


def save(df: DataFrame, path: str, file_format: str | None = None) -> None:
    """Writes csv, json or parquet, by the name's ending unless told; csv where it is unknown. Nested columns become JSON in csv."""
    kind = file_format or (path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else "csv")
    if kind not in ("csv", "json", "parquet"):
        kind = "csv"
    if kind == "csv":
        nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
        df = df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
        df.write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def run_log(long: DataFrame) -> DataFrame:
    """subject_id, config, family, features, missing, error: what a run did, for a log file."""
    return long.groupBy("subject_id", "config", "family").agg(F.count("*").alias("features"), F.count_if(F.isnan("value")).alias("missing"), F.max("error").alias("error"))
