"""Structured reports and segmentation objects as tables; loading by kind of path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.volumes import parse_dicom, read_dicom, read_nifti, seg_geometry, segments

# Storage classes of structured reports and segmentations.
SR_CLASSES = {
    "1.2.840.10008.5.1.4.1.1.88.11": "Basic Text SR", "1.2.840.10008.5.1.4.1.1.88.22": "Enhanced SR", "1.2.840.10008.5.1.4.1.1.88.33": "Comprehensive SR",
    "1.2.840.10008.5.1.4.1.1.88.34": "Comprehensive 3D SR", "1.2.840.10008.5.1.4.1.1.88.35": "Extensible SR", "1.2.840.10008.5.1.4.1.1.88.67": "X-Ray Radiation Dose SR",
}
SEG_CLASS = "1.2.840.10008.5.1.4.1.1.66.4"

_ITEMS = "file_path string, sop_instance_uid string, group_id string, container_path string, finding_type string, finding_site string, measurement_name string, value double, unit string, derivation string, tracking_id string, status string"


def is_sr(tags: dict) -> bool:
    return tags.get("SOPClassUID") in SR_CLASSES


def _meaning(item: dict, sequence: str, key: str = "CodeMeaning") -> str | None:
    got = item.get(sequence) or [{}]
    return got[0].get(key)


def _code(item: dict) -> str | None:
    return _meaning(item, "ConceptCodeSequence") or _meaning(item, "ConceptCodeSequence", "CodeValue")


def numeric_items(content: list[dict], path: tuple[str, ...] = ()) -> Iterator[dict]:
    """Every NUM item below a content sequence with its group: the container it lies in, or the empty one it follows, else `default`.

    Codes that name a type or a site, and texts that name a tracking id, hold for their whole group, wherever in it
    they stand; a measurement's own properties tell its derivation and, where its group has none, its site.
    """
    start = path[-1] if path else "default"
    outer = ({"group_id": start, "finding_type": path[-1] if path else None}, [])
    groups: list[tuple[dict, list[dict]]] = [outer]
    inner: list[dict] = []
    for item in content:
        kind, name = item.get("ValueType"), _meaning(item, "ConceptNameCodeSequence") or "Unknown"
        low = name.lower()
        about = groups[-1][0]
        if kind == "CONTAINER":
            below = item.get("ContentSequence") or []
            groups.append(outer if below else ({"group_id": name, "finding_type": name}, []))
            inner += numeric_items(below, (*path, name))
            continue
        if kind == "CODE":
            if "site" in low:
                about["finding_site"] = _code(item)
            elif "type" in low or low == "finding":
                about["finding_type"] = _code(item)
        elif kind in ("TEXT", "UIDREF") and "tracking" in low:
            about["tracking_id"] = item.get("TextValue") or item.get("UID")
        elif kind == "NUM":
            measured = (item.get("MeasuredValueSequence") or [{}])[0]
            try:
                value = float(measured.get("NumericValue"))
            except (TypeError, ValueError):
                value = None
            own = {"measurement_name": name, "value": value, "unit": _meaning(measured, "MeasurementUnitsCodeSequence", "CodeValue") or "1"}
            for x in item.get("ContentSequence") or []:
                what = (_meaning(x, "ConceptNameCodeSequence") or "").lower()
                if x.get("ValueType") == "CODE" and ("derivation" in what or "site" in what):
                    own["derivation" if "derivation" in what else "finding_site"] = _code(x)
            groups[-1][1].append(own)
        if kind != "NUM":
            inner += numeric_items(item.get("ContentSequence") or [], path)
    for about, items in [outer, *(g for g in groups if g is not outer)]:
        for own in items:
            yield {"container_path": "/".join(path), **own, **{k: v for k, v in about.items() if v is not None or k not in own}}
    yield from inner


def _binary(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.filter(F.substring("content", 129, 4) == F.lit(b"DICM"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Measurements of all structured reports below a path; a file that fails is one row whose status says why."""
    names = [p.split()[0] for p in _ITEMS.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tags = parse_dicom(raw, pixels=False)
                    if is_sr(tags):
                        rows += [{"file_path": p, "sop_instance_uid": tags.get("SOPInstanceUID"), "status": "ok", **m} for m in numeric_items(tags.get("ContentSequence") or [])]
                except Exception as e:  # one file's error leaves the others
                    rows.append({"file_path": p, "status": f"{type(e).__name__}: {e}"[:200]})
            kinds = [pa.float64() if n == "value" else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return _binary(spark, path).mapInArrow(parse, _ITEMS)


def summary(items: DataFrame) -> DataFrame:
    """One row for each report: numbers of measurements and groups."""
    return items.filter("status = 'ok'").groupBy("file_path", "sop_instance_uid").agg(F.count("*").alias("num_measurements"), F.countDistinct("group_id").alias("num_groups"))


def report_log(items: DataFrame) -> DataFrame:
    """One row for each file of read_reports: how many measurements it gave, and what failed."""
    return items.groupBy("file_path").agg(F.count_if(F.col("status") == "ok").alias("num_measurements"), F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("error"))


def combined(items: DataFrame) -> DataFrame:
    """The measurements of all reports as one table for export, in the order of files, groups and names."""
    return items.filter("status = 'ok'").drop("status").orderBy("file_path", "group_id", "measurement_name")


def read_segments(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """volume_id, segment, label, nx, ny, nz, spacing, origin, direction, mask, status of every segment of the segmentation
    objects below a path, with the object's geometry. A damaged file is one row whose status says why."""
    schema = "volume_id string, segment int, label string, nx int, ny int, nz int, spacing array<double>, origin array<double>, direction array<double>, mask array<int>, status string"
    doubles = pa.list_(pa.float64())
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), doubles, doubles, doubles, pa.list_(pa.int32()), pa.string())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tags = parse_dicom(raw, pixels=False)
                    if tags.get("SOPClassUID") != SEG_CLASS:
                        continue
                    at, names = seg_geometry(tags), {x["segment_number"]: x["segment_label"] for x in segment_info(raw)}
                    out = [(p, n, names.get(n), *m.shape, at["spacing"], at["origin"], at["direction"], m.reshape(-1), "ok") for n, m in segments(raw, wanted).items()]
                except Exception as e:  # one file's error leaves the others
                    out = [(p, *[None] * 9, f"{type(e).__name__}: {e}"[:200])]
                for row in out:
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return _binary(spark, path).mapInArrow(parse, schema)


def segment_volumes(masks: DataFrame) -> DataFrame:
    """Segments as volumes, whose voxels can be laid on a reference grid (operators.geometry.on_reference)."""
    return masks.filter("status = 'ok'").select(F.concat_ws("#", "volume_id", "segment").alias("volume_id"), "nx", "ny", "nz", "spacing", "origin", "direction", F.lit("SEG").alias("modality"), F.col("mask").cast("array<double>").alias("data"))


def segment_info(raw: bytes) -> list[dict]:
    """Number and label of each segment of a segmentation object."""
    tags = parse_dicom(raw, pixels=False)
    if tags.get("SOPClassUID") != SEG_CLASS:
        raise ValueError("not a segmentation object")
    return [{"segment_number": int(s["SegmentNumber"]), "segment_label": s.get("SegmentLabel", "")} for s in tags.get("SegmentSequence") or []]


def combined_labels(masks: DataFrame) -> DataFrame:
    """volume_id, x, y, z, label: the highest segment of each voxel that any covers."""
    at = masks.select("volume_id", "segment", "ny", "nz", F.posexplode("mask").alias("_at", "m")).filter("m > 0")
    return at.groupBy("volume_id", F.expr("_at div (ny * nz)").cast("int").alias("x"), F.expr("(_at div nz) % ny").cast("int").alias("y"), F.expr("_at % nz").cast("int").alias("z")).agg(F.max("segment").alias("label"))


def best_series_folder(spark: SparkSession, root: str) -> str | None:
    """The folder below root with the most DICOM files; among equal ones the first by name."""
    got = _binary(spark, root).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).count().orderBy(F.desc("count"), "folder").first()
    return got["folder"] if got else None


def load_volumes(spark: SparkSession, path: str, dataset_index: int = 0, rescale: bool = True) -> DataFrame:
    """Volumes below a path: NIfTI by name, else segmentations and DICOM series. dataset_index is the volume of a 4-D file, or the phase of a series."""
    if dataset_index < 0:
        raise ValueError("the dataset index must not be negative")
    if re.search(r"\.nii(\.gz)?$|\.nii\*", path):
        return read_nifti(spark, path, dataset_index)
    images = read_dicom(spark, path, rescale, dataset_index)
    masks = segment_volumes(read_segments(spark, path))
    return images.unionByName(masks)
