"""Volumes: one row each, with a dense array in C order, and their voxel tables; readers of NIfTI-1 and DICOM files.

volume_id, nx, ny, nz, spacing, origin, direction, modality, data; data[(x * ny + y) * nz + z].
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "volume_id string, nx int, ny int, nz int, spacing array<double>, origin array<double>, direction array<double>, modality string, data array<double>"


def embedding_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 numbers of each vector as a 4x4x4 volume, its label as cohort."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ones, zeros = F.array(*[F.lit(1.0)] * 3), F.array(*[F.lit(0.0)] * 3)
    return e.select(
        F.col("vec_id").alias("volume_id"), F.lit(4).alias("nx"), F.lit(4).alias("ny"), F.lit(4).alias("nz"), ones.alias("spacing"), zeros.alias("origin"),
        F.col("embedding").cast("array<double>").alias("data"), F.col("label").alias("cohort"),
    )


def grouped_volumes(rows: DataFrame, by: str, order: list[str], value: str, inside: str, plane: tuple[int, int] = (5, 5), spacing: tuple[float, ...] = (2.0, 1.0, 1.0)) -> DataFrame:
    """The values of each group, in order, as a volume of as many whole planes as they fill: groups give different shapes.

    `inside` is the condition for a voxel to lie in the masks, so those are irregular.
    """
    size = plane[0] * plane[1]
    listed = rows.groupBy(F.col(by).cast("long").alias("volume_id")).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v"), F.expr(inside).cast("int").alias("_m")))).alias("_l"))
    nx = F.floor(F.size("_l") / size).cast("int")
    kept = listed.select("volume_id", nx.alias("nx"), F.slice("_l", 1, nx * size).alias("_l")).filter("nx > 0")
    mask = F.transform("_l", lambda e: e["_m"])
    three = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return kept.select("volume_id", "nx", F.lit(plane[0]).alias("ny"), F.lit(plane[1]).alias("nz"), three(spacing).alias("spacing"), three((0, 0, 0)).alias("origin"), F.transform("_l", lambda e: e["_v"]).alias("data"), mask.alias("morph"), mask.alias("intensity"))


def voxels(volumes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """volume_id, x, y, z, v, morph_mask, intensity_mask; masks are 1 unless the volumes carry mask arrays."""
    at = F.col("_at")
    masks = [c for c in ("morph", "intensity") if c in volumes.columns]
    out = volumes.select("volume_id", "ny", "nz", *keep, *masks, F.posexplode("data").alias("_at", "v"))
    mask = lambda c: (F.get(F.col(c), at) if c in masks else F.lit(1)).alias(f"{c}_mask")
    return out.select(
        "volume_id", *keep, F.expr("_at div (ny * nz)").cast("int").alias("x"), F.expr("(_at div nz) % ny").cast("int").alias("y"), F.expr("_at % nz").cast("int").alias("z"),
        "v", mask("morph"), mask("intensity"),
    )


# --- NIfTI-1 ---------------------------------------------------------------------------------------------------

# Data types of the format.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def parse_nifti(raw: bytes, dataset_index: int = 0) -> dict:
    """Array (x, y, z) of float64, spacing, origin and direction of a NIfTI-1 file, zipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    end = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(end + "i", raw[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack(end + "8h", raw[40:56])
    code = struct.unpack(end + "h", raw[70:72])[0]
    zoom = struct.unpack(end + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(end + "3f", raw[108:120])
    shape = [max(1, n) for n in dim[1 : 1 + dim[0]]]
    x = np.frombuffer(raw, end + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    if slope and np.isfinite(slope):
        x = x * slope + inter
    while x.ndim < 3:
        x = x[..., None]
    if x.ndim > 3:
        x = x.reshape(*x.shape[:3], -1)
        if not 0 <= dataset_index < x.shape[3]:
            raise ValueError(f"dataset {dataset_index} is out of range")
        x = x[..., dataset_index]
    qform, sform = struct.unpack(end + "2h", raw[252:256])
    if sform > 0:
        affine = np.array(struct.unpack(end + "12f", raw[280:328])).reshape(3, 4)
    elif qform > 0:
        b, c, d, *q = struct.unpack(end + "6f", raw[256:280])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine = np.column_stack([r * np.array([zoom[1], zoom[2], zoom[3] * (-1 if zoom[0] < 0 else 1)]), q])
    else:
        affine = np.column_stack([np.diag(zoom[1:4]), np.zeros(3)])
    spacing = [float(z) if i < dim[0] and z else 1.0 for i, z in enumerate(zoom[1:4])]
    return {"data": x, "spacing": spacing, "origin": affine[:, 3].tolist(), "direction": affine[:, :3].reshape(-1).tolist(), "modality": "Nifti"}


# --- DICOM -----------------------------------------------------------------------------------------------------

_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UT", b"UN", b"UC", b"UR"}
_NUMBERS = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
# Tags that are read, by keyword.
TAGS = {
    (0x0008, 0x0016): "SOPClassUID", (0x0008, 0x0018): "SOPInstanceUID", (0x0008, 0x0020): "StudyDate", (0x0008, 0x0021): "SeriesDate", (0x0008, 0x0030): "StudyTime",
    (0x0008, 0x0060): "Modality", (0x0008, 0x1030): "StudyDescription", (0x0008, 0x103E): "SeriesDescription", (0x0010, 0x0010): "PatientName", (0x0010, 0x0020): "PatientID",
    (0x0018, 0x0050): "SliceThickness", (0x0018, 0x0086): "EchoNumbers", (0x0018, 0x0088): "SpacingBetweenSlices", (0x0018, 0x1060): "TriggerTime", (0x0018, 0x9241): "NominalPercentageOfCardiacPhase",
    (0x0020, 0x000D): "StudyInstanceUID", (0x0020, 0x000E): "SeriesInstanceUID", (0x0020, 0x0011): "SeriesNumber", (0x0020, 0x0012): "AcquisitionNumber", (0x0020, 0x0013): "InstanceNumber",
    (0x0020, 0x0032): "ImagePositionPatient", (0x0020, 0x0037): "ImageOrientationPatient", (0x0020, 0x0100): "TemporalPositionIdentifier", (0x0020, 0x1041): "SliceLocation",
    (0x0028, 0x0002): "SamplesPerPixel", (0x0028, 0x0008): "NumberOfFrames", (0x0028, 0x0010): "Rows", (0x0028, 0x0011): "Columns", (0x0028, 0x0030): "PixelSpacing",
    (0x0028, 0x0100): "BitsAllocated", (0x0028, 0x0103): "PixelRepresentation", (0x0028, 0x1052): "RescaleIntercept", (0x0028, 0x1053): "RescaleSlope", (0x7FE0, 0x0010): "PixelData",
}
SEQUENCES = {
    (0x0040, 0xA730): "ContentSequence", (0x0040, 0xA043): "ConceptNameCodeSequence", (0x0040, 0xA300): "MeasuredValueSequence", (0x0040, 0x08EA): "MeasurementUnitsCodeSequence",
    (0x0040, 0xA168): "ConceptCodeSequence", (0x5200, 0x9229): "SharedFunctionalGroupsSequence", (0x5200, 0x9230): "PerFrameFunctionalGroupsSequence", (0x0062, 0x0002): "SegmentSequence",
    (0x0028, 0x9110): "PixelMeasuresSequence", (0x0020, 0x9116): "PlaneOrientationSequence", (0x0020, 0x9113): "PlanePositionSequence", (0x0062, 0x000A): "SegmentIdentificationSequence",
    (0x0020, 0x9111): "FrameContentSequence",
}
MORE = {
    (0x0040, 0xA040): "ValueType", (0x0040, 0xA30A): "NumericValue", (0x0008, 0x0100): "CodeValue", (0x0008, 0x0104): "CodeMeaning", (0x0040, 0xA160): "TextValue",
    (0x0040, 0xA124): "UID", (0x0062, 0x0004): "SegmentNumber", (0x0062, 0x0005): "SegmentLabel", (0x0062, 0x000B): "ReferencedSegmentNumber", (0x0020, 0x9157): "DimensionIndexValues",
}
NAMES = TAGS | SEQUENCES | MORE


def is_dicom(raw: bytes) -> bool:
    return raw[128:132] == b"DICM"


def parse_dicom(raw: bytes, pixels: bool = True, private: bool = False) -> dict:
    """Elements by keyword of an uncompressed little-endian file; sequences are lists of such tables."""
    if not is_dicom(raw):
        raise ValueError("not a DICOM file")
    at, explicit = 132, True
    syntax = ""
    out: dict = {}
    while at + 8 <= len(raw) and raw[at : at + 2] == b"\x02\x00":
        (_, tag, value, at) = _element(raw, at, True, True, private)
        if tag == (2, 0x10):
            syntax = value.decode().strip("\0 ")
    explicit = syntax != "1.2.840.10008.1.2"
    if syntax not in ("", "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"):
        out["TransferSyntaxUID"] = syntax
    _items(raw, at, len(raw), explicit, pixels, private, out)
    return out


def _element(raw: bytes, at: int, explicit: bool, pixels: bool, private: bool) -> tuple:
    group, elem = struct.unpack("<HH", raw[at : at + 4])
    vr = b""
    if explicit and group != 0xFFFE:
        vr = raw[at + 4 : at + 6]
        if vr in _LONG:
            size, at = struct.unpack("<I", raw[at + 8 : at + 12])[0], at + 12
        else:
            size, at = struct.unpack("<H", raw[at + 6 : at + 8])[0], at + 8
    else:
        size, at = struct.unpack("<I", raw[at + 4 : at + 8])[0], at + 8
    tag = (group, elem)
    if vr == b"SQ" or tag in SEQUENCES or size == 0xFFFFFFFF:
        items, at = _sequence(raw, at, size, explicit, pixels, private)
        return vr, tag, items, at
    return vr, tag, raw[at : at + size], at + size


def _sequence(raw: bytes, at: int, size: int, explicit: bool, pixels: bool, private: bool) -> tuple[list, int]:
    items: list = []
    end = len(raw) if size == 0xFFFFFFFF else at + size
    while at + 8 <= end:
        group, elem, n = struct.unpack("<HHI", raw[at : at + 8])
        at += 8
        if (group, elem) == (0xFFFE, 0xE0DD):
            break
        if (group, elem) != (0xFFFE, 0xE000):
            break
        item: dict = {}
        at = _items(raw, at, end if n == 0xFFFFFFFF else at + n, explicit, pixels, private, item)
        items.append(item)
    return items, at


def _items(raw: bytes, at: int, end: int, explicit: bool, pixels: bool, private: bool, out: dict) -> int:
    while at + 8 <= end:
        if raw[at : at + 4] == b"\xfe\xff\x0d\xe0":
            return at + 8
        vr, tag, value, at = _element(raw, at, explicit, pixels, private)
        name = NAMES.get(tag) or (f"Private_{tag[0]:04X}_{tag[1]:04X}" if private and tag[0] % 2 else None)
        if name is None or (name == "PixelData" and not pixels):
            continue
        out[name] = value if name == "PixelData" or isinstance(value, list) else _value(value, vr, name)
    return at


def _value(raw: bytes, vr: bytes, name: str):  # noqa: ANN202
    if vr in _NUMBERS or (not vr and name in ("Rows", "Columns", "BitsAllocated", "PixelRepresentation", "SamplesPerPixel", "SegmentNumber", "ReferencedSegmentNumber")):
        kind = _NUMBERS.get(vr, "H")
        n = struct.calcsize(kind)
        got = [v[0] for v in struct.iter_unpack("<" + kind, raw[: len(raw) // n * n])]
        return got[0] if len(got) == 1 else got
    return raw.decode("latin-1").strip("\0 ")


def numbers(text: str | None) -> list[float] | None:
    try:
        return [float(x) for x in text.split("\\")] if text else None
    except ValueError:
        return None


def slice_array(tags: dict) -> np.ndarray:
    """(frames, rows, columns) of an uncompressed image."""
    bits, signed = int(tags.get("BitsAllocated", 16)), int(tags.get("PixelRepresentation", 0))
    frames = int(tags.get("NumberOfFrames") or 1)
    shape = (frames, int(tags["Rows"]), int(tags["Columns"]))
    if bits == 1:
        return np.unpackbits(np.frombuffer(tags["PixelData"], np.uint8), bitorder="little")[: int(np.prod(shape))].reshape(shape)
    return np.frombuffer(tags["PixelData"], f"<{'i' if signed else 'u'}{bits // 8}", int(np.prod(shape))).reshape(shape)


def series_volume(files: list[bytes], rescale: bool = True) -> dict:
    """One volume of the slices of a series: sorted along their normal (else by instance number), first slice's rescale."""
    slices = [parse_dicom(f) for f in files]
    way = next((numbers(s.get("ImageOrientationPatient")) for s in slices if s.get("ImageOrientationPatient")), None) or [1, 0, 0, 0, 1, 0]
    row, col = np.array(way[:3]), np.array(way[3:])
    normal = np.cross(row, col)
    place = [numbers(s.get("ImagePositionPatient")) for s in slices]
    if all(p is not None for p in place):
        order = sorted(range(len(slices)), key=lambda i: float(np.dot(place[i], normal)))
    else:
        order = sorted(range(len(slices)), key=lambda i: int(float(slices[i].get("InstanceNumber") or 0)))
    slices, place = [slices[i] for i in order], [place[i] for i in order]
    first = slices[0]
    x = np.concatenate([slice_array(s) for s in slices]).transpose(2, 1, 0)
    slope, inter = float(first.get("RescaleSlope") or 1), float(first.get("RescaleIntercept") or 0)
    if rescale and (slope, inter) != (1.0, 0.0):
        x = x.astype(float) * slope + inter
    gap = next((float(first[k]) for k in ("SpacingBetweenSlices", "SliceThickness") if first.get(k)), None)
    if gap is None:
        gap = float(np.linalg.norm(np.subtract(place[1], place[0]))) if len(slices) > 1 and place[0] and place[1] else 1.0
    dy, dx = (numbers(first.get("PixelSpacing")) or [1.0, 1.0])[:2]
    return {"data": x, "spacing": [dx, dy, gap], "origin": place[0] or [0.0, 0.0, 0.0], "direction": np.column_stack([row, col, normal]).reshape(-1).tolist(), "modality": first.get("Modality") or "Unknown"}


def segments(raw: bytes, wanted: list[int] | None = None) -> dict[int, np.ndarray]:
    """Binary masks (x, y, z) of a segmentation object by segment number; an unknown number is an error."""
    tags = parse_dicom(raw)
    frames = slice_array(tags)
    groups = tags.get("PerFrameFunctionalGroupsSequence") or []
    of = [int(g["SegmentIdentificationSequence"][0]["ReferencedSegmentNumber"]) for g in groups]
    # Of several segments the first index tells the slice; where it tells the segment instead, the last one does.
    first = [(g.get("FrameContentSequence") or [{}])[0].get("DimensionIndexValues") for g in groups]
    stack = all(isinstance(x, list) and len(x) > 1 for x in first) and [int(x[0]) for x in first] == of and len(set(of)) < len(of)
    at = []
    for i, g in enumerate(groups):
        index = (g.get("FrameContentSequence") or [{}])[0].get("DimensionIndexValues")
        index = index if isinstance(index, list) else [index] if index else [i + 1]
        at.append(int(index[-1] if stack else index[0]) - 1)
    known = sorted(set(of))
    for n in wanted or []:
        if n not in known:
            raise ValueError(f"no segment {n}")
    depth = max(at, default=-1) + 1
    out = {n: np.zeros((frames.shape[2], frames.shape[1], depth), np.uint8) for n in (wanted or known)}
    for f, n, z in zip(frames, of, at, strict=True):
        if n in out:
            out[n][:, :, z] = np.maximum(out[n][:, :, z], (f > 0).T)
    return out


def seg_geometry(tags: dict) -> dict:
    """Spacing, origin and direction of a segmentation object, from its shared and per-frame groups."""
    shared = (tags.get("SharedFunctionalGroupsSequence") or [{}])[0]
    measures = (shared.get("PixelMeasuresSequence") or [{}])[0]
    rows = numbers(measures.get("PixelSpacing")) or [1.0, 1.0]
    spacing = [rows[1], rows[0], (numbers(measures.get("SliceThickness")) or [1.0])[0] or 1.0]
    way = numbers((shared.get("PlaneOrientationSequence") or [{}])[0].get("ImageOrientationPatient"))
    direction = np.column_stack([way[:3], way[3:6], np.cross(way[:3], way[3:6])]).reshape(-1).tolist() if way else None
    place = [numbers((g.get("PlanePositionSequence") or [{}])[0].get("ImagePositionPatient")) for g in tags.get("PerFrameFunctionalGroupsSequence") or []]
    origin = place[0] if place and place[0] else [0.0, 0.0, 0.0]
    place = [p for p in place if p]
    if len(place) > 1:
        gap = float(np.median(np.linalg.norm(np.diff(np.array(place), axis=0), axis=1)))
        spacing[2] = gap if gap > 0 else spacing[2]
    return {"spacing": spacing, "origin": origin, "direction": direction}


def _row(key: str, v: dict) -> pa.RecordBatch:
    x = np.ascontiguousarray(v["data"], float)
    cols = [[key], *[[n] for n in x.shape], [list(map(float, v["spacing"]))], [list(map(float, v["origin"]))], [list(map(float, v["direction"])) if v["direction"] is not None else None], [v["modality"]]]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.string()]
    data = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.reshape(-1)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), data], names=[p.split()[0] for p in SCHEMA.split(", ")])


def read_nifti(spark: SparkSession, path: str, dataset_index: int = 0) -> DataFrame:
    """One row for each .nii or .nii.gz file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _row(p, parse_nifti(raw, dataset_index))

    return files.mapInArrow(parse, SCHEMA)


def read_dicom(spark: SparkSession, path: str, rescale: bool = True, dataset_index: int = 0) -> DataFrame:
    """One row for each series below a path: the volume of its phase number dataset_index, counted from 0.

    Phases are told apart by headers alone (operators.metadata.split_phases); then the files of a phase, and no more,
    meet in one task. Files that aren't readable are left out, as read_headers says; reports and segmentations are no
    images. A series with fewer phases is an error.
    """
    from voxframe.operators import metadata

    split = metadata.split_phases(metadata.instances(read_headers(spark, path).filter("status = 'ok'").filter(~F.coalesce(F.col("tags")["SOPClassUID"], F.lit("")).rlike(r"^1\.2\.840\.10008\.5\.1\.4\.1\.1\.(66\.4|88\.)"))))
    most = split.groupBy("series_uid").agg(F.max("phase").alias("phases"))
    few = F.raise_error(F.concat(F.lit(f"dataset index {dataset_index} is out of range: the series has phases "), F.col("phases").cast("string")))
    kept = most.select("series_uid", F.when(F.col("phases") > dataset_index, F.lit(dataset_index + 1)).otherwise(few.cast("int")).alias("_phase"))
    wanted = split.join(kept, "series_uid").filter(F.col("phase") == F.col("_phase")).select("series_uid", F.col("file_path").alias("_path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").filter(F.substring("content", 129, 4) == F.lit(b"DICM"))

    def build(table: pa.Table) -> pa.Table:
        key = table.column("series")[0].as_py()
        return pa.Table.from_batches([_row(key, series_volume(table.column("content").to_pylist(), rescale))])

    return files.join(wanted, F.col("path") == F.col("_path")).select(F.col("series_uid").alias("series"), "content").groupBy("series").applyInArrow(build, SCHEMA)


def read_headers(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """file_path, a map of tags, and a status of each DICOM file below a path, without pixels. A damaged file has no tags, and its status says why."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").filter(F.substring("content", 129, 4) == F.lit(b"DICM"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, status = [], []
            for raw in b.column(1).to_pylist():
                try:
                    tags = parse_dicom(raw, pixels=False, private=private)
                    flat.append([(k, str(v)) for k, v in tags.items() if not isinstance(v, (list, bytes))])
                    status.append("ok")
                except Exception as e:  # one file's error leaves the others
                    flat.append([])
                    status.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.map_(pa.string(), pa.string())), pa.array(status)], names=["file_path", "tags", "status"])

    return files.mapInArrow(parse, "file_path string, tags map<string,string>, status string")
