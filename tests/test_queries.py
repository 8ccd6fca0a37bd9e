"""Every engine query against its SQL on the small tables; results of sources that the tables don't have."""

import math
import struct

import numpy as np
import pytest

from voxframe import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE_SQL])
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    r = duck("sf0.001").execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(got.columns)
    mine = sorted((tuple(plain(x[c]) for c in names) for x in got.collect()), key=repr)
    assert mine == sorted((tuple(map(plain, x)) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["morphology_features", "shared_plan"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(5).count() == 5


def nifti(data, slope=2.0, inter=1.0):
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", h, 70, 4, 16)
    struct.pack_into("<8f", h, 76, 1, 0.5, 0.75, 2, 1, 1, 1, 1)
    struct.pack_into("<3f", h, 108, 352, slope, inter)
    struct.pack_into("<2h", h, 252, 0, 1)
    struct.pack_into("<12f", h, 280, 0.5, 0, 0, -10, 0, 0.75, 0, -20, 0, 0, 2, 30)
    return bytes(h) + data.astype("<i2").tobytes(order="F")


def test_nifti(spark, tmp_path):
    from voxframe.sources.volumes import read_nifti

    x = np.arange(24).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(nifti(x))
    r = read_nifti(spark, str(tmp_path)).first()
    assert (r.nx, r.ny, r.nz) == (2, 3, 4) and r.data == (x.reshape(-1) * 2.0 + 1).tolist() and r.spacing == [0.5, 0.75, 2.0] and r.origin == [-10, -20, 30]


def element(group, elem, vr, value):
    value = value if isinstance(value, bytes) else value.encode()
    value += b"\0" * (len(value) % 2)
    if vr in ("OW", "SQ"):
        return struct.pack("<HH2sHI", group, elem, vr.encode(), 0, len(value)) + value
    return struct.pack("<HH2sH", group, elem, vr.encode(), len(value)) + value


def item(*parts):
    body = b"".join(parts)
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body


HEAD = b"\0" * 128 + b"DICM" + element(2, 0x10, "UI", "1.2.840.10008.1.2.1")


def ct(k, series="1.2"):
    pixels = np.full((2, 3), k, "<i2")
    return HEAD + b"".join([
        element(8, 0x18, "UI", f"9.{k}"), element(8, 0x20, "DA", "20240101"), element(8, 0x60, "CS", "CT"), element(0x10, 0x20, "LO", "P1"), element(0x20, 0xD, "UI", "1"), element(0x20, 0xE, "UI", series),
        element(0x20, 0x13, "IS", str(k)), element(0x20, 0x32, "DS", f"1\\2\\{k * 2.5}"), element(0x20, 0x37, "DS", "1\\0\\0\\0\\1\\0"), element(0x28, 0x10, "US", struct.pack("<H", 2)), element(0x28, 0x11, "US", struct.pack("<H", 3)),
        element(0x28, 0x30, "DS", "0.5\\0.25"), element(0x28, 0x100, "US", struct.pack("<H", 16)), element(0x28, 0x103, "US", struct.pack("<H", 1)), element(0x28, 0x1052, "DS", "-10"), element(0x28, 0x1053, "DS", "2"),
        element(0x7FE0, 0x10, "OW", pixels.tobytes()),
    ])


def test_dicom_series_and_metadata(spark, tmp_path):
    from voxframe.operators import metadata
    from voxframe.sources.volumes import read_dicom, read_headers

    for k in (3, 1, 2, 5):
        (tmp_path / f"{k}.dcm").write_bytes(ct(k))
    (tmp_path / "note.txt").write_text("not an image")
    r = read_dicom(spark, str(tmp_path)).first()
    assert (r.nx, r.ny, r.nz) == (3, 2, 4) and r.spacing == [0.25, 0.5, 2.5] and r.origin == [1, 2, 2.5] and r.modality == "CT"
    assert np.array(r.data).reshape(3, 2, 4)[0, 0].tolist() == [-8, -6, -4, 0]
    inst = metadata.instances(read_headers(spark, str(tmp_path)))
    assert inst.count() == 4 and metadata.patients(inst).first().num_instances == 4
    c = metadata.completeness(inst).first()
    assert c.num_gaps == 1 and not c.is_complete and c.median_gap == 2.5
    assert [x.missing for x in metadata.missing_numbers(inst).collect()] == [4]
    assert [p.rsplit("/", 1)[1] for p in metadata.file_paths(inst).first().file_paths] == ["1.dcm", "2.dcm", "3.dcm", "5.dcm"]
    assert metadata.phases(metadata.split_phases(inst)).first().num_slices == 4
    import json

    document = json.loads(metadata.nested(inst).first().document)
    assert [i["instance_number"] for i in document["studies"][0]["series"][0]["instances"]] == [1, 2, 3, 5]
    assert {k: v.count() for k, v in metadata.database(read_headers(spark, str(tmp_path))).items()} == {"patients": 1, "studies": 1, "series": 1, "instances": 4}


def test_reports(spark, tmp_path):
    from voxframe.sources.structured import read_reports, summary

    name = lambda t: element(0x40, 0xA043, "SQ", item(element(8, 0x104, "LO", t)))
    unit = element(0x40, 0x8EA, "SQ", item(element(8, 0x100, "SH", "mm")))
    num = lambda t, v: item(element(0x40, 0xA040, "CS", "NUM"), name(t), element(0x40, 0xA300, "SQ", item(unit, element(0x40, 0xA30A, "DS", v))))
    group = item(element(0x40, 0xA040, "CS", "CONTAINER"), name("Lesion"), element(0x40, 0xA730, "SQ", num("Length", "12.5") + num("Width", "x")))
    raw = HEAD + element(8, 0x16, "UI", "1.2.840.10008.5.1.4.1.1.88.33") + element(8, 0x18, "UI", "7.7") + element(0x40, 0xA730, "SQ", group + num("Total", "3"))
    (tmp_path / "sr.dcm").write_bytes(raw)
    rows = {r.measurement_name: r for r in read_reports(spark, str(tmp_path)).collect()}
    assert rows["Length"].value == 12.5 and rows["Length"].unit == "mm" and rows["Length"].group_id == "Lesion"
    assert rows["Width"].value is None and rows["Total"].group_id == "default"
    assert summary(read_reports(spark, str(tmp_path))).first().num_measurements == 3


def test_report_fields(spark, tmp_path):
    from voxframe.sources.structured import combined, read_reports, report_log

    name = lambda t: element(0x40, 0xA043, "SQ", item(element(8, 0x104, "LO", t)))
    kind = lambda t: element(0x40, 0xA040, "CS", t)
    code = lambda what, means: item(kind("CODE"), name(what), element(0x40, 0xA168, "SQ", item(element(8, 0x104, "LO", means))))
    value = element(0x40, 0xA300, "SQ", item(element(0x40, 0xA30A, "DS", "4")))
    num = item(kind("NUM"), name("Volume"), value, element(0x40, 0xA730, "SQ", code("Derivation", "Mean")))
    text = item(kind("TEXT"), name("Tracking Identifier"), element(0x40, 0xA160, "LT", "lesion-1"))
    group = item(kind("CONTAINER"), name("Measurement Group"))
    raw = HEAD + element(8, 0x16, "UI", "1.2.840.10008.5.1.4.1.1.88.33") + element(8, 0x18, "UI", "7.8") + element(0x40, 0xA730, "SQ", group + num + code("Finding Site", "Liver") + text)
    (tmp_path / "a.dcm").write_bytes(raw)
    (tmp_path / "broken.dcm").write_bytes(raw[:150])
    items = read_reports(spark, str(tmp_path))
    r = items.filter("status = 'ok'").first()
    assert (r.group_id, r.finding_type, r.finding_site, r.derivation, r.tracking_id, r.value) == ("Measurement Group", "Measurement Group", "Liver", "Mean", "lesion-1", 4.0)
    assert combined(items).count() == 1 and {x.num_measurements for x in report_log(items).collect()} <= {0, 1}


def test_phases_and_damaged_files(spark, tmp_path):
    from voxframe.operators import metadata
    from voxframe.sources.structured import load_volumes
    from voxframe.sources.volumes import read_dicom, read_headers

    for k in (1, 2, 3):
        for phase in (1, 2):
            extra = element(0x20, 0x100, "IS", str(phase))
            raw = ct(k).replace(element(8, 0x18, "UI", f"9.{k}"), element(8, 0x18, "UI", f"9.{k}.{phase}"))
            (tmp_path / f"{k}_{phase}.dcm").write_bytes(raw[: raw.index(element(0x20, 0x32, "DS", f"1\\2\\{k * 2.5}"))] + extra + raw[raw.index(element(0x20, 0x32, "DS", f"1\\2\\{k * 2.5}")) :])
    (tmp_path / "damaged.dcm").write_bytes(ct(4)[:140] + b"\xff" * 7)
    assert [read_dicom(spark, str(tmp_path), dataset_index=i).first().nz for i in (0, 1)] == [3, 3]
    assert load_volumes(spark, str(tmp_path), 1).count() == 1
    with pytest.raises(Exception, match="out of range"):
        read_dicom(spark, str(tmp_path), dataset_index=2).collect()
    head = read_headers(spark, str(tmp_path))
    assert head.count() == 7 and head.filter("size(tags) > 0").count() >= 6
    levels = metadata.database(head.filter("tags['SeriesInstanceUID'] is not null"))
    assert levels["series"].count() == 2 and metadata.database(head.filter("tags['SeriesInstanceUID'] is not null"), split_multiseries=False)["series"].count() == 1


def test_segments_on_a_reference(spark, tmp_path):
    from voxframe.operators import geometry
    from voxframe.sources.structured import load_volumes, read_segments
    from voxframe.sources.volumes import voxels

    us = lambda g, e, v: element(g, e, "US", struct.pack("<H", v))
    frame = lambda seg, index, z: item(
        element(0x62, 0xA, "SQ", item(us(0x62, 0xB, seg))), element(0x20, 0x9111, "SQ", item(element(0x20, 0x9157, "UL", struct.pack("<2I", *index)))), element(0x20, 0x9113, "SQ", item(element(0x20, 0x32, "DS", f"1\\0\\{z}")))
    )
    masks = np.zeros((4, 2, 3), np.uint8)  # two segments of two slices of 2 x 3
    masks[0, 0, 0] = masks[1, 1, 2] = masks[2, 0, 1] = 1
    bits = np.packbits(masks.reshape(-1), bitorder="little").tobytes()
    shared = element(0x5200, 0x9229, "SQ", item(element(0x28, 0x9110, "SQ", item(element(0x28, 0x30, "DS", "1\\1"), element(0x18, 0x50, "DS", "9"))), element(0x20, 0x9116, "SQ", item(element(0x20, 0x37, "DS", "1\\0\\0\\0\\1\\0")))))
    frames = element(0x5200, 0x9230, "SQ", frame(1, (1, 1), 2) + frame(1, (1, 2), 4) + frame(2, (2, 1), 2) + frame(2, (2, 2), 4))
    known = element(0x62, 2, "SQ", item(us(0x62, 4, 1), element(0x62, 5, "LO", "Liver")) + item(us(0x62, 4, 2), element(0x62, 5, "LO", "Lesion")))
    raw = HEAD + element(8, 0x16, "UI", "1.2.840.10008.5.1.4.1.1.66.4") + element(0x28, 8, "IS", "4") + us(0x28, 0x10, 2) + us(0x28, 0x11, 3) + us(0x28, 0x100, 1) + us(0x28, 0x103, 0) + known + shared + frames + element(0x7FE0, 0x10, "OW", bits)
    (tmp_path / "seg.dcm").write_bytes(raw)
    rows = {r.segment: r for r in read_segments(spark, str(tmp_path)).collect()}
    assert {k: r.label for k, r in rows.items()} == {1: "Liver", 2: "Lesion"} and all(r.status == "ok" for r in rows.values())
    assert rows[1].spacing == [1.0, 1.0, 2.0] and rows[1].origin == [1.0, 0.0, 2.0] and (rows[1].nx, rows[1].ny, rows[1].nz) == (3, 2, 2)
    assert np.argwhere(np.array(rows[1].mask).reshape(3, 2, 2)).tolist() == [[0, 0, 0], [2, 1, 1]] and np.argwhere(np.array(rows[2].mask).reshape(3, 2, 2)).tolist() == [[1, 0, 0]]
    v = load_volumes(spark, str(tmp_path))
    ref = v.select("volume_id", *(x for x in ("nx", "ny", "nz")), "spacing", "direction").selectExpr("volume_id", "5 as nx", "2 as ny", "3 as nz", "spacing", "array(0D, 0D, 0D) as origin", "direction")
    laid = geometry.on_reference(voxels(v), v, ref).filter("v > 0").collect()
    assert sorted((r.volume_id[-1], r.x, r.y, r.z, r.turned) for r in laid) == [("1", 1, 0, 1, False), ("1", 3, 1, 2, False), ("2", 2, 0, 1, False)]


def test_rules_and_files_of_configurations(tmp_path):
    import warnings

    from voxframe.plans import config
    from voxframe.plans.config import Config, Configs, Rules, deduplication, described

    got = deduplication(Configs().resolve(["all_standard"]), "1.0.0")
    assert got.stats["reused_families"] > 0 and abs(got.stats["cache_hit_rate"] - got.stats["reused_families"] / len(got.entries)) < 1e-12
    none = Rules("none", {})
    assert deduplication(Configs().resolve(["all_standard"]), none).stats["reused_families"] == 0
    assert Rules.from_dict(Rules.of("1.0.0").to_dict()) == Rules.of("1.0.0") and deduplication({}).stats == {}
    with pytest.raises(ValueError, match="no rules"):
        Rules.of("9")
    own = Configs(load_standard=False).add("a", [{"step": "binarize_mask", "params": {"mask_values": (2, 4)}}])
    for name in ("c.json", "c.yaml"):
        own.save(str(tmp_path / name))
        assert Configs.load(str(tmp_path / name)).get("a").steps[0]["params"]["mask_values"] == (2, 4)
    assert Configs.from_dict({"configs": {"old": [{"step": "round_intensities"}]}}).get("old") == Config([{"step": "round_intensities"}])
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        config.migrated({"version": 99, "configs": {}})
    assert said and len(described({"x": Config([{"step": "filter", "params": {"type": "mean", "support": 3}}, {"step": "extract_features", "params": {"families": ["ivh"]}}])})) == 7


def test_results_files(spark, tmp_path):
    from voxframe.operators import results

    long = spark.createDataFrame([("s", "a", "f", 1.0), ("s", "b", "f", 3.0)], "subject_id string, config string, feature_name string, value double")
    assert results.wide(long).first().asDict() == {"subject_id": "s", "a__f": 1.0, "b__f": 3.0}
    assert '"b"' in results.as_json(long).first().json
    for kind in ("csv", "json", "unknown"):
        results.save(results.rows_by_config(long), str(tmp_path / f"r.{kind}"))
    assert spark.read.csv(str(tmp_path / "r.unknown"), header=True).count() == 2


def test_templates_and_log(spark, tmp_path):
    from voxframe.operators import results
    from voxframe.plans import templates
    from voxframe.plans.config import Configs
    from voxframe.plans.run import run
    from voxframe.sources.volumes import embedding_volumes

    Configs(load_standard=False).add("mine", [{"step": "resegment", "params": {"range_min": 9.0}}, {"step": "extract_features", "params": {"families": ["intensity"]}}]).save(str(tmp_path / "a.yaml"))
    assert templates.list_files(str(tmp_path)) == ["a.yaml"] and templates.metadata_of(str(tmp_path / "a.yaml"))["config_names"] == ["mine"]
    every = templates.all_templates(str(tmp_path))
    assert len(every) == 7
    log = results.run_log(run(embedding_volumes(spark, SF).limit(2), {"mine": every["mine"]})).collect()
    assert len(log) == 2 and all(r.missing == r.features == 18 and "EmptyRegion" in r.error for r in log)


def test_stream(spark, tmp_path):
    from voxframe.plans.config import Config
    from voxframe.sources.volumes import embedding_volumes
    from voxframe.streaming.ingest import stream_features, windowed

    embedding_volumes(spark, SF).limit(20).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = stream_features(rows, {"c": Config([{"step": "extract_features", "params": {"families": ["intensity"]}}])}, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20 * 18
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed(e, slide="30 minutes").count() > windowed(e).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """F1, F4 to F7: a file may have more splits than the cluster has cores, and yet all its rows in one of them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from voxframe.plans import run
    from voxframe.sources.volumes import embedding_volumes

    n = 4000
    x = np.random.default_rng(0).random((n, 64), np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(x.ravel())), "label": np.zeros(n, np.int32)})
    pq.write_table(table, tmp_path / "embeddings.parquet", row_group_size=n)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in names]
    try:
        for k in names:
            spark.conf.set(k, "65536")
        volumes = embedding_volumes(spark, str(tmp_path))
        assert volumes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = run.spread(volumes.select("volume_id")).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        for k, v in zip(names, before, strict=True):
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) < n / 4


def _lattice_voxels(spark):
    rng = np.random.default_rng(0)
    shapes = [(3, 4, 21), (1, 1, 8), (1, 1, 1), (2, 3, 9)]
    rows = [(k, int(x), int(y), int(z) - 9 * (k == 0), int(rng.integers(1, 5)), int(rng.random() < 0.75)) for k, s in enumerate(shapes) for x, y, z in np.ndindex(*s)]
    return rows, spark.createDataFrame(rows, "volume_id long, x int, y int, z int, g int, intensity_mask int")


def test_neighbours_across_cells_of_a_line(spark):
    """lines longer than a cell, places below 0, holes and lone voxels, against all pairs."""
    from collections import Counter

    from voxframe.functions.texture import NEIGHBOURS
    from voxframe.operators import lattice

    rows, voxels = _lattice_voxels(spark)
    level = {r[:4]: r[4] for r in rows if r[5]}
    near = {k: [level[o] for d in NEIGHBOURS if (o := (k[0], k[1] + d[0], k[2] + d[1], k[3] + d[2])) in level] for k in level}
    assert {tuple(r)[:3]: r.n for r in lattice.glcm(voxels).collect()} == Counter((k[0], level[k], o) for k in level for o in near[k])
    got = {(r.volume_id, r.x, r.y, r.z): (r.g, r.neighbours, r.mean, r.dependence) for r in lattice.neighbourhood(voxels, 1).collect()}
    assert got == {k: (level[k], len(n), sum(n) / len(n) if n else None, 1 + sum(abs(o - level[k]) <= 1 for o in n)) for k, n in near.items()}


@pytest.mark.parametrize("name", ["glcm", "ngtdm"])
def test_voxels_are_not_broadcast(spark, name):
    """the sizes of exploded voxels are guessed far too low, so the driver got all of them for a broadcast."""
    from voxframe.operators import lattice

    voxels = queries.QUERIES["discretise_fbn"](spark, SF).selectExpr("*", "1 AS intensity_mask")
    plan = getattr(lattice, name)(voxels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_x" in x]


def test_nearest_places_move_no_row(spark):
    """F8: a nearest place has one voxel, so there is nothing to sum; three hash tables of all places grew with the volumes of a task."""
    from voxframe.operators import geometry

    got = queries.QUERIES["resample_nearest"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning" not in plan
    voxels = spark.createDataFrame([(1, x, 0, 0, float(x) if x else float("nan"), x != 1) for x in range(3)], "volume_id long, x int, y int, z int, v double, source_valid boolean")
    rows = {r.x: r.v for r in geometry.resample(voxels, (3, 1, 1), (1.0,) * 3, (0.5, 1.0, 1.0), "nearest").collect()}
    assert math.isnan(rows.pop(0)) and math.isnan(rows.pop(1)) and rows == {2: None, 3: None, 4: 2.0, 5: 2.0}
    heads = spark.createDataFrame([(1, 3, 1, 1, [1.0, 1.0, 1.0])], "volume_id long, nx int, ny int, nz int, spacing array<double>")
    each = geometry.resample_each(voxels.fillna(0.0), heads, (0.5, 1.0, 1.0), "nearest")
    assert sorted((r.x, r.v) for r in each.collect()) == [(0, 0.0), (1, 0.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0)]
