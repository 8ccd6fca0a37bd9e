"""Queries of the engine over the test tables, and their SQL.

Vectors are 4x4x4 volumes; line items, orders and events are regions of values; customers, orders and line items
stand for patients, studies and instances. Rounded columns are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe import filter_sql
from voxframe.functions.filters import LOW_PASS
from voxframe.functions.intensity import HISTOGRAM, INTENSITY, IVH
from voxframe.functions.texture import DIRECTIONS, NAMES, NEIGHBOURS
from voxframe.operators import geometry, lattice, metadata, results, stats, steps
from voxframe.plans import catalogue, run
from voxframe.plans.config import DESCRIBED, GROUPS, NEED_BINS, Config, Configs, described, plan
from voxframe.sources.volumes import embedding_volumes, grouped_volumes, voxels
from voxframe.streaming.ingest import windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MASK = 0.12  # a voxel below minus this lies outside the region of the queries that have one


NUDGE = 1e-9  # before rounding: keeps exact halves from falling either way


def query(sql: str | None = None, nudge: bool = False) -> Callable:
    if nudge:
        sql = sql.replace(", 6)", f" + {NUDGE!r}, 6)")

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(embedding_volumes(spark, sf_dir))
    inside = F.when(F.col("v") > -MASK, 1).otherwise(0)
    return v.withColumn("morph_mask", inside).withColumn("intensity_mask", inside)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_VOX = f"""vox AS (SELECT vec_id AS volume_id, CAST((p - 1) // 16 AS INT) AS x, CAST(((p - 1) // 4) % 4 AS INT) AS y, CAST((p - 1) % 4 AS INT) AS z,
  CAST(embedding[p] AS DOUBLE) AS v, CASE WHEN CAST(embedding[p] AS DOUBLE) > -{MASK} THEN 1 ELSE 0 END AS m FROM embeddings, range(1, 65) r(p))"""
_FBN = """ends AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY volume_id),
fbn AS (SELECT volume_id, x, y, z, v, m, CAST(CASE WHEN v >= hi THEN 8 ELSE least(greatest(floor(8 * (v - lo) / (hi - lo)) + 1, 1), 8) END AS INT) AS g FROM vox JOIN ends USING (volume_id))"""


def _offsets(offsets: list) -> str:
    return "(VALUES " + ", ".join(map(str, offsets)) + ") o(dx, dy, dz)"


# --- steps -----------------------------------------------------------------------------------------------------


@query(f"WITH {_VOX} SELECT volume_id, count(*) AS n, round(sum(v), 6) + 0.0 AS total FROM vox WHERE m = 1 GROUP BY volume_id")
def apply_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(steps.apply_mask(masked(spark, sf_dir)).groupBy("volume_id").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


@query(f"WITH {_VOX} SELECT volume_id, count(*) AS n, CAST(count(*) FILTER (m = 0) AS BIGINT) AS outside FROM vox GROUP BY volume_id")
def extract_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.extract_roi(masked(spark, sf_dir)).groupBy("volume_id").agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("outside"))


@query(f"WITH {_VOX} SELECT volume_id, x, y, z, CASE WHEN v < -0.1 OR v > 0.15 THEN 0 ELSE m END AS intensity_mask FROM vox")
def resegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.resegment(masked(spark, sf_dir), -0.1, 0.15).select("volume_id", "x", "y", "z", "intensity_mask")


@query(f"""WITH {_VOX}, s AS (SELECT volume_id, avg(v) AS a, stddev_pop(v) AS d FROM vox WHERE m = 1 GROUP BY volume_id)
SELECT volume_id, CAST(sum(CASE WHEN abs(v - a) > 1.5 * d THEN 0 ELSE m END) AS BIGINT) AS kept FROM vox JOIN s USING (volume_id) GROUP BY volume_id""")
def filter_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.filter_outliers(masked(spark, sf_dir), 1.5).groupBy("volume_id").agg(F.sum("intensity_mask").alias("kept"))


@query("SELECT o_orderkey, round_even(o_totalprice / 2, 0) + 0.0 AS v FROM orders")
def round_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.round_intensities(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 2).alias("v")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber BETWEEN 2 AND 4 THEN 1 ELSE 0 END AS morph_mask FROM lineitem")
def binarize_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("morph_mask"))
    return steps.binarize_mask(d, values=(2, 4), apply_to="morph")


@query("""WITH RECURSIVE w AS (SELECT o_custkey AS volume_id, CASE WHEN o_orderkey % 7 = 0 THEN -1000.0 WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders),
n AS (SELECT volume_id, count(*) AS n, count(*) FILTER (v = -1000) AS a, count(*) FILTER (v = 0) AS b FROM w GROUP BY volume_id)
SELECT volume_id, CAST(CASE WHEN a > 0 AND a >= 0.01 * n THEN -1000 WHEN b > 0 AND b >= 0.01 * n THEN 0 END AS DOUBLE) AS sentinel FROM n""")
def detect_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 7 == 0, -1000.0).when(k % 11 == 0, 0.0).otherwise(F.col("o_totalprice"))
    return steps.detect_sentinel(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("volume_id"), v.alias("v"), F.lit(1).alias("intensity_mask")))


@query("SELECT event_id, abs(value - 10) > 0.5 AS source_valid FROM events")
def source_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.source_mask(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v")), 10.0, 0.5).select("event_id", "source_valid")


@query(f"WITH {_VOX}, {_FBN} SELECT volume_id, x, y, z, g FROM fbn")
def discretise_fbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.discretise(voxels(embedding_volumes(spark, sf_dir)), "FBN", 8).select("volume_id", "x", "y", "z", "g")


@query("""WITH e AS (SELECT l_returnflag AS f, min(l_extendedprice) AS lo FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(greatest(floor((l_extendedprice - lo) / 1000) + 1, 1) AS INT) AS g FROM lineitem JOIN e ON l_returnflag = f""")
def discretise_fbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("volume_id"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), F.lit(1).alias("intensity_mask"))
    return steps.discretise(d, "FBS", bin_width=1000.0).select("l_orderkey", "l_linenumber", "g")


@query("SELECT event_id, (value >= 1)::INT + (value >= 5)::INT + (value >= 20)::INT AS g FROM events")
def discretise_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.discretise(table(spark, sf_dir, "events").select("event_id", F.col("value").alias("v")), "FIXED_CUTOFFS", cutoffs=[1.0, 5.0, 20.0]).select("event_id", "g")


@query(f"WITH {_VOX} SELECT volume_id, coalesce(max(CASE WHEN v > 0.3 THEN 1 END), 0) = 0 AS empty FROM vox GROUP BY volume_id")
def empty_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = masked(spark, sf_dir).withColumn("intensity_mask", F.when(F.col("v") > 0.3, 1).otherwise(0))
    return steps.empty_regions(v)


@query(f"""WITH RECURSIVE {_VOX}, own AS (SELECT volume_id, x, y, z, x * 16 + y * 4 + z AS id FROM vox WHERE v > 0),
e AS (SELECT a.volume_id, a.id AS a, b.id AS b FROM own a JOIN own b ON a.volume_id = b.volume_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r AS (SELECT volume_id, id, id AS root FROM own UNION SELECT e.volume_id, e.b, r.root FROM r JOIN e ON e.volume_id = r.volume_id AND e.a = r.id),
c AS (SELECT volume_id, id, min(root) AS root FROM r GROUP BY ALL), s AS (SELECT volume_id, root, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT volume_id, root FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, root) AS k FROM s) WHERE k = 1)
SELECT volume_id, id AS voxel FROM c JOIN b USING (volume_id, root)""")
def keep_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run.largest_components(embedding_volumes(spark, sf_dir))
    return got.select("volume_id", (F.col("x") * 16 + F.col("y") * 4 + F.col("z")).alias("voxel"))


@query(f"WITH {_VOX} SELECT volume_id, x, y, z, CAST(trunc((greatest(least(v, 0.2), -0.2) - -0.2) / 0.4 * 255) AS INT) AS grey FROM vox")
def window_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.window_level(voxels(embedding_volumes(spark, sf_dir)), 0.0, 0.4).select("volume_id", "x", "y", "z", "grey")


@query(f"""WITH {_VOX}, e AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY volume_id),
g AS (SELECT volume_id, x, y, z, m, CAST(trunc((v - lo) / (hi - lo) * 255) AS INT) AS grey FROM vox JOIN e USING (volume_id))
SELECT volume_id, x, y, z, CASE WHEN m > 0 THEN CAST(floor(0.75 * grey + 0.25 * 255) AS INT) ELSE grey END AS r,
 CASE WHEN m > 0 THEN CAST(floor(0.75 * grey + 0.25 * 64) AS INT) ELSE grey END AS g_, CASE WHEN m > 0 THEN CAST(floor(0.75 * grey + 0.25 * 0) AS INT) ELSE grey END AS b FROM g WHERE z % 2 = 0""")
def slice_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = steps.select_slices(4, "every_2")
    grey = steps.normalise(masked(spark, sf_dir).filter("true")).filter(F.col("z").isin(wanted))
    return steps.overlay(grey, [(255, 64, 0), (0, 128, 255)]).select("volume_id", "x", "y", "z", "r", "g_", "b")


# --- first-order families ------------------------------------------------------------------------------------


def _first_order_sql(source: str, by: str, v: str) -> str:
    return f"""WITH d AS (SELECT {by} AS k, CAST({v} AS DOUBLE) AS v FROM {source}),
q AS (SELECT k, count(*) AS n, avg(v) AS mean, min(v) AS lo, max(v) AS hi, sum(v * v) AS energy, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS med,
 quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90 FROM d GROUP BY k),
m AS (SELECT k, avg((v - mean) ** 2) AS var, avg((v - mean) ** 3) AS m3, avg((v - mean) ** 4) AS m4, avg(abs(v - mean)) AS mad, avg(abs(v - med)) AS medad,
 avg(v) FILTER (v BETWEEN p10 AND p90) AS mid FROM d JOIN q USING (k) GROUP BY k),
r AS (SELECT k, avg(abs(v - mid)) FILTER (v BETWEEN p10 AND p90) AS rmad FROM d JOIN q USING (k) JOIN m USING (k) GROUP BY k)
SELECT k AS region, n AS count, round(mean, 6) + 0.0 AS mean, round(var, 4) + 0.0 AS var, round(m3 / nullif(var, 0) ** 1.5, 6) + 0.0 AS skew, round(m4 / nullif(var, 0) ** 2 - 3, 6) + 0.0 AS kurt,
 round(med, 6) + 0.0 AS median, lo AS min, round(p10, 6) + 0.0 AS p10, round(p90, 6) + 0.0 AS p90, hi AS max, round(p75 - p25, 6) + 0.0 AS iqr, round(hi - lo, 6) + 0.0 AS range, round(mad, 6) + 0.0 AS mad,
 round(rmad, 6) + 0.0 AS rmad, round(medad, 6) + 0.0 AS medad, round(sqrt(var) / mean, 6) + 0.0 AS cov, round((p75 - p25) / (p75 + p25), 6) + 0.0 AS qcod, round(energy / n, 2) + 0.0 AS energy,
 round(sqrt(energy / n), 6) + 0.0 AS rms FROM q JOIN m USING (k) JOIN r USING (k)"""


def _first_order(df: DataFrame) -> DataFrame:
    out = stats.first_order(df, ["region"]).withColumn("energy", F.col("energy") / F.col("count"))
    digits = {"var": 4, "energy": 2}
    return out.select("region", "count", "min", "max", *[(F.round(c, digits.get(c, 6)) + 0.0).alias(c) for c in out.columns if c not in ("region", "count", "min", "max")])


@query(_first_order_sql("lineitem", "l_returnflag || l_linestatus", "l_extendedprice"))
def intensity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_order(table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("region"), F.col("l_extendedprice").alias("v")))


@query(_first_order_sql("events", "event_type", "value"))
def intensity_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_order(table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), F.col("value").alias("v")))


@query(f"""WITH {_VOX}, {_FBN}, c AS (SELECT volume_id, g, count(*) AS n FROM fbn GROUP BY ALL),
b AS (SELECT volume_id, arg_max(g, n * 100 - g) AS mode, round(-sum(n / 64 * log2(n / 64)), 6) + 0.0 AS entropy, round(sum((n / 64) ** 2), 6) + 0.0 AS uniformity FROM c GROUP BY volume_id),
f AS (SELECT i.volume_id, k AS g, coalesce(n, 0) AS n FROM (SELECT DISTINCT volume_id FROM c) i CROSS JOIN range(1, 9) r(k) LEFT JOIN c ON c.volume_id = i.volume_id AND c.g = k),
s AS (SELECT volume_id, g, CASE WHEN g = 1 THEN lead(n) OVER w - n WHEN g = 8 THEN n - lag(n) OVER w ELSE (lead(n) OVER w - lag(n) OVER w) / 2 END AS s FROM f WINDOW w AS (PARTITION BY volume_id ORDER BY g)),
x AS (SELECT volume_id, max(s) AS hi, min(s) AS lo FROM s GROUP BY volume_id)
SELECT b.volume_id, mode, entropy, uniformity, CAST(hi AS DOUBLE) AS max_grad, min(g) FILTER (s = hi) AS max_grad_at, CAST(lo AS DOUBLE) AS min_grad, min(g) FILTER (s = lo) AS min_grad_at
FROM b JOIN s USING (volume_id) JOIN x USING (volume_id) GROUP BY ALL""")
def histogram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = steps.discretise(voxels(embedding_volumes(spark, sf_dir)), "FBN", 8)
    return rounded(stats.histogram(g, ["volume_id"])).withColumn("mode", F.col("mode").cast("int")).withColumn("max_grad_at", F.col("max_grad_at").cast("int")).withColumn("min_grad_at", F.col("min_grad_at").cast("int"))


@query("""WITH c AS (SELECT l_returnflag AS region, l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY region) AS whole, sum(n) OVER (PARTITION BY region ORDER BY v DESC) AS held, min(v) OVER (PARTITION BY region) AS lo, max(v) OVER (PARTITION BY region) AS hi FROM c),
p AS (SELECT *, lag(v) OVER (PARTITION BY region ORDER BY v) AS pv, lag(held) OVER (PARTITION BY region ORDER BY v) AS ph FROM w),
a AS (SELECT region, sum(n) FILTER (v >= lo + 0.1 * (hi - lo)) / max(whole) AS v10, sum(n) FILTER (v >= lo + 0.9 * (hi - lo)) / max(whole) AS v90,
 min(v) FILTER (held <= floor(0.1 * whole)) AS i10, min(v) FILTER (held <= floor(0.9 * whole)) AS i90, sum((v - pv) * (held + ph) / 2 / whole) AS auc FROM p GROUP BY region)
SELECT region, round(v10, 6) AS v10, round(v90, 6) AS v90, round(v10 - v90, 6) AS vdiff, i10, i90, round(i10 - i90, 6) AS idiff, round(auc, 4) AS auc FROM a""")
def ivh_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.ivh(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_extendedprice").alias("v")), ["region"])
    return rounded(got).withColumn("auc", F.round("auc", 4))


def _volume_statistics_sql(source: str, more: str = "", extra: str = "") -> str:
    """The 18 statistics of every volume's values, as the runner names them; `more` adds CTEs, `extra` columns."""
    inner = _first_order_sql(source, "volume_id", "v")
    head = inner[: inner.rindex("SELECT k AS region")]
    cols = {
        "mean": "mean", "var": "var", "skew": "m3 / nullif(var, 0) ** 1.5", "kurt": "m4 / nullif(var, 0) ** 2 - 3", "median": "med", "min": "lo", "p10": "p10", "p90": "p90", "max": "hi", "iqr": "p75 - p25",
        "range": "hi - lo", "mad": "mad", "rmad": "rmad", "medad": "medad", "cov": "sqrt(var) / mean", "qcod": "(p75 - p25) / (p75 + p25)", "energy": "energy", "rms": "sqrt(energy / n)",
    }
    keep = INTENSITY if not extra else {k: None for k in cols if k != "energy" and k != "rms"}
    return f"{head.rstrip()}{more} SELECT k AS volume_id, {', '.join(f'round({cols[c]}, 6) + 0.0 AS {c}_' for c in keep)}{extra} FROM q JOIN m USING (k) JOIN r USING (k)"


def _run_features(spark: SparkSession, sf_dir: str, first: list[dict], family: str, names: dict[str, str], params: dict | None = None) -> DataFrame:
    """The runner's features of one family, one row for each volume; columns end in _ since some are SQL words.

    A coefficient whose denominator is next to nothing is left out on both sides by its size.
    """
    config = Config([*first, {"step": "extract_features", "params": {"families": [family], **(params or {})}}])
    long = run.run(embedding_volumes(spark, sf_dir), {"c": config})
    got = long.groupBy(F.col("subject_id").cast("long").alias("volume_id")).agg(*[F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(f"{k}_") for k, n in names.items()])
    return got.select("volume_id", *[(F.round(F.col(f"{k}_") + NUDGE, 6) + 0.0).alias(f"{k}_") for k in names])


@query(_volume_statistics_sql("(SELECT vec_id AS volume_id, unnest(embedding) AS v FROM embeddings)"), nudge=True)
def run_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_features(spark, sf_dir, [], "intensity", INTENSITY)


_COUNTS = """, c AS (SELECT k, v AS g, count(*) AS c FROM d GROUP BY ALL), e AS (SELECT k, -sum(c / 64 * log2(c / 64)) AS entropy, sum((c / 64) ** 2) AS uniformity, CAST(arg_max(g, c * 100 - g) AS DOUBLE) AS mode FROM c GROUP BY k),
f AS (SELECT i.k, CAST(b.range AS DOUBLE) AS g, coalesce(c, 0) AS c FROM (SELECT DISTINCT k FROM c) i CROSS JOIN range(1, 9) b LEFT JOIN c ON c.k = i.k AND c.g = b.range),
s AS (SELECT k, g, CASE WHEN g = 1 THEN lead(c) OVER w - c WHEN g = 8 THEN c - lag(c) OVER w ELSE (lead(c) OVER w - lag(c) OVER w) / 2 END AS s FROM f WINDOW w AS (PARTITION BY k ORDER BY g)),
x AS (SELECT k, max(s) AS up, min(s) AS down, min(g) AS g0 FROM s GROUP BY k),
h AS (SELECT x.k, CAST(any_value(up) AS DOUBLE) AS up, CAST(any_value(down) AS DOUBLE) AS down, min(g) FILTER (s = up) AS up_at, min(g) FILTER (s = down) AS down_at FROM s JOIN x USING (k) GROUP BY x.k)"""
_MORE = ", round((SELECT mode FROM e WHERE e.k = q.k), 6) + 0.0 AS mode_, round((SELECT entropy FROM e WHERE e.k = q.k), 6) + 0.0 AS entropy_, round((SELECT uniformity FROM e WHERE e.k = q.k), 6) + 0.0 AS uniformity_" + "".join(f", round((SELECT {a} FROM h WHERE h.k = q.k), 6) + 0.0 AS {b}_" for a, b in (("up", "max_grad"), ("up_at", "max_grad_at"), ("down", "min_grad"), ("down_at", "min_grad_at")))


@query(_volume_statistics_sql(f"(WITH {_VOX}, {_FBN} SELECT volume_id, g AS v FROM fbn)", _COUNTS, _MORE), nudge=True)
def run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 23 histogram features of the runner."""
    return _run_features(spark, sf_dir, [{"step": "discretise", "params": {"method": "FBN", "n_bins": 8}}], "histogram", HISTOGRAM)


def _ivh_sql(values: str, dense: bool = False) -> str:
    """The volume histogram of every volume of 64 values, by counting for each value those that aren't less; `dense`: intensities are taken from all bins, filled or not."""
    grid = "SELECT volume_id, CAST(r.range AS DOUBLE) AS v FROM e, range(1, 9) r WHERE r.range BETWEEN lo AND hi" if dense else "SELECT DISTINCT volume_id, v FROM t"
    return f"""WITH {values}, e AS (SELECT volume_id, min(v) AS lo, max(v) AS hi FROM t GROUP BY volume_id),
h AS (SELECT a.volume_id, a.v, count(*) AS held FROM (SELECT DISTINCT volume_id, v FROM t) a JOIN t b ON a.volume_id = b.volume_id AND b.v >= a.v GROUP BY ALL),
s AS (SELECT *, lag(v) OVER w AS pv, lag(held) OVER w AS ph FROM h WINDOW w AS (PARTITION BY volume_id ORDER BY v)),
n AS (SELECT a.volume_id, a.v, count(*) AS held FROM ({grid}) a JOIN t b ON a.volume_id = b.volume_id AND b.v >= a.v GROUP BY ALL),
i AS (SELECT volume_id, coalesce(min(v) FILTER (held <= 6), max(v)) AS i10, coalesce(min(v) FILTER (held <= 57), max(v)) AS i90 FROM n GROUP BY volume_id),
u AS (SELECT s.volume_id, any_value(i10) AS i10, any_value(i90) AS i90, coalesce(sum((s.v - pv) * (held + ph) / 128), 0) AS auc FROM s JOIN i USING (volume_id) GROUP BY s.volume_id),
f AS (SELECT volume_id, count(*) FILTER (v >= lo + 0.1 * (hi - lo)) / 64 AS v10, count(*) FILTER (v >= lo + 0.9 * (hi - lo)) / 64 AS v90 FROM t JOIN e USING (volume_id) GROUP BY volume_id)
SELECT volume_id, round(v10, 6) + 0.0 AS v10_, round(v90, 6) + 0.0 AS v90_, round(v10 - v90, 6) + 0.0 AS vdiff_, round(i10, 6) + 0.0 AS i10_, round(i90, 6) + 0.0 AS i90_, round(i10 - i90, 6) + 0.0 AS idiff_, round(auc, 6) + 0.0 AS auc_ FROM u JOIN f USING (volume_id)"""


@query(_ivh_sql("t AS (SELECT vec_id AS volume_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"), nudge=True)
def run_ivh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner's volume histogram of raw values."""
    return _run_features(spark, sf_dir, [], "ivh", IVH, {"ivh_use_continuous": True})


@query(_ivh_sql(f"{_VOX}, {_FBN}, t AS (SELECT volume_id, CAST(g AS DOUBLE) AS v FROM fbn)", dense=True), nudge=True)
def run_ivh_of_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runner's volume histogram of bins."""
    return _run_features(spark, sf_dir, [{"step": "discretise", "params": {"method": "FBN", "n_bins": 8}}], "ivh", IVH)


# --- lattice -------------------------------------------------------------------------------------------------

_PAIRS = f"pairs AS (SELECT a.volume_id, a.g AS i, b.g AS j FROM fbn a, {_offsets(DIRECTIONS)} JOIN fbn b ON b.volume_id = a.volume_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz)"
_GLCM = f"WITH {_VOX}, {_FBN}, {_PAIRS}, duo AS (SELECT volume_id, i, j FROM pairs UNION ALL SELECT volume_id, j, i FROM pairs), m AS (SELECT volume_id, i, j, count(*) AS n FROM duo GROUP BY ALL)"
_NEAR = f"""near AS (SELECT a.volume_id, a.x, a.y, a.z, a.g, count(*) AS k, sum(b.g) AS s, count(*) FILTER (b.g = a.g) + 1 AS dep FROM fbn a, {_offsets(NEIGHBOURS)}
 JOIN fbn b ON b.volume_id = a.volume_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL)"""


def _family(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    return run.matrices(embedding_volumes(spark, sf_dir), families=(family,)).select("volume_id", "i", "j", "n")


@query(f"{_GLCM} SELECT volume_id, i, j, n FROM m")
def glcm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "glcm").withColumn("i", F.col("i").cast("int")).withColumn("j", F.col("j").cast("int"))


@query(f"{_GLCM} SELECT volume_id, i, j, n FROM m")
def glcm_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.glcm(steps.discretise(voxels(embedding_volumes(spark, sf_dir)), "FBN", 8))


@query(f"WITH {_VOX}, {_FBN}, {_NEAR} SELECT volume_id, g AS i, count(*) AS n, round(sum(abs(g - s / k)), 6) AS s FROM near GROUP BY ALL")
def ngtdm_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lattice.ngtdm(steps.discretise(voxels(embedding_volumes(spark, sf_dir)), "FBN", 8)))


@query(f"WITH {_VOX}, {_FBN}, {_NEAR} SELECT volume_id, CAST(g AS BIGINT) AS i, CAST(dep AS BIGINT) AS j, count(*) AS n FROM near GROUP BY ALL")
def ngldm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "ngldm")


@query(f"""WITH {_VOX}, {_FBN}, o AS (SELECT row_number() OVER () AS d, * FROM {_offsets(DIRECTIONS)}),
t AS (SELECT volume_id, d, g, CASE WHEN dx = 1 THEN x WHEN dy = 1 THEN y ELSE z END AS t, x, y, z, dx, dy, dz FROM fbn, o),
l AS (SELECT *, x - t * dx AS lx, y - t * dy AS ly, z - t * dz AS lz FROM t),
i AS (SELECT *, t - row_number() OVER (PARTITION BY volume_id, d, lx, ly, lz, g ORDER BY t) AS isle FROM l),
r AS (SELECT volume_id, g AS i, count(*) AS j FROM i GROUP BY volume_id, d, lx, ly, lz, g, isle)
SELECT volume_id, CAST(i AS BIGINT) AS i, j, count(*) AS n FROM r GROUP BY ALL""")
def glrlm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "glrlm")


_ZONES = f"""WITH RECURSIVE {_VOX}, {_FBN}, own AS MATERIALIZED (SELECT volume_id, x * 16 + y * 4 + z AS id, x, y, z, g FROM fbn),
e AS MATERIALIZED (SELECT a.volume_id, a.id AS a, b.id AS b FROM own a, {_offsets(NEIGHBOURS)} JOIN own b ON b.volume_id = a.volume_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.g = a.g),
r AS (SELECT volume_id, id, id AS root FROM own UNION SELECT e.volume_id, e.b, r.root FROM r JOIN e ON e.volume_id = r.volume_id AND e.a = r.id),
c AS (SELECT volume_id, id, min(root) AS root FROM r GROUP BY ALL)"""


@query(f"{_ZONES}, s AS (SELECT c.volume_id, root, max(g) AS i, count(*) AS j FROM c JOIN own USING (volume_id, id) GROUP BY ALL) SELECT volume_id, CAST(i AS BIGINT) AS i, j, count(*) AS n FROM s GROUP BY ALL")
def glszm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "glszm")


@query(f"""{_ZONES}, s AS (SELECT c.volume_id, root, max(g) AS i, min(least(x, 3 - x, y, 3 - y, z, 3 - z) + 1) AS j FROM c JOIN own USING (volume_id, id) GROUP BY ALL)
SELECT volume_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, count(*) AS n FROM s GROUP BY ALL""")
def gldzm_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(spark, sf_dir, "gldzm")


def _features(spark: SparkSession, sf_dir: str, families: list[str], keys: dict[str, str], digits: int = 6) -> DataFrame:
    """One row for each volume, with the features of keys: published name to column."""
    config = Config([{"step": "discretise", "params": {"method": "FBN", "n_bins": 8}}, {"step": "extract_features", "params": {"families": families}}])
    long = run.run(embedding_volumes(spark, sf_dir), {"c": config}).filter(F.col("feature_name").isin(list(keys)))
    got = long.groupBy(F.col("subject_id").cast("long").alias("volume_id")).agg(*[F.max(F.when(F.col("feature_name") == k, F.col("value"))).alias(c) for k, c in keys.items()])
    return got.select("volume_id", *[(F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c) for c in keys.values()])


@query(f"""{_GLCM}, p AS (SELECT volume_id, i, j, n / sum(n) OVER (PARTITION BY volume_id) AS p FROM m), u AS (SELECT volume_id, sum(i * p) AS mu FROM p GROUP BY volume_id),
l AS (SELECT volume_id, max(g) - min(g) + 1 AS levels FROM fbn GROUP BY volume_id),
v AS (SELECT p.volume_id, sum((i - mu) ** 2 * p) AS var, any_value(mu) AS mu, any_value(levels) AS levels FROM p JOIN u USING (volume_id) JOIN l USING (volume_id) GROUP BY p.volume_id),
d AS (SELECT volume_id, abs(i - j) AS k, sum(p) AS p FROM p GROUP BY ALL), dm AS (SELECT volume_id, sum(k * p) AS mean, -sum(p * log2(p)) AS entropy FROM d GROUP BY volume_id), dv AS (SELECT volume_id, sum((k - mean) ** 2 * p) AS var FROM d JOIN dm USING (volume_id) GROUP BY volume_id),
s AS (SELECT volume_id, i + j AS k, sum(p) AS p FROM p GROUP BY ALL), sm AS (SELECT volume_id, sum(k * p) AS mean, -sum(p * log2(p)) AS entropy FROM s GROUP BY volume_id), sv AS (SELECT volume_id, sum((k - mean) ** 2 * p) AS var FROM s JOIN sm USING (volume_id) GROUP BY volume_id),
x AS (SELECT volume_id, i, sum(p) AS p FROM p GROUP BY ALL), hx AS (SELECT volume_id, -sum(p * log2(p)) AS h FROM x GROUP BY volume_id),
h1 AS (SELECT p.volume_id, -sum(p.p * log2(a.p * b.p)) AS h FROM p JOIN x a ON a.volume_id = p.volume_id AND a.i = p.i JOIN x b ON b.volume_id = p.volume_id AND b.i = p.j GROUP BY p.volume_id),
h2 AS (SELECT a.volume_id, -sum(a.p * b.p * log2(a.p * b.p)) AS h FROM x a JOIN x b ON a.volume_id = b.volume_id GROUP BY a.volume_id),
w AS (SELECT volume_id, max(p) AS joint_maximum, any_value(mu) AS joint_average, any_value(var) AS joint_variance, -sum(p * log2(p)) AS joint_entropy,
 sum(p * p) AS energy, sum((i - j) ** 2 * p) AS contrast, sum(abs(i - j) * p) AS dissimilarity, sum(p / (1 + abs(i - j))) AS inverse_difference, sum(p / (1 + abs(i - j) / levels)) AS normalised_inverse_difference,
 sum(p / (1 + (i - j) ** 2)) AS inverse_difference_moment, sum(p / (1 + (i - j) ** 2 / levels ** 2)) AS normalised_inverse_difference_moment, sum(p / (i - j) ** 2) FILTER (i <> j) AS inverse_variance,
 sum((i - mu) * (j - mu) * p) / any_value(var) AS correlation, sum(i * j * p) AS autocorrelation, sum((i + j - 2 * mu) ** 2 * p) AS cluster_tendency,
 sum((i + j - 2 * mu) ** 3 * p) AS cluster_shade, sum((i + j - 2 * mu) ** 4 * p) AS cluster_prominence FROM p JOIN v USING (volume_id) GROUP BY volume_id)
SELECT w.volume_id, {", ".join(f"round(w.{c}, 6) + 0.0 AS {c}" for c in ("joint_maximum", "joint_average", "joint_variance", "joint_entropy", "energy", "contrast", "dissimilarity", "inverse_difference", "normalised_inverse_difference", "inverse_difference_moment", "normalised_inverse_difference_moment", "inverse_variance", "correlation", "autocorrelation", "cluster_tendency", "cluster_shade", "cluster_prominence"))},
 round(dm.mean, 6) + 0.0 AS difference_average, round(dv.var, 6) + 0.0 AS difference_variance, round(dm.entropy, 6) + 0.0 AS difference_entropy, round(sm.mean, 6) + 0.0 AS sum_average, round(sv.var, 6) + 0.0 AS sum_variance, round(sm.entropy, 6) + 0.0 AS sum_entropy,
 round((joint_entropy - h1.h) / hx.h, 6) + 0.0 AS information_correlation_1, round(sqrt(1 - exp(-2 * (h2.h - joint_entropy))), 6) + 0.0 AS information_correlation_2
FROM w JOIN dm USING (volume_id) JOIN dv USING (volume_id) JOIN sm USING (volume_id) JOIN sv USING (volume_id) JOIN hx USING (volume_id) JOIN h1 USING (volume_id) JOIN h2 USING (volume_id)""", nudge=True)
def glcm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 25 features."""
    return _features(spark, sf_dir, ["glcm"], {k: "energy" if k.startswith("angular") else k.rsplit("_", 1)[0] for k in catalogue.GLCM})


# Volumes of different shapes, of 2 x 1 x 1 mm, with holes in their masks: the line items of each supplier.
_MIX = """raw AS (SELECT l_suppkey AS volume_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE), CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(l_extendedprice AS DOUBLE) AS v, CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS m FROM lineitem),
cut AS (SELECT * FROM raw WHERE r < n // 25 * 25 AND m = 1), vox AS (SELECT CAST(volume_id AS BIGINT) AS volume_id, CAST(r // 25 AS INT) AS x, CAST(r // 5 % 5 AS INT) AS y, CAST(r % 5 AS INT) AS z, v, m FROM cut)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_volumes(table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber"], "l_extendedprice", "l_quantity > 10")


def _mixed_features(spark: SparkSession, sf_dir: str, family: str, names: dict[str, str], first: list[dict] | None = None) -> DataFrame:
    long = run.run(_mixed(spark, sf_dir), {"c": Config([*(first or []), {"step": "extract_features", "params": {"families": [family]}}])})
    got = long.groupBy(F.col("subject_id").cast("long").alias("volume_id")).agg(*[F.max(F.when(F.col("feature_name") == n, F.col("value"))).alias(k) for k, n in names.items()])
    return got.select("volume_id", *[(F.round(F.col(k) + NUDGE, 6) + 0.0).alias(k) for k in names])


_PLAIN = {k: v for k, v in INTENSITY.items() if k not in ("var", "energy")}
_MIXED_STATISTICS = _volume_statistics_sql(f"(WITH {_MIX} SELECT volume_id, v FROM vox)")


@query(f"SELECT volume_id, {', '.join(f'{k}_ AS {k}_of' for k in _PLAIN)} FROM ({_MIXED_STATISTICS})", nudge=True)
def mixed_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_features(spark, sf_dir, "intensity", {f"{k}_of": v for k, v in _PLAIN.items()})


@query(ORACLE_SQL["glcm_features"].replace(_VOX, _MIX))
def mixed_glcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 25 co-occurrence features within irregular masks."""
    names = {"energy" if k.startswith("angular") else k.rsplit("_", 1)[0]: k for k in catalogue.GLCM}
    return _mixed_features(spark, sf_dir, "glcm", names, [{"step": "discretise", "params": {"method": "FBN", "n_bins": 8}}])


@query(f"""WITH {_MIX}, a AS (SELECT volume_id, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS d FROM vox GROUP BY volume_id),
p AS (SELECT l.volume_id, 1 / sqrt(4 * (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) AS w, l.v AS a, r.v AS b FROM vox l JOIN vox r ON l.volume_id = r.volume_id AND (l.x, l.y, l.z) <> (r.x, r.y, r.z))
SELECT p.volume_id, round(any_value(n) / sum(w) * sum(w * (p.a - mean) * (p.b - mean)) / any_value(d), 6) + 0.0 AS morans_i, round((any_value(n) - 1) / (2 * sum(w)) * sum(w * (p.a - p.b) ** 2) / any_value(d), 6) + 0.0 AS gearys_c
FROM p JOIN a USING (volume_id) GROUP BY p.volume_id""", nudge=True)
def mixed_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed_features(spark, sf_dir, "spatial_intensity", {"morans_i": "morans_i_index_N365", "gearys_c": "gearys_c_measure_NPT7"})


def _emphasis_sql(matrix: str, voxels: str) -> str:
    short = ["short", "long", "gln", "glnn", "sn", "snn", "share", "glv", "sv", "entropy", "low", "high", "short_low", "short_high", "long_low", "long_high"]
    return f"""{matrix}, tot AS (SELECT volume_id, sum(n) AS t FROM mat GROUP BY volume_id), p AS (SELECT volume_id, i, j, n, n / t AS p, t FROM mat JOIN tot USING (volume_id)),
u AS (SELECT volume_id, sum(i * p) AS mi, sum(j * p) AS mj FROM p GROUP BY volume_id), si AS (SELECT volume_id, sum(s * s) AS si FROM (SELECT volume_id, i, sum(n) AS s FROM mat GROUP BY ALL) GROUP BY volume_id),
sj AS (SELECT volume_id, sum(s * s) AS sj FROM (SELECT volume_id, j, sum(n) AS s FROM mat GROUP BY ALL) GROUP BY volume_id)
SELECT volume_id, {", ".join(f"round({e}, 6) + 0.0 AS {k}" for k, e in zip(short, ["sum(p / j ** 2)", "sum(p * j ** 2)", "any_value(si / t)", "any_value(si / t ** 2)", "any_value(sj / t)", "any_value(sj / t ** 2)", f"any_value(t / {voxels})", "sum((i - mi) ** 2 * p)", "sum((j - mj) ** 2 * p)", "-sum(p * log2(p))", "sum(p / i ** 2)", "sum(p * i ** 2)", "sum(p / (i ** 2 * j ** 2))", "sum(p * i ** 2 / j ** 2)", "sum(p * j ** 2 / i ** 2)", "sum(p * i ** 2 * j ** 2)"], strict=True))}
FROM p JOIN u USING (volume_id) JOIN si USING (volume_id) JOIN sj USING (volume_id) GROUP BY volume_id"""


def _as_matrix(name: str) -> str:
    head, _, tail = ORACLE_SQL[name].rpartition("SELECT volume_id, CAST(i AS BIGINT)")
    if not head:
        head, _, tail = ORACLE_SQL[name].rpartition("SELECT volume_id, CAST(g AS BIGINT)")
        return f"{head.rstrip()}, mat AS (SELECT volume_id, CAST(g AS BIGINT){tail})"
    return f"{head.rstrip()}, mat AS (SELECT volume_id, CAST(i AS BIGINT){tail})"


def _shared(family: str) -> Callable:
    def features(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _features(spark, sf_dir, [family], {name: k for k, name in NAMES[family].items() if k != "energy"})

    features.__name__ = f"{family}_features"
    return features


for _f, _n in (("glrlm", "(13 * 64)"), ("glszm", "64"), ("gldzm", "64"), ("ngldm", "64")):
    query(_emphasis_sql(_as_matrix(f"{_f}_matrix"), _n), nudge=True)(_shared(_f))


@query(f"""WITH {_VOX}, {_FBN}, {_NEAR}, l AS (SELECT volume_id, g AS i, count(*) AS n, sum(abs(g - s / k)) AS s FROM near GROUP BY ALL), p AS (SELECT *, n / 64 AS p FROM l),
a AS (SELECT volume_id, sum(p * s) AS ps, sum(s) AS ss, count(*) AS k FROM p GROUP BY volume_id),
g AS (SELECT x.volume_id, sum(x.p * y.p * (x.i - y.i) ** 2) AS c, sum(abs(x.i * x.p - y.i * y.p)) AS b, sum(abs(x.i - y.i) * (x.p * x.s + y.p * y.s) / (x.p + y.p)) AS x, sum((x.p + y.p) * (x.i - y.i) ** 2) AS t
 FROM p x JOIN p y ON x.volume_id = y.volume_id GROUP BY x.volume_id)
SELECT volume_id, round(1 / ps, 6) AS coarseness, round(c / (k * (k - 1)) * ss / 64, 6) AS contrast, round(ps / b, 6) AS busyness, round(x / 64, 6) AS complexity, round(t / ss, 6) AS strength FROM a JOIN g USING (volume_id)""", nudge=True)
def ngtdm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, ["ngtdm"], {k: k.rsplit("_", 1)[0] for k in catalogue.NGTDM})


@query(f"""WITH {_VOX}, a AS (SELECT volume_id, avg(v) AS mean, sum((v - (SELECT avg(v) FROM vox w WHERE w.volume_id = vox.volume_id)) ** 2) AS d FROM vox GROUP BY volume_id),
p AS (SELECT l.volume_id, 1 / sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2) AS w, l.v AS a, r.v AS b FROM vox l JOIN vox r ON l.volume_id = r.volume_id AND (l.x, l.y, l.z) <> (r.x, r.y, r.z))
SELECT volume_id, round(64 / sum(w) * sum(w * (p.a - mean) * (p.b - mean)) / any_value(d), 6) + 0.0 AS morans_i, round(63 / (2 * sum(w)) * sum(w * (p.a - p.b) ** 2) / any_value(d), 6) AS gearys_c
FROM p JOIN a USING (volume_id) GROUP BY volume_id""", nudge=True)
def spatial_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, ["spatial_intensity"], {"morans_i_index_N365": "morans_i", "gearys_c_measure_NPT7": "gearys_c"})


@query(f"""WITH {_VOX}, s AS (SELECT l.volume_id, l.x, l.y, l.z, any_value(l.v) AS v, avg(r.v) AS mean FROM vox l JOIN vox r ON l.volume_id = r.volume_id
 AND (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2 <= 6.2035 ** 2 GROUP BY l.volume_id, l.x, l.y, l.z)
SELECT volume_id, round(max(mean), 6) + 0.0 AS global_peak, round(arg_max(mean, v), 6) + 0.0 AS local_peak FROM s GROUP BY volume_id""", nudge=True)
def local_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, ["local_intensity"], {"global_intensity_peak_0F91": "global_peak", "local_intensity_peak_VJGA": "local_peak"})


@query()
def morphology_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 27 shape features of the voxels above the threshold."""
    v = embedding_volumes(spark, sf_dir).withColumn("morph", F.transform("data", lambda x: F.when(x > -MASK, 1).otherwise(0)))
    return run.run(v, {"shape": Config([{"step": "extract_features", "params": {"families": ["morphology"]}}])})


# A box of a x b x c voxels has a surface of flat faces, four chamfers along each direction and eight corners.
_BOX = f"""WITH {_VOX}, b AS (SELECT vec_id AS volume_id, CAST(2 + vec_id % 3 AS DOUBLE) AS a, CAST(2 + (vec_id // 3) % 3 AS DOUBLE) AS b, CAST(2 + (vec_id // 9) % 3 AS DOUBLE) AS c FROM embeddings),
w AS (SELECT b.volume_id, avg(v) AS mean, sqrt((avg(x) - sum(v * x) / sum(v)) ** 2 + (avg(y) - sum(v * y) / sum(v)) ** 2 + (avg(z) - sum(v * z) / sum(v)) ** 2) AS shift FROM vox JOIN b ON vox.volume_id = b.volume_id AND x < a AND y < b AND z < c GROUP BY b.volume_id),
g AS (SELECT *, a * b * c AS n, a * b * c - (a + b + c - 3) / 2 - 5 / 6.0 AS v, 2 * ((a - 1) * (b - 1) + (b - 1) * (c - 1) + (a - 1) * (c - 1)) + 2 * sqrt(2) * (a + b + c - 3) + sqrt(3) AS s FROM b),
l AS (SELECT *, list_sort([(a * a - 1) / 12 * n / (n - 1), (b * b - 1) / 12 * n / (n - 1), (c * c - 1) / 12 * n / (n - 1)]) AS l FROM g)
SELECT volume_id, """
_BOXED = {
    "volume_voxel_counting": "n", "surface_area": "s", "volume": "v", "surface_to_volume_ratio": "s / v", "compactness_1": "v / (sqrt(pi()) * s ** 1.5)", "compactness_2": "36 * pi() * v ** 2 / s ** 3",
    "spherical_disproportion": "s / (36 * pi() * v ** 2) ** (1 / 3.0)", "sphericity": "(36 * pi() * v ** 2) ** (1 / 3.0) / s", "asphericity": "(s ** 3 / (36 * pi() * v ** 2)) ** (1 / 3.0) - 1",
    "major_axis_length": "4 * sqrt(l[3])", "minor_axis_length": "4 * sqrt(l[2])", "least_axis_length": "4 * sqrt(l[1])", "elongation": "sqrt(l[2] / l[3])", "flatness": "sqrt(l[1] / l[3])",
    "volume_density_aee": "v / (32 / 3.0 * pi() * sqrt(l[1] * l[2] * l[3]))", "volume_density_convex_hull": "1.0", "area_density_convex_hull": "1.0",
    "maximum_3d_diameter": "sqrt((a - 1) ** 2 + (b - 1) ** 2 + (c - 1) ** 2 + 2 * greatest(a, b, c) - 1)", "volume_density_aabb": "v / n", "area_density_aabb": "s / (2 * (a * b + b * c + a * c))",
    "volume_density_ombb": "v / n", "area_density_ombb": "s / (2 * (a * b + b * c + a * c))", "integrated_intensity": "v * mean", "center_of_mass_shift": "shift",
}


@query(_BOX + ", ".join(f"round({e} + {NUDGE!r}, 5) + 0.0 AS {k}" for k, e in _BOXED.items()) + " FROM l JOIN w USING (volume_id)")
def shape_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 of the 27 shape features of boxes of 2 to 4 voxels each way, whose surface is known in closed form."""
    edge = lambda by: (2 + F.floor(F.col("volume_id") / by) % 3).cast("int")
    v = embedding_volumes(spark, sf_dir).select("*", edge(1).alias("_a"), edge(3).alias("_b"), edge(9).alias("_c"))
    inside = lambda x, i: F.when((F.floor(i / 16) < F.col("_a")) & (F.floor(i / 4) % 4 < F.col("_b")) & (i % 4 < F.col("_c")), 1).otherwise(0)
    v = v.withColumn("morph", F.transform("data", inside)).drop("_a", "_b", "_c")
    long = run.run(v, {"c": Config([{"step": "extract_features", "params": {"families": ["morphology"]}}])})
    name = F.regexp_replace("feature_name", "_[A-Z0-9]{4}$", "")
    got = long.groupBy(F.col("subject_id").cast("long").alias("volume_id")).agg(*[F.max(F.when(name == k, F.col("value"))).alias(k) for k in _BOXED])
    return got.select("volume_id", *[(F.round(F.col(k) + NUDGE, 5) + 0.0).alias(k) for k in _BOXED])


@query(f"""WITH {_VOX}, c AS (SELECT volume_id, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(v) AS w, sum(v * x) AS wx, sum(v * y) AS wy, sum(v * z) AS wz FROM vox WHERE m = 1 GROUP BY volume_id)
SELECT volume_id, CAST(n AS DOUBLE) AS voxel_volume, round(sqrt((x - wx / w) ** 2 + (y - wy / w) ** 2 + (z - wz / w) ** 2), 5) AS shift FROM c""")
def centre_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = masked(spark, sf_dir).filter("morph_mask = 1")
    c = v.groupBy("volume_id").agg(F.count("*").cast("double").alias("voxel_volume"), F.sum("v").alias("w"), *[F.avg(k).alias(k) for k in "xyz"], *[F.sum(F.col("v") * F.col(k)).alias(f"w{k}") for k in "xyz"])
    gap = sum(((F.col(k) - F.try_divide(F.col(f"w{k}"), F.col("w"))) ** 2 for k in "xyz"), F.lit(0.0))
    return c.select("volume_id", "voxel_volume", F.round(F.sqrt(gap), 5).alias("shift"))


# --- geometry and filters ------------------------------------------------------------------------------------


@query(f"""WITH {_VOX}, w AS (SELECT * FROM (VALUES (0, 0, 0.5), (0, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)) t(o, i, f))
SELECT volume_id, a.o AS x, b.o AS y, c.o AS z, round(sum(v * a.f * b.f * c.f), 6) + 0.0 AS v FROM vox JOIN w a ON a.i = x JOIN w b ON b.i = y JOIN w c ON c.i = z GROUP BY ALL""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.resample(voxels(embedding_volumes(spark, sf_dir)), (4, 4, 4), (1.0,) * 3, (2.0,) * 3))


@query(f"WITH {_VOX}, k AS (SELECT range AS o FROM range(8)) SELECT volume_id, CAST(a.o AS INT) AS x, CAST(b.o AS INT) AS y, CAST(c.o AS INT) AS z, v FROM k a, k b, k c JOIN vox ON x = a.o // 2 AND y = b.o // 2 AND z = c.o // 2")
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.resample(voxels(embedding_volumes(spark, sf_dir)), (4, 4, 4), (1.0,) * 3, (0.5,) * 3, "nearest").select("volume_id", "x", "y", "z", (F.col("v") + 0.0).alias("v"))


_CUBIC = f"(WITH {', '.join([_VOX, filter_sql.grid(), *filter_sql.cubic_ctes('vox', 'out')])} SELECT volume_id, v FROM out)"


@query(_volume_statistics_sql(_CUBIC), nudge=True)
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity features after cubic resampling to 0.8."""
    return _run_features(spark, sf_dir, [{"step": "resample", "params": {"new_spacing": [0.8, 0.8, 0.8], "interpolation": "cubic"}}], "intensity", INTENSITY)


@query(f"""WITH {_VOX}, i AS (SELECT vec_id AS volume_id FROM embeddings), g AS (SELECT volume_id, a.range AS x, b.range AS y, c.range AS z FROM i, range(4) a, range(4) b, range(4) c),
moved AS (SELECT volume_id, x + 2 AS x, y - 1 AS y, z, v FROM vox)
SELECT g.volume_id, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, CAST(g.z AS INT) AS z, coalesce(v, -1.0) AS v FROM g LEFT JOIN moved ON moved.volume_id = g.volume_id AND moved.x = g.x AND moved.y = g.y AND moved.z = g.z""")
def reposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.reposition(voxels(embedding_volumes(spark, sf_dir)), (2.0, -1.0, 0.0), (1.0,) * 3, (4, 4, 4), (0.0,) * 3, -1.0)


def _merge_sql(rule: str) -> str:
    return f"WITH {_VOX}, s AS (SELECT volume_id // 4 AS case_id, volume_id AS o, x, y, z, CASE WHEN v > 0.05 THEN v ELSE 0 END AS v FROM vox) SELECT case_id, x, y, z, {rule} AS v, count(*) AS sources FROM s WHERE v <> 0 GROUP BY ALL"


def _merge(conflict: str) -> Callable:
    def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = voxels(embedding_volumes(spark, sf_dir)).select(F.expr("volume_id div 4").alias("case_id"), "volume_id", "x", "y", "z", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0).alias("v"))
        return geometry.merge(v, "case_id", "volume_id", conflict)

    merged.__name__ = f"merge_{conflict}"
    return merged


for _c, _r in (("max", "max(v)"), ("min", "min(v)"), ("first", "arg_min(v, o)"), ("last", "arg_max(v, o)")):
    query(_merge_sql(_r))(_merge(_c))


_SEVERAL = f"WITH {_VOX}, s AS (SELECT volume_id // 4 AS case_id, volume_id AS o, dense_rank() OVER (PARTITION BY volume_id // 4 ORDER BY volume_id) AS k, x, y, z, CASE WHEN v > 0.05 THEN v ELSE 0 END AS v FROM vox)"


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(embedding_volumes(spark, sf_dir)).select(F.expr("volume_id div 4").alias("case_id"), "volume_id", "x", "y", "z", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0).alias("v"))


@query(f"{_SEVERAL} SELECT case_id, x, y, z, CAST(min(k) AS DOUBLE) AS v, count(*) AS sources FROM s WHERE v <> 0 GROUP BY ALL")
def merge_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merge(_several(spark, sf_dir), "case_id", "volume_id", "first", relabel=True)


@query(f"{_SEVERAL} SELECT case_id, x, y, z, CASE WHEN max(k) IN (2, 4) THEN 1.0 ELSE 0.0 END AS v, count(*) AS sources FROM s WHERE v <> 0 GROUP BY ALL")
def merge_binarize_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merge(_several(spark, sf_dir), "case_id", "volume_id", "max", binarize=[2, 4], relabel=True)


@query(f"{_SEVERAL} SELECT case_id, x, y, z, CASE WHEN max(v) BETWEEN 0.1 AND 0.2 THEN 1.0 ELSE 0.0 END AS v, count(*) AS sources FROM s WHERE v <> 0 GROUP BY ALL")
def merge_binarize_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.merge(_several(spark, sf_dir), "case_id", "volume_id", "max", binarize=(0.1, 0.2))


def _mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes of two spacings and of several origins."""
    k = F.col("volume_id")
    spacing = F.when(k % 2 == 0, F.array(*[F.lit(1.0)] * 3)).otherwise(F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0)))
    origin = F.array((k % 3 * 1.0).cast("double"), (-(k % 2) * 1.0).cast("double"), F.lit(0.0))
    return embedding_volumes(spark, sf_dir).drop("data").withColumn("spacing", spacing).withColumn("origin", origin)


@query(f"""WITH {_VOX}, h AS (SELECT * FROM (VALUES (0, 0, 0.5), (0, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)) t(o, i, f)), u AS (SELECT * FROM (VALUES (0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)) t(o, i, f)),
w AS (SELECT 0 AS odd, 'x' AS axis, * FROM h UNION ALL SELECT 0, 'y', * FROM h UNION ALL SELECT 0, 'z', * FROM h UNION ALL SELECT 1, 'x', * FROM u UNION ALL SELECT 1, 'y', * FROM h UNION ALL SELECT 1, 'z', * FROM u)
SELECT volume_id, a.o AS x, b.o AS y, c.o AS z, round(sum(v * a.f * b.f * c.f), 6) + 0.0 AS v FROM vox JOIN w a ON a.axis = 'x' AND a.odd = volume_id % 2 AND a.i = x JOIN w b ON b.axis = 'y' AND b.odd = volume_id % 2 AND b.i = y JOIN w c ON c.axis = 'z' AND c.odd = volume_id % 2 AND c.i = z GROUP BY ALL""")
def resample_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To 2 mm, from isotropic volumes and from ones that are coarse along two axes."""
    return rounded(geometry.resample_each(voxels(embedding_volumes(spark, sf_dir)), _mixed_headers(spark, sf_dir), (2.0,) * 3))


@query(f"""WITH {_VOX}, i AS (SELECT vec_id AS volume_id, 4 + vec_id % 2 AS n FROM embeddings), g AS (SELECT volume_id, a.range AS x, b.range AS y, c.range AS z FROM i, range(5) a, range(4) b, range(3) c WHERE a.range < n),
moved AS (SELECT volume_id, x + volume_id % 3 AS x, y - volume_id % 2 AS y, z, v FROM vox)
SELECT g.volume_id, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, CAST(g.z AS INT) AS z, coalesce(v, -1.0) AS v, g.volume_id % 5 = 0 AS turned FROM g LEFT JOIN moved ON moved.volume_id = g.volume_id AND moved.x = g.x AND moved.y = g.y AND moved.z = g.z""")
def reposition_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volume on its own reference grid, whose shape and origin vary; some grids are turned."""
    k = F.col("volume_id")
    head = _mixed_headers(spark, sf_dir).withColumn("spacing", F.array(*[F.lit(1.0)] * 3))
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    turned = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    ref = head.select("volume_id", (4 + k % 2).cast("int").alias("nx"), F.lit(4).alias("ny"), F.lit(3).alias("nz"), "spacing", F.array(*[F.lit(0.0)] * 3).alias("origin"), F.when(k % 5 == 0, F.array(*map(F.lit, turned))).otherwise(F.array(*map(F.lit, eye))).alias("direction"))
    return geometry.on_reference(voxels(embedding_volumes(spark, sf_dir)), head, ref, -1.0)


@query("WITH h AS (SELECT vec_id AS k, CASE WHEN vec_id % 7 = 3 THEN 1.1 ELSE 1.0 END AS s, CASE WHEN vec_id % 5 = 4 THEN 0.5 ELSE 0.0 END AS o FROM embeddings), f AS (SELECT s AS fs, o AS fo FROM h ORDER BY k LIMIT 1) SELECT k AS volume_id, s = fs AND o = fo AS same FROM h, f")
def same_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("volume_id")
    head = embedding_volumes(spark, sf_dir).drop("data").withColumn("spacing", F.array(F.lit(1.0), F.lit(1.0), F.when(k % 7 == 3, 1.1).otherwise(1.0)))
    return geometry.same_geometry(head.withColumn("origin", F.array(F.when(k % 5 == 4, 0.5).otherwise(0.0), F.lit(0.0), F.lit(0.0))))


def _filtered(spark: SparkSession, sf_dir: str, params: dict) -> DataFrame:
    return rounded(run.filtered(embedding_volumes(spark, sf_dir), params))


def _stencil_sql(taps: list[list[tuple[int, float]]]) -> str:
    """Three axes of (offset, weight), zero outside; sums in one join."""
    t = [f"(VALUES {', '.join(f'({o}, CAST({w!r} AS DOUBLE))' for o, w in axis)})" for axis in taps]
    return f"""WITH {_VOX} SELECT a.volume_id, a.x, a.y, a.z, round(sum(coalesce(b.v, 0) * i.w * j.w * k.w), 6) + 0.0 AS v FROM vox a, {t[0]} i(o, w), {t[1]} j(o, w), {t[2]} k(o, w)
LEFT JOIN vox b ON b.volume_id = a.volume_id AND b.x = a.x + i.o AND b.y = a.y + j.o AND b.z = a.z + k.o GROUP BY a.volume_id, a.x, a.y, a.z"""


@query(_stencil_sql([[(o, 1 / 3) for o in (-1, 0, 1)]] * 3))
def filter_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"type": "mean", "support": 3, "boundary": "zero"})


_R2, _R6 = 2**0.5, 6**0.5


@query(_stencil_sql([[(-1, 1 / _R6), (0, 2 / _R6), (1, 1 / _R6)], [(-1, 1 / _R2), (1, -1 / _R2)], [(-1, -1 / _R6), (0, 2 / _R6), (1, -1 / _R6)]]))
def filter_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"type": "laws", "kernels": "L3E3S3", "boundary": "zero"})


@query(_stencil_sql([[(0, 0.5**0.5), (1, 0.5**0.5)]] * 2 + [[(0, 0.5**0.5), (1, -(0.5**0.5))]]))
def filter_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, {"type": "wavelet", "wavelet": "haar", "decomposition": "LLH", "boundary": "zero"})


def _with(*ctes: list[str]) -> str:
    return f"WITH {', '.join([_VOX, filter_sql.grid(), *sum(ctes, [])])} {filter_sql.result('out')}"


for _name, _params, _sql in (
    ("filter_log", {"type": "log", "sigma_mm": 1.0}, _with(filter_sql.log_ctes("vox", "out", "mirror"))),
    ("filter_laws_energy", {"type": "laws", "kernel": "L5E5E5", "rotation_invariant": True, "compute_energy": True}, filter_sql.laws_energy_sql(_VOX)),
    ("filter_gabor", {"type": "gabor", "sigma_mm": 1.0, "lambda_mm": 2.0, "rotation_invariant": True, "delta_theta": 0.7853981633974483, "average_over_planes": True}, filter_sql.gabor_sql(_VOX)),
    ("filter_wavelet_rotated", {"type": "wavelet", "wavelet": "coif1", "level": 2, "rotation_invariant": True}, filter_sql.wavelet_rotated_sql(_VOX, LOW_PASS["coif1"])),
    ("filter_simoncelli", {"type": "simoncelli"}, _with(filter_sql.simoncelli_ctes("vox", "out"))),
    ("filter_riesz", {"type": "riesz", "order": [1, 0, 0]}, _with(filter_sql.riesz_ctes("vox", "out"))),
    ("filter_riesz_third", {"type": "riesz", "order": [1, 1, 1]}, _with(filter_sql.riesz_ctes("vox", "out", (1, 1, 1)))),
    ("filter_riesz_log", {"type": "riesz", "variant": "log", "sigma_mm": 1.0}, _with(filter_sql.log_ctes("vox", "mid", "zero"), filter_sql.riesz_ctes("mid", "out"))),
    ("filter_riesz_simoncelli", {"type": "riesz", "variant": "simoncelli"}, _with(filter_sql.simoncelli_ctes("vox", "mid"), filter_sql.riesz_ctes("mid", "out"))),
):

    def _one(spark: SparkSession, sf_dir: str, params: dict = _params) -> DataFrame:
        return _filtered(spark, sf_dir, params)

    _one.__name__ = _name
    query(_sql)(_one)


# --- configurations, results ---------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}', '{k}')" for i, (f, k) in enumerate((f, k) for f, ks in catalogue.FAMILIES.items() for k in ks)) + ") t(ord, family, feature_name)")
def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.describe(spark).drop("code")


_FEATURES = "(VALUES " + ", ".join(f"('{f}', '{k}')" for f, ks in catalogue.FAMILIES.items() if f not in ("spatial_intensity", "local_intensity") for k in ks) + ") t(family, feature_key)"
_GROUP = "CASE " + " ".join(f"WHEN family = '{f}' THEN '{g}'" for f, g in GROUPS.items()) + " END"


@query(f"""SELECT config, feature_key, regexp_replace(feature_key, '_[A-Z0-9]{{3,4}}(_[0-9]+)?$', '') AS feature_name, regexp_extract(feature_key, '_([A-Z0-9]{{3,4}})(_[0-9]+)?$', 1) AS ibsi_code, family, {_GROUP} AS family_group,
 family IN ({", ".join(f"'{f}'" for f in sorted(NEED_BINS))}) AS requires_discretisation, true AS is_discretised, upper(split_part(config, '_', 2)) AS discretisation_method, CAST(split_part(config, '_', 3) AS DOUBLE) AS discretisation_param,
 true AS is_resampled, '(0.5, 0.5, 0.5)' AS resampling_spacing, 'linear' AS interpolation, false AS is_filtered, CAST(NULL AS VARCHAR) AS filter_type, CAST(NULL AS VARCHAR) AS filter_params
FROM {_FEATURES}, (VALUES ('standard_fbn_8'), ('standard_fbn_16'), ('standard_fbn_32'), ('standard_fbs_8'), ('standard_fbs_16'), ('standard_fbs_32')) c(config)""")
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of the standard configurations, with its names, family and preprocessing."""
    return spark.createDataFrame(described(Configs().resolve(["all_standard"])), DESCRIBED)


@query()
def standard_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every volume under the six standard configurations."""
    return run.run(embedding_volumes(spark, sf_dir), Configs().resolve(["all_standard"]))


@query()
def shared_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(plan(Configs().resolve(["all_standard"])), "config string, family string, signature string, reused boolean")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return e.unpivot(["l_returnflag", "l_linestatus"], ["n", "q"], "feature_name", "value").select(F.col("l_returnflag").alias("subject_id"), F.concat(F.lit("c"), "l_linestatus").alias("config"), "feature_name", "value")


_LONG = """l AS (SELECT l_returnflag AS subject_id, 'c' || l_linestatus AS config, unnest(['n', 'q']) AS feature_name, unnest([CAST(count(*) AS DOUBLE), sum(l_quantity)]) AS value FROM lineitem GROUP BY l_returnflag, l_linestatus)"""


@query(f"WITH {_LONG} SELECT subject_id, " + ", ".join(f"max(value) FILTER (config = 'c{s}' AND feature_name = '{f}') AS c{s}__{f}" for s in "FO" for f in "nq") + " FROM l GROUP BY subject_id")
def results_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.wide(_long(spark, sf_dir), columns=[f"c{s}__{f}" for s in "FO" for f in "nq"])


@query(f"WITH {_LONG} SELECT * FROM l")
def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = results.unpivot(results.wide(_long(spark, sf_dir), columns=[f"c{s}__{f}" for s in "FO" for f in "nq"]), ["subject_id"])
    return back.filter("value is not null")


@query(f"WITH {_LONG}, k AS (SELECT DISTINCT subject_id FROM l), g AS (SELECT subject_id, config, feature_name FROM k, (SELECT DISTINCT config, feature_name FROM l)) SELECT subject_id, config, feature_name, coalesce(value, 'nan'::DOUBLE) AS value FROM g LEFT JOIN l USING (subject_id, config, feature_name)")
def results_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(f"c{s}", f) for s in "FO" for f in "nq"], "config string, feature_name string")
    return results.complete(_long(spark, sf_dir), expected, ["subject_id"]).select("subject_id", "config", "feature_name", "value")


# --- metadata ------------------------------------------------------------------------------------------------


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("study_uid"), F.concat_ws(".", "o_orderkey", "l_returnflag").alias("series_uid"),
        F.col("l_returnflag").alias("modality"), F.date_format("o_orderdate", "yyyyMMdd").alias("study_date"), F.col("l_linenumber").alias("instance_number"),
    )


_INST = """i AS (SELECT o_custkey AS patient_id, o_orderkey AS study_uid, o_orderkey || '.' || l_returnflag AS series_uid, l_returnflag AS modality, strftime(o_orderdate, '%Y%m%d') AS study_date, l_linenumber AS instance_number
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {_INST} SELECT patient_id, count(DISTINCT study_uid) AS num_studies, count(DISTINCT series_uid) AS num_series, count(*) AS num_instances, min(study_date) AS earliest_study_date, max(study_date) AS latest_study_date FROM i GROUP BY patient_id")
def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.patients(_instances(spark, sf_dir))


@query(f"WITH {_INST} SELECT patient_id, study_uid, count(DISTINCT series_uid) AS num_series, count(*) AS num_instances, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities, min(study_date) AS study_date FROM i GROUP BY patient_id, study_uid")
def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.studies(_instances(spark, sf_dir))


@query(f"WITH {_INST} SELECT patient_id, study_uid, series_uid, count(*) AS num_instances, min(modality) AS modality FROM i GROUP BY ALL")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.series(_instances(spark, sf_dir))


@query(f"WITH {_INST}, e AS (SELECT series_uid, min(instance_number) AS lo, max(instance_number) AS hi, list(DISTINCT instance_number) AS have FROM i GROUP BY series_uid) SELECT series_uid, CAST(k AS INT) AS missing FROM e, unnest(range(lo, hi + 1)) u(k) WHERE NOT list_contains(have, k)")
def missing_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.missing_numbers(_instances(spark, sf_dir))


@query("""WITH g AS (SELECT user_id, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
s AS (SELECT user_id, count(*) AS n, median(gap) AS median_gap, stddev_pop(gap) / avg(gap) AS cv FROM g GROUP BY user_id),
w AS (SELECT g.user_id, count(*) AS gaps FROM g JOIN s ON g.user_id = s.user_id AND gap > median_gap * 1.1 * 1.5 GROUP BY ALL)
SELECT user_id, n, round(median_gap, 4) AS median_gap, coalesce(cv < 0.1, true) AS is_even, coalesce(gaps, 0) AS num_gaps, coalesce(gaps, 0) = 0 AS is_complete FROM s LEFT JOIN w USING (user_id)""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("projection_score"))
    return metadata.completeness(e, "user_id").withColumn("median_gap", F.round("median_gap", 4))


@query("""SELECT user_id AS series_uid, event_id AS sop_uid, CAST(CASE WHEN count(DISTINCT event_type) OVER (PARTITION BY user_id) > 1 THEN dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) ELSE
 row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) END AS INT) AS phase FROM events""")
def split_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_uid"), F.col("event_id").alias("sop_uid"), F.col("event_id").alias("instance_number"), F.unix_date(F.col("ts").cast("date")).alias("projection_score"),
        F.create_map(F.lit("EchoNumbers"), F.col("event_type")).alias("tags"), F.col("event_id").cast("string").alias("file_path"),
    )
    return metadata.split_phases(e).select("series_uid", "sop_uid", "phase")


@query("SELECT user_id, 'k' AS key, min(event_type) AS value FROM events GROUP BY user_id HAVING min(event_type) = max(event_type)")
def common_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.create_map(F.lit("k"), F.col("event_type")).alias("tags"))
    return metadata.common_tags(e, "user_id")


@query("SELECT user_id AS document, event_type AS group_id, 'k' AS measurement_name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value, '1' AS unit FROM events")
def sr_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), F.col("event_type").alias("group_id"), "props")
    return metadata.measurements(e, "props", "document")


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("g"))
    return c.select("conv_id", "n_turns", F.array_join(F.transform("g", lambda x: x["role"]), ">").alias("roles"))


@query("""SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windowed(table(spark, sf_dir, "events"))
    return got.select("start", "end", "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


__all__ = ["HISTOGRAM", "INTENSITY", "IVH", "ORACLE_SQL", "QUERIES"]
