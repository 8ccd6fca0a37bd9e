"""First-order, histogram and volume-histogram features of groups of values, in grouped SQL.

For regions of any size: all is partial aggregation over shuffles of sums, bin counts or value counts. Percentiles and
volume histograms are exact over value counts, which are ranked in cells of a group's values: cells are cut at
quantiles of all values, so that a group that holds most of them is many cells and many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(values: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, v, n: the only shuffle that grows with the input, and it is combined before it."""
    return values.select(*by, F.col(v).cast("double").alias("v")).groupBy(*by, "v").agg(F.count("*").alias("n"))


def ranked(values: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """by, v, n, upto, all, lo, hi, pv, pn: every distinct value of a group with its count, the number of values up to it,
    the group's size and ends, and the value before it with its count (null for the first).

    Nothing is gathered for a whole group but one row for each of its cells, whose number is bounded.
    """
    c = value_counts(values, by, v).filter("v is not null")
    parts = 4 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = c.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted({x for x in cuts if x == x})
    table = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length(), -1, -1)])
    below = lambda acc, k: (acc + k <= len(cuts)) & (F.get(table, acc + k - 1) < F.col("v"))
    cell = F.aggregate(steps, F.lit(0), lambda acc, k: F.when(below(acc, k), acc + k).otherwise(acc)) if cuts else F.lit(0)
    c = c.withColumn("_cell", cell)
    group = W.partitionBy(*by)
    cells = c.groupBy(*by, "_cell").agg(F.sum("n").alias("_m"), F.min("v").alias("_low"), F.max("v").alias("_top"), F.max_by("n", "v").alias("_top_n"))
    order = group.orderBy("_cell")
    cells = cells.select(
        *[F.col(k).alias(f"_{k}") for k in by], F.col("_cell").alias("__cell"), F.sum("_m").over(group).alias("all"), F.min("_low").over(group).alias("lo"), F.max("_top").over(group).alias("hi"),
        (F.sum("_m").over(order) - F.col("_m")).alias("_before"), F.lag("_top").over(order).alias("_pv"), F.lag("_top_n").over(order).alias("_pn"),
    )
    within = W.partitionBy(*by, "_cell").orderBy("v")
    c = c.select("*", F.sum("n").over(within).alias("_upto"), F.lag("v").over(within).alias("_lv"), F.lag("n").over(within).alias("_ln"))
    got = c.join(cells, _same(by, "_") & (F.col("_cell") == F.col("__cell")))
    return got.select(
        *by, "v", "n", (F.col("_before") + F.col("_upto")).alias("upto"), "all", "lo", "hi",
        F.when(F.col("_ln").isNull(), F.col("_pv")).otherwise(F.col("_lv")).alias("pv"), F.coalesce("_ln", "_pn").alias("pn"),
    )


def _quantile(q: float) -> Column:
    """Exact linear percentile of ranked values."""
    at = (F.col("all") - 1) * F.lit(q)
    value = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    low, high = value(F.floor(at)), value(F.ceil(at))
    part = F.max(at - F.floor(at))
    return low + (high - low) * part


def first_order(values: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """One row for each group with the statistics of functions.intensity.statistics, null where they are undefined."""
    c = ranked(values, by, v)
    x, n = F.col("v"), F.col("n")
    q = c.groupBy(*by).agg(
        F.sum("n").alias("count"), F.try_divide(F.sum(x * n), F.sum("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(x * x * n).alias("energy"),
        *[_quantile(p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)],
    )
    c = value_counts(values, by, v)
    key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]
    cond = key[0]
    for k in key[1:]:
        cond = cond & k
    d = c.join(q.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("mean").alias("_mean"), F.col("p50").alias("_med"), F.col("p10").alias("_p10"), F.col("p90").alias("_p90")), cond)
    dev = x - F.col("_mean")
    mid = x.between(F.col("_p10"), F.col("_p90"))
    two = d.withColumn("_mid", F.when(mid, x)).groupBy(*by).agg(
        (F.sum(dev * dev * n) / F.sum("n")).alias("var"), (F.sum(F.pow(dev, 3) * n) / F.sum("n")).alias("_m3"), (F.sum(F.pow(dev, 4) * n) / F.sum("n")).alias("_m4"),
        (F.sum(F.abs(dev) * n) / F.sum("n")).alias("mad"), (F.sum(F.abs(x - F.col("_med")) * n) / F.sum("n")).alias("medad"),
        F.try_divide(F.sum(F.when(mid, x * n)), F.sum(F.when(mid, n))).alias("_mid_mean"),
    )
    three = d.join(two.select(*[F.col(k).alias(f"__{k}") for k in by], "_mid_mean"), _same(by, "__")).groupBy(*by).agg(
        F.try_divide(F.sum(F.when(mid, F.abs(x - F.col("_mid_mean")) * n)), F.sum(F.when(mid, n))).alias("rmad")
    )
    out = q.join(_renamed(two, by, "_2"), _same(by, "_2")).join(_renamed(three, by, "_3"), _same(by, "_3"))
    std = F.sqrt("var")
    return out.select(
        *by, "count", "mean", "var", F.try_divide(F.col("_m3"), F.pow(F.nullif("var", F.lit(0.0)), F.lit(1.5))).alias("skew"),
        (F.try_divide(F.col("_m4"), F.col("var") * F.col("var")) - 3).alias("kurt"), F.col("p50").alias("median"), "min", "p10", "p90", "max",
        (F.col("p75") - F.col("p25")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), "mad", F.coalesce("rmad", F.lit(0.0)).alias("rmad"), "medad",
        F.try_divide(std, F.col("mean")).alias("cov"), F.try_divide(F.col("p75") - F.col("p25"), F.col("p75") + F.col("p25")).alias("qcod"), "energy",
        F.sqrt(F.col("energy") / F.col("count")).alias("rms"),
    )


def _renamed(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in by else F.col(c) for c in df.columns])


def _same(by: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in by:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


def histogram(bins: DataFrame, by: list[str], g: str = "g") -> DataFrame:
    """by, mode, entropy, uniformity and the gradients over the dense histogram, of each group of bins."""
    c = bins.select(*by, F.col(g).cast("long").alias("g")).groupBy(*by, "g").agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(w)
    c = c.select("*", p.alias("p"), F.min("g").over(w).alias("_lo"), F.max("g").over(w).alias("_hi"))
    base = c.groupBy(*by).agg(
        F.max_by("g", F.struct("n", -F.col("g"))).alias("mode"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum(F.col("p") * F.col("p")).alias("uniformity")
    )
    # Gaps between bins hold zero counts; only the bins next to a filled one can have a gradient.
    near = c.select(*by, "_lo", "_hi", F.explode(F.expr("array(g - 1, g, g + 1)")).alias("g")).filter("g between _lo and _hi and _lo < _hi").distinct()
    at = lambda k: c.select(*by, (F.col("g") - k).alias("g"), F.col("n").alias(f"_n{k + 1}"))
    near = near.join(at(0), [*by, "g"], "left").join(at(-1), [*by, "g"], "left").join(at(1), [*by, "g"], "left").fillna(0, ["_n0", "_n1", "_n2"])
    slope = F.when(F.col("g") == F.col("_lo"), F.col("_n2") - F.col("_n1")).when(F.col("g") == F.col("_hi"), F.col("_n1") - F.col("_n0")).otherwise((F.col("_n2") - F.col("_n0")) / 2)
    # Bins far from any filled one have gradient 0, which is never the extreme: counts rise and fall between the ends.
    s = near.select(*by, "g", slope.cast("double").alias("s"))
    ends = s.groupBy(*by).agg(
        F.max("s").alias("max_grad"), F.max_by("g", F.struct("s", -F.col("g"))).alias("max_grad_at"), F.min("s").alias("min_grad"), F.min_by("g", F.struct("s", "g")).alias("min_grad_at")
    )
    return base.join(ends, by, "left")


def ivh(values: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """Volume histogram of raw values: volume fractions at 10 and 90 % of the range, intensities at 10 and 90 % of the volume, area."""
    c = ranked(values, by, v).select("*", (F.col("all") - F.col("upto") + F.col("n")).alias("_held"))  # count of values >= v
    c = c.select(*by, "v", "n", F.col("all").alias("_all"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_held", F.col("pv").alias("_pv"), (F.col("_held") + F.col("pn")).alias("_ph"))
    at = lambda f: F.sum(F.when(F.col("v") >= F.col("_lo") + f * (F.col("_hi") - F.col("_lo")), F.col("n")).otherwise(0)) / F.max("_all")
    inten = lambda f: F.coalesce(F.min(F.when(F.col("_held") <= F.floor(f * F.col("_all")), F.col("v"))), F.max("v"))
    got = c.groupBy(*by).agg(
        at(0.1).alias("v10"), at(0.9).alias("v90"), inten(0.1).alias("i10"), inten(0.9).alias("i90"),
        F.coalesce(F.sum((F.col("v") - F.col("_pv")) * (F.col("_held") + F.col("_ph")) / 2 / F.col("_all")), F.lit(0.0)).alias("auc"),
    )
    return got.select(*by, "v10", "v90", (F.col("v10") - F.col("v90")).alias("vdiff"), "i10", "i90", (F.col("i10") - F.col("i90")).alias("idiff"), "auc")
