"""Quality rules: adaptive thresholds from mergeable quantile sketches, in DataFrame functions only.

The sketch of one metric in one (lang, source) group is a histogram over logarithmic buckets of 2 % relative
width: counts add up, so partial sketches of any split of the rows merge to the same sketch, and each quantile
is right within 1 % of its value. Its size depends on the range of the values, not on the rows, so a source
with a third of all rows sends as little as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxframe.llm.common import SPACE, staged, words_column

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
GAMMA = 1.02
#: metric: (numerator, denominator, thousandths of slack, whether low values fail too). A value is numerator * 1000 / denominator, at least.
METRICS = {
    "symbols": ("n_symbols", "word_chars", 60, False),
    "dup_lines": ("n_dup_lines", "n_lines", 400, False),
    "repeats": ("n_repeat_words", "n_words", 180, False),
    "word_length": ("word_chars", "n_words", 1500, True),
}
#: A value fails beyond the median by more than SPREADS times the distance of the outer quartile from it, plus the slack.
SPREADS = 6


def text_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    got = docs.select("doc_id", "lang", "source", text.alias("text"))
    got = got.select("*", words_column(F.col("text")).alias("_w"))
    got = got.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    # Windows are hashed by doubling: words, pairs, and fives of a pair, a pair and a word.
    mix = lambda a, b: F.xxhash64(a, b)
    n = lambda k: F.greatest(F.size("_w") - (k - 1), F.lit(0))
    got = got.select("*", F.zip_with(F.slice("_h", 1, n(2)), F.slice("_h", 2, n(2)), mix).alias("_q"))
    rest = F.zip_with(F.slice("_q", 3, n(5)), F.slice("_h", 5, n(5)), mix)
    got = got.select("*", F.zip_with(F.slice("_q", 1, n(5)), rest, mix).alias("_g"))
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    got = got.select("*", F.when(again, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda e, j: F.coalesce(F.get(F.col("_s"), j)["h"] == e["h"], F.lit(False))
    twice = F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1))
    got = got.select("*", F.sort_array(F.transform(twice, lambda e: e["i"])).alias("_p"))
    covered = F.aggregate(
        F.col("_p"),
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    got = got.select("*", lines.alias("_l"))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return got.select(
        "doc_id", "lang", "source",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(bare)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _value(metric: str) -> Column:
    top, low, _, _ = METRICS[metric]
    return F.when(F.col(low) > 0, F.floor(F.col(top) * 1000 / F.col(low))).otherwise(0).cast("long")


def _bucket(value: Column) -> Column:
    """0 for 0; else 1 + the number of whole powers of GAMMA in the value."""
    import math

    return F.when(value <= 0, 0).otherwise(1 + F.floor(F.log(value.cast("double")) / F.lit(math.log(GAMMA)))).cast("int")


def quantile_sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: the merged sketch of every group. Null languages or sources form groups of their own."""
    long = metrics.select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(_value(m)).alias("bucket")) for m in METRICS])).alias("x"),
    )
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and lo_<metric>, hi_<metric>: the ranges that a text must keep, from the quartiles."""
    by = ("lang", "source", "metric")
    up = sketches.select(
        "*",
        F.sum("n").over(W.partitionBy(*by).orderBy("bucket")).alias("_upto"),
        F.sum("n").over(W.partitionBy(*by)).alias("_all"),
    )
    at = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("bucket")))
    back = lambda b: F.when(b <= 0, 0.0).otherwise(F.pow(F.lit(GAMMA), b - 0.5))
    q = up.groupBy(*by).agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3")).select(
        *by, back(F.col("q1")).alias("q1"), back(F.col("q2")).alias("q2"), back(F.col("q3")).alias("q3")
    )
    cols = []
    for m, (_, _, slack, both) in METRICS.items():
        one = lambda c, m=m: F.max(F.when(F.col("metric") == m, c))
        cols.append(one(F.col("q2") + SPREADS * (F.col("q3") - F.col("q2")) + slack).alias(f"hi_{m}"))
        cols.append(one(F.col("q2") - SPREADS * (F.col("q2") - F.col("q1")) - slack if both else F.lit(-1.0)).alias(f"lo_{m}"))
    return q.groupBy("lang", "source").agg(*cols)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its counts, base_failed, the thresholds' verdict `adaptive_failed`, and kept.

    Null texts are empty (base_failed); null lang or source make a group of their own; equal rows get equal
    rows; an empty table gives an empty result; other columns of docs are not looked at. The counts are staged
    once, so the texts are read once.
    """
    metrics = staged(text_metrics(docs), "quality")
    limits = thresholds(quantile_sketches(metrics))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in limits.columns if c[:3] in ("hi_", "lo_")])
    got = metrics.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    out = F.lit(False)
    for m in METRICS:
        out = out | (_value(m) > F.col(f"hi_{m}")) | (_value(m) < F.col(f"lo_{m}"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return got.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.coalesce(out, F.lit(False)).alias("adaptive_failed"),
        (~base & ~F.coalesce(out, F.lit(False))).alias("kept"),
    )
