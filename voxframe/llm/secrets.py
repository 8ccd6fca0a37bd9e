"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Everything runs in DataFrame functions. Places are code points, ends exclusive: the lengths of what a pattern
matches and of what lies between its matches add up to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import staged, words_column

# The patterns. HEX and ACCESS hold their least length, which leaves the same matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: What the ratio is asked about: runs of LEAST_CHARS or more that lie outside base matches. Those are passed over by
#: the alternatives before the last one, and a run ends where one begins.
LEAST_CHARS = 12
_BASE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|(?<![0-9a-f])[0-9a-f]{16,}"""
CANDIDATE = rf"{_BASE}|(?:(?<![A-Za-z0-9+/_=-])|\G)(?:(?!{_BASE})[A-Za-z0-9+/_=-]){{{LEAST_CHARS},}}+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Fitted on at most so many documents, those of the smallest hashes: base matches in the first, words in the second.
SECRET_DOCS, WORD_DOCS = 20_000, 2_000
PRIOR = 20.0
#: A candidate is a secret if its log-likelihood ratio is at least this, and this for each transition.
LEAST, LEAST_EACH = 10.0, 0.75

_SPAN = "array<struct<start:int,k:int,end:int,s:string>>"


def _starts(gaps: Column, sizes: Column) -> Column:
    """Where each match starts, from what lies before each and how long each is: running sums in blocks of about the
    square root of their number, so that the arrays that a fold copies stay short however many matches a text has."""
    both = F.zip_with(gaps, sizes, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    wide = F.greatest(F.ceil(F.sqrt(F.size(gaps).cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / wide).cast("int")), lambda k: F.slice(both, k * wide + 1, wide))

    def running(of: Column, at: Column, step: Callable[[Column], Column], before: Callable[[Column], Column]) -> Column:
        first = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + step(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + before(x))).alias("out"))
        return F.aggregate(of, first, add, lambda acc: acc["out"])

    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["g"] + x["n"]))
    heads = running(sums, F.lit(0), lambda x: x, lambda x: F.lit(0))
    each = F.zip_with(blocks, heads, lambda block, at: F.struct(block.alias("block"), at.alias("at")))
    return F.flatten(F.transform(each, lambda x: running(x["block"], x["at"], lambda y: y["g"] + y["n"], lambda y: y["g"])))


def _matches(df: DataFrame, pattern: str, k: int, out: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds `out`: the spans of the pattern's leftmost matches, without those that fail `keep`."""
    df = df.select("*", F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)).alias("_m"))
    df = df.select("*", F.when(F.size("_m") > 0, F.split("_text", pattern, -1)).alias("_p"))
    gaps = F.transform(F.slice("_p", F.lit(1), F.size("_m")), lambda x: F.length(x))
    df = df.select("*", F.when(F.size("_m") > 0, _starts(gaps, F.transform("_m", lambda x: F.length(x)))).alias("_at"))
    span = lambda s, at: F.struct(at.alias("start"), F.lit(k).alias("k"), (at + F.length(s)).cast("int").alias("end"), s.alias("s"))
    spans = F.coalesce(F.zip_with("_m", "_at", span), F.array().cast(_SPAN))
    df = df.select("*", spans.alias("_all")).drop("_m", "_p", "_at")
    if keep is not None:
        return df.select("*", F.filter("_all", keep).alias(out)).drop("_all")
    return df.withColumnRenamed("_all", out)


def base_spans(df: DataFrame) -> DataFrame:
    """Adds _assign, _access and _hex to a table with _text."""
    df = _matches(df, ASSIGN, 0, "_assign", lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= 12)
    df = _matches(df, ACCESS, 1, "_access")
    return _matches(df, HEX, 2, "_hex")


def _bigrams(tokens: Column) -> Column:
    """All pairs of neighbouring characters of an array of strings."""
    return F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))))


def _counts(df: DataFrame, tokens: Column) -> dict[str, int]:
    """Counts of bigrams within ALPHABET; at most len(ALPHABET) ** 2 sums come to the driver."""
    grams = df.select(F.explode(_bigrams(tokens)).alias("g")).filter(F.col("g").rlike("^[A-Za-z0-9+/_=-]{2}$"))
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()}


def markov(counts: dict[str, int], prior: float = PRIOR) -> list[list[float]]:
    """log P(next | this) over ALPHABET, with `prior` counts spread evenly over each row."""
    out = []
    for a in ALPHABET:
        total = sum(counts.get(a + b, 0) for b in ALPHABET) + prior
        out.append([math.log((counts.get(a + b, 0) + prior / len(ALPHABET)) / total) for b in ALPHABET])
    return out


def train(docs: DataFrame) -> list[float]:
    """log P_random - log P_word of every transition, row by row, from labelled samples.

    Random strings are the values of base matches; ordinary identifiers are all other words of the alphabet, with
    their numbers, paths and dates.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SECRET_DOCS)
    ids = staged(ids.select(F.col("doc_id").alias("_id")), "secrets-sample")
    some = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    found = base_spans(some.select("_text"))
    value = lambda x: F.when(x["k"] == 0, F.regexp_extract(x["s"], ASSIGN, 2)).otherwise(x["s"])
    secrets = _counts(found, F.transform(F.concat("_assign", "_access", "_hex"), value))
    few = staged(ids.orderBy(F.xxhash64("_id"), "_id").limit(WORD_DOCS), "secrets-words")
    part = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _BASE, " ").alias("_text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    part = part.select(words_column(F.col("_text")).alias("_w"))
    words = _counts(part, F.filter("_w", lambda w: w.rlike("^[A-Za-z0-9+/_=-]{3,}[.,;:!?]*$")))
    return [x - y for a, b in zip(markov(secrets), markov(words), strict=True) for x, y in zip(a, b, strict=True)]


def _ratio(token: Column, table: Column) -> Column:
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, ((at(i) - 1) * len(ALPHABET) + at(i + 1)).cast("int"))
    )


def with_spans(df: DataFrame, model: list[float]) -> DataFrame:
    """Adds _base and _spans, sorted by start and kind, to a table with _text.

    A span of the Markov kind is a run of the alphabet, or what is left of one beside base matches, whose ratio is
    high enough; runs without a letter are numbers and no secrets.
    """
    df = base_spans(df)
    df = _matches(df, CANDIDATE, 3, "_some", lambda x: x["s"].rlike("[A-Za-z]") & ~x["s"].rlike(f"^(?:{_BASE})$"))
    df = df.select("*", F.sort_array(F.concat("_assign", "_access", "_hex")).alias("_base"))
    table = F.split(F.lit(",".join(f"{x:.9f}" for x in model)), ",").cast("array<double>")
    rated = F.transform("_some", lambda x: F.struct(x.alias("x"), _ratio(x["s"], table).alias("r")))
    df = df.select("*", rated.alias("_rated"))
    high = F.filter("_rated", lambda y: (y["r"] >= LEAST) & (y["r"] >= LEAST_EACH * (F.length(y["x"]["s"]) - 1)))
    df = df.select("*", F.transform(high, lambda y: y["x"]).alias("_high"))
    # Kinds that overlap one another can leave a candidate a base match's edge; such ones are few.
    free = F.filter("_high", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return df.select("*", F.sort_array(F.concat("_base", free)).alias("_spans"))


def _said(spans: str) -> Column:
    kind = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs.

    Null texts are empty and hold nothing; overlapping spans of different kinds all stay; rows alike get rows
    alike; an empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs)
    got = with_spans(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text")), model)
    return got.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"), F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(_said("_base").cast("binary"), 256).alias("base_sha256"), _said("_spans").alias("spans"),
    )


def _running_max(values: Column) -> Column:
    """The largest value so far, in blocks as in _starts."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / wide).cast("int")), lambda k: F.slice(values, k * wide + 1, wide))

    def running(of: Column, at: Column, late: bool) -> Column:
        first = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct(F.greatest(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.greatest(acc["at"], x) if late else acc["at"])).alias("out"))
        return F.aggregate(of, first, add, lambda acc: acc["out"])

    heads = running(F.transform(blocks, lambda b: F.array_max(b)), F.lit(0), False)
    each = F.zip_with(blocks, heads, lambda block, at: F.struct(block.alias("block"), at.alias("at")))
    return F.when(F.size(values) > 0, F.flatten(F.transform(each, lambda x: running(x["block"], x["at"], True)))).otherwise(F.array().cast("array<int>"))


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with every secret of text replaced by a mark; other columns stay, n_chars (if there) follows the text.

    Overlapping spans share one mark. Null texts stay null, texts without secrets stay as they are, rows alike stay
    alike, and an empty table gives an empty result.
    """
    keep = docs.columns
    safe = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    got = with_spans(safe, train(docs)).select("_row", "_text", "_spans")
    # What lies between spans, cut from blocks of the text: a cut costs as much as lies before it.
    ends = F.transform("_spans", lambda x: x["end"])
    latest = _running_max(ends)
    starts = F.concat(F.transform("_spans", lambda x: x["start"]), F.array(F.lit(2**31 - 1)))
    froms = F.concat(F.array(F.lit(0)), latest)
    cuts = F.zip_with(froms, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    got = got.select("*", F.filter(cuts, lambda x: x["a"] <= x["b"]).alias("_cut"))
    wide = F.ceil(F.sqrt(F.size("_cut").cast("double"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cut") - 1) / wide).cast("int")), lambda k: F.slice("_cut", k * wide + 1, wide))
    block = lambda x: F.struct(x.alias("cuts"), x[0]["a"].alias("lo"), F.substring("_text", x[0]["a"] + 1, F.element_at(x, -1)["b"] - x[0]["a"]).alias("t"))
    inner = lambda x: F.transform(x["cuts"], lambda c: F.substring(x["t"], c["a"] - x["lo"] + 1, c["b"] - c["a"]))
    parts = F.flatten(F.transform(F.transform(blocks, block), inner))
    new = F.when(F.size("_spans") > 0, F.array_join(parts, mark)).otherwise(F.col("_row.text"))
    got = got.select("_row", new.alias("_new"))
    cols = []
    for c in keep:
        if c == "text":
            cols.append(F.col("_new").alias(c))
        elif c == "n_chars":
            cols.append(F.coalesce(F.length("_new"), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"_row.`{c}`").alias(c))
    return got.select(*cols)
