"""Queries over the whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import fingerprints, minhash, packing, pages, quality, secrets, sentencepieces, sharding, substrings, toxicity
from voxframe.llm.common import documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 24)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), 85)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's strings of 400 bytes, and beside them n_passage_words: words in repeated passages of over 50 words."""
    return substrings.passage_digests(documents(spark, sf_dir), min_words=51)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(documents(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoding_digests(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_toxicity, op3_sharding, op4_minhash, op5_passages, op6_fingerprints, op7_packing, op8_pages, op9_sentencepiece, op10_secrets)
}

_VALUE = {m: f"CASE WHEN {low} > 0 THEN ({top} * 1000) // {low} ELSE 0 END" for m, (top, low, _, _) in quality.METRICS.items()}
_BACK = "CASE WHEN {0} <= 0 THEN 0.0 ELSE pow(CAST(1.02 AS DOUBLE), CAST({0} AS DOUBLE) - CAST(0.5 AS DOUBLE)) END"
_LIMITS = ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN q2 + {quality.SPREADS} * (q3 - q2) + {slack} END) AS hi_{m}, "
    f"max(CASE WHEN metric = '{m}' THEN {f'q2 - {quality.SPREADS} * (q2 - q1) - {slack}' if both else '-1.0'} END) AS lo_{m}"
    for m, (_, _, slack, both) in quality.METRICS.items()
)
_OUT = " OR ".join(f"({_VALUE[m]}) > hi_{m} OR ({_VALUE[m]}) < lo_{m}" for m in quality.METRICS)



def _crc_table() -> list[int]:
    """The 256 steps of CRC-32, by its polynomial."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


_BYTES = """flatten(list_transform(regexp_extract_all(t, '(?s).'), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] WHEN unicode(c) < 2048 THEN [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)]
  WHEN unicode(c) < 65536 THEN [224 + (unicode(c) >> 12), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)]
  ELSE [240 + (unicode(c) >> 18), 128 + ((unicode(c) >> 12) & 63), 128 + ((unicode(c) >> 6) & 63), 128 + (unicode(c) & 63)] END))"""
_WRAP = "18446744073709551616::UHUGEINT"
_MIX = lambda z, shift, by: f"CAST(CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {by}::UHUGEINT % {_WRAP} AS UBIGINT)"

ORACLE_SQL: dict[str, str] = {
    "op3_sharding": f"""
WITH RECURSIVE b AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT rid, doc_id, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size,
  xor(list_reduce(list_transform({_BYTES}, lambda x: x::BIGINT), lambda a, x: xor(({_crc_table()})[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM b),
z0 AS (SELECT rid, CAST((coalesce(doc_id, 0)::UHUGEINT + 11400714819323198485::UHUGEINT) % {_WRAP} AS UBIGINT) AS z FROM b),
z1 AS (SELECT rid, {_MIX("z", 30, 13787848793156543929)} AS z FROM z0), z2 AS (SELECT rid, {_MIX("z", 27, 10723151780598845931)} AS z FROM z1),
z3 AS (SELECT rid, xor(z, z >> 31) AS key FROM z2),
j AS (SELECT rid, key, -1::BIGINT AS b, 0::BIGINT AS j FROM z3
  UNION ALL SELECT rid, k, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((k >> 33) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT rid, j, CAST((key::UHUGEINT * 2862933555777941757::UHUGEINT + 1) % {_WRAP} AS UBIGINT) AS k FROM j WHERE j < 25)),
s AS (SELECT rid, CAST(max(b) FILTER (b < 24) AS INT) AS shard, CAST(max(b) AS INT) AS grown_shard FROM j GROUP BY rid)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key >> 1, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM c JOIN s USING (rid) JOIN z3 USING (rid)""",
    "op1_quality": rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)
), b AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM m" for m, v in _VALUE.items())}
), s AS (
  SELECT lang, source, metric, CASE WHEN v <= 0 THEN 0 ELSE 1 + CAST(floor(ln(CAST(v AS DOUBLE)) / CAST({math.log(1.02)!r} AS DOUBLE)) AS INT) END AS bucket, count(*) AS n
  FROM b GROUP BY ALL
), u AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS whole FROM s
), q AS (
  SELECT lang, source, metric, {", ".join(f"{_BACK.format(f'min(CASE WHEN upto * 4 >= whole * {k} THEN bucket END)')} AS q{k}" for k in (1, 2, 3))}
  FROM u GROUP BY lang, source, metric
), lim AS (SELECT lang, source, {_LIMITS} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({_OUT}) AS kept
FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source""",
    "op4_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS v, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(root) AS root FROM r GROUP BY v) c ON c.v = d.doc_id""",
}
