"""Quartile bucket digests of documents.

Byte triplets of a sliding window are hashed to buckets and counted; every bucket is written as the quartile of
its count (two bits), after one byte for the logarithm of the length. The difference of two digests adds up
bucket steps and length steps and is bounded, so a likeness between 0 and 1 follows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import checked_broadcast, in_batches, shuffle_partitions, staged

BUCKETS = 1024
# Offsets of the triplets that a window of five bytes gives.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Difference of two quartile codes: a step of three counts double.
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
LENGTH_STEP, LENGTH_MOST = 12, 240
#: Where two unlike texts of one language lie, as a share of the largest bucket difference; likeness is 0 from there on.
UNLIKE = 0.3

_U = np.uint32


def bucket_counts(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for k, (x, y, z) in enumerate(TRIPLETS):
            n = len(b) - z
            if n <= 0:
                continue
            h = b[x : x + n] | (b[y : y + n] << _U(8)) | (b[z : z + n] << _U(16)) | _U((k + 1) << 24)
            h = (h ^ (h >> _U(15))) * _U(0x2C1B3C6D)
            h = (h ^ (h >> _U(12))) * _U(0x297A2D39)
            out += np.bincount((h ^ (h >> _U(15))) & _U(BUCKETS - 1), minlength=BUCKETS)
    return out


def length_code(n: int) -> int:
    """0 for nothing, else one more than the length's logarithm in steps of about 10 %."""
    return min(255, 1 + int(math.log(n) / math.log(1.1))) if n else 0


def digest(raw: bytes) -> str:
    """Hexadecimal: one byte of length, then two bits for each bucket. Texts of no triplet keep their bytes apart by a checksum."""
    c = bucket_counts(raw)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (c[:, None] > q[None]).sum(axis=1).astype(np.uint8)
    packed = code[0::4] | (code[1::4] << 2) | (code[2::4] << 4) | (code[3::4] << 6)
    return f"{length_code(len(raw)):02x}" + packed.tobytes().hex()


def codes(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[0]), ((raw[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)


def difference(a: str, b: str) -> int:
    """From 0 to 6 * BUCKETS + LENGTH_MOST."""
    (la, ca), (lb, cb) = codes(a), codes(b)
    steps = abs(la - lb)
    return int(STEP[ca, cb].sum()) + min(LENGTH_MOST, 0 if steps <= 1 else (steps - 1) * LENGTH_STEP)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the difference of unlike texts on."""
    return max(0.0, 1.0 - difference(a, b) / (UNLIKE * 6 * BUCKETS))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, last, doc_id, text), sorted; in each bucket the row marked last only ends it."""
    names = [x.split()[0] for x in _OUT.split(", ")]
    held = None

    def row(doc: int, text: str, mark: str, after: str, next_mark: str) -> tuple:
        new = edited(text, after)
        raw = new.encode("utf-8", "surrogatepass")
        theirs = digest(raw)
        return doc, len(text), hashlib.sha256(raw).hexdigest(), mark, theirs, likeness(mark, theirs), likeness(mark, next_mark)

    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            out = []
            for bucket, last, doc, text in zip(*(b.column(i).slice(lo, 1000).to_pylist() for i in range(4)), strict=True):
                mark = digest(text.encode("utf-8", "surrogatepass"))
                if held is not None and held[0] == bucket:
                    out.append(row(*held[1:], text, mark))
                held = None if last else (bucket, doc, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)


#: Inverse of the relative error of the quantiles that cut the order into ranges.
ACCURACY = 20_000


def _cuts(df: DataFrame, value: Column, n: int) -> list[int]:
    """At most n - 1 distinct long values that part df about evenly, falling; from one mergeable sketch of bounded size."""
    at = [k / n for k in range(1, n)] or [0.5]
    got = df.agg(F.percentile_approx(value, at, ACCURACY).alias("q")).first()["q"]
    return sorted(set(got or []), reverse=True)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many cuts lie above the value, by bisection in an array of them."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    above = lambda acc, s: (acc + s <= len(cuts)) & (F.get(table, acc + s - 1) > value)
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(above(acc, s), acc + s).otherwise(acc))


def _text_key(text: Column) -> Column:
    """The first seven bytes of a text as a number that orders as they do."""
    raw = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(raw, 16, 10).cast("long")


def document_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each row of docs, with its fingerprint, that of its edited text, and their likenesses.

    The next document is the one of the next smaller doc_id (ties: of the next text, in byte order); after the
    last comes the first, which for a single row is itself. Null texts are empty; a null doc_id comes after
    all others; an empty table gives an empty result; other columns are not looked at.

    The order is cut into ranges with about equally many rows at quantiles of doc_id, whatever its distribution;
    rows of one doc_id (or of none) that would fill a range are cut at quantiles of their texts' first bytes. Each
    range is sorted by one task that holds two texts at a time, and is given a copy of the row that follows it.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    buckets = buckets or 2 * shuffle_partitions(spark)
    cuts = _cuts(own.filter("doc_id is not null"), F.col("doc_id"), buckets)
    n = own.agg(F.count("*").alias("n")).first()["n"]
    each = own.groupBy("doc_id").agg(F.count("*").alias("c")).filter(F.col("c") > max(1, n // buckets))  # at most `buckets` ids
    full = [(r["doc_id"], r["c"]) for r in each.collect()]
    cuts = sorted({*cuts, *(d for d, _ in full if d is not None)}, reverse=True)  # a full id is then the last one of its range
    outer = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_place(F.col("doc_id"), cuts))
    within = F.lit(0)
    for doc, c in full:
        own_id = F.col("doc_id").eqNullSafe(F.lit(doc).cast("long"))
        more = _cuts(own.filter(own_id), -_text_key(F.col("text")), 1 + c * buckets // n)
        within = F.when(own_id, _place(-_text_key(F.col("text")), more) + 1).otherwise(within)
    bucket = outer * (buckets + 3) + within
    own = own.select(bucket.cast("int").alias("bucket"), "doc_id", "text")
    # The first row of each range: its doc_id by a scan of ids, its text by a filter on them.
    heads = staged(own.groupBy("bucket").agg(F.max("doc_id").alias("head")), "heads")
    firsts = own.join(checked_broadcast(heads.select(F.col("bucket").alias("_b"), "head")), (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("head")))
    firsts = staged(firsts.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("x")), "firsts")
    order = sorted(r["bucket"] for r in heads.select("bucket").collect())
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range before, and the last before the first
    pairs = spark.createDataFrame([(k, v) for k, v in before.items()] or [(0, 0)], "_after int, _to int")
    ends = firsts.join(F.broadcast(pairs), F.col("bucket") == F.col("_after")).select(F.col("_to").alias("bucket"), F.lit(True).alias("last"), "x.doc_id", "x.text")
    rows = own.select("bucket", F.lit(False).alias("last"), "doc_id", "text").union(ends)
    rows = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").desc_nulls_last(), "text")
    return in_batches(rows, _walk, _OUT)
