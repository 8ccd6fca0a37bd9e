"""Suffix-array deduplication of long passages by longest-previous-factor (LPF) arrays.

A passage is a string of MIN_BYTES bytes of the UTF-8 text. Which strings start twice is found without moving the
texts of all documents:

1. Every string's minimal hash of GRAM bytes is an anchor. Strings in a row that share it form a run; equal
   strings have equal anchors, so a run only has to be compared with runs of its anchor. A run travels as an
   anchor, a digest of its bytes, and its place.
2. Runs of equal digests are copies of each other. Where an anchor has runs of several digests, or comes twice
   in a run, one copy of
   each is fetched; a suffix order over these pieces, the previous and the next smaller position in it, and the
   LPF array say which of their strings occur earlier in another piece, and where.
3. Anchors with more than GROUP_BYTES of different pieces are resolved as rows instead, one for each string.

Passages of so many words are found the same way, in texts whose symbols are hashes of words instead of bytes: a string
there is one of equal words, whatever their length and the white space between them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxframe.llm.common import fresh, hot_join, in_batches, likely_in, scratch, shuffle_partitions, staged, unstage

MIN_BYTES = 400
#: Symbols of an anchor, in bytes and in words.
GRAM, WORD_GRAM = 64, 12
#: Bytes that stand for a word where passages are counted in words.
WORD_BYTES = 8
#: Different pieces of one anchor that one task compares, in bytes; beyond, their strings are compared as rows.
GROUP_BYTES = 1_500_000
#: Pieces are compared about so many bytes at a time.
CHUNK_BYTES = 1_000_000
#: Words from so many bytes on are hashed one by one: polynomials of 64 bits have clashes that can be written down, all far longer.
LONG_WORD = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def text_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(29))


_BYTE = _mixed((np.arange(256, dtype=_U) + _U(1)) * _U(0xD6E8FEB86659FD93))


def word_codes(texts: list[str]) -> list[bytes]:
    """The words of each text, each as WORD_BYTES of its hash; the words of all texts at once, byte by byte."""
    raws = [text_bytes(t) for t in texts]
    raw = b"\n".join(raws)
    data = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]])))
    first, size = edge[::2], edge[1::2] - edge[::2]
    h = size.astype(_U)
    with np.errstate(over="ignore"):
        live, k = np.flatnonzero(size < LONG_WORD), 0
        while len(live := live[size[live] > k]):
            h[live] = h[live] * _U(_BASE) + _BYTE[data[first[live] + k]]
            k += 1
    h = _mixed(h)
    for i in np.flatnonzero(size >= LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : first[i] + size[i]], digest_size=WORD_BYTES).digest(), "little")
    ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raws])).tolist()
    return [h[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


def byte_codes(texts: list[str]) -> list[bytes]:
    return [text_bytes(t) for t in texts]


def symbols(raw: bytes, words: bool = False) -> np.ndarray:
    return np.frombuffer(raw, np.uint64 if words else np.uint8)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of `length` symbols, by doubling: no pass depends on the length more than in its logarithm."""
    with np.errstate(over="ignore"):
        h, size = data.astype(np.uint64) + _U(1), 1
        out, have, at = None, 0, 0
        while True:
            if length & size:
                if out is None:
                    out, have = h, size
                else:  # what is there, then this block
                    n = len(data) - have - size + 1
                    out = out[:n] * _U(pow(_BASE, size, 1 << 64)) + h[have : have + n]
                    have += size
            if have == length:
                break
            n = len(data) - 2 * size + 1
            h = h[:n] * _U(pow(_BASE, size, 1 << 64)) + h[size : size + n]
            size *= 2
        return _mixed(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, least: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first start, number of starts, and whether the anchor comes twice, of each run of a text.

    Only where it comes twice can the run hold a string twice itself.
    """
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    gram = min(gram, least)
    grams = window_hashes(data, gram)
    low = sliding_min(grams, least - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    starts = np.diff(np.append(first, len(low)))
    key = np.sort(grams)
    if not (key[1:] == key[:-1]).any():  # as in most texts; sorting values costs a fifth of ranking them
        return low[first].view(np.int64), first, starts, np.zeros(len(first), bool)
    # Places of the anchor within a run: those of equal hashes between its first and its last gram, counted by ranks.
    order = np.argsort(grams, kind="stable")
    key = grams[order]
    lo, hi = np.searchsorted(key, low[first], "left"), np.searchsorted(key, low[first], "right")
    twice = hi - lo > 1
    for i in np.flatnonzero(twice):
        at = order[lo[i] : hi[i]]
        twice[i] = np.searchsorted(at, first[i] + starts[i] + least - gram) - np.searchsorted(at, first[i]) > 1
    return low[first].view(np.int64), first, starts, twice


def _run_rows(least: int, words: bool):
    names = ["v", "s", "uid", "doc_id", "lo", "starts", "twice"]
    codes, width, gram = (word_codes, WORD_BYTES, WORD_GRAM) if words else (byte_codes, 1, GRAM)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, s, u, d, lo, n, w = [], [], [], [], [], [], []
            for uid, doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), codes(b.column(2).to_pylist()), strict=True):
                anchors, first, starts, twice = runs_of(symbols(raw, words), least, gram)
                v.append(anchors)
                lo.append(first)
                n.append(starts)
                w.append(twice)
                for x, k in zip(first.tolist(), starts.tolist(), strict=True):
                    s.append(hashlib.blake2b(raw[width * x : width * (x + k + least - 1)], digest_size=8).digest())
                u += [uid] * len(first)
                d += [doc] * len(first)
            if s:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v)), pa.array(np.frombuffer(b"".join(s), np.int64)), pa.array(u, pa.int64()), pa.array(d, pa.int64()), pa.array(np.concatenate(lo), pa.int64()), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(w))],
                    names=names,
                )

    return rows


def suffix_ranks(data: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix among those of all groups, by group and then by its first `depth` symbols; equal ones share a rank."""
    n = len(data)
    dense = data if data.dtype == np.uint8 else np.unique(data, return_inverse=True)[1]
    rank = np.unique(group.astype(np.int64) * (int(dense.max(initial=0)) + 1) + dense.astype(np.int64), return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < depth:
        step = min(size, depth - size)
        nxt = np.full(n, -1, np.int64)
        nxt[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64)
        size += step
    return rank


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place of a smaller value, -1 if none. All places jump at once, over places already passed."""
    out = np.arange(-1, len(x) - 1)
    live = np.arange(len(x))
    while len(live):
        live = live[out[live] >= 0]
        live = live[x[out[live]] > x[live]]
        out[live] = out[out[live]]
    return out


def longest_previous_factors(rank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending): whether the string of full depth occurs at an earlier start, and that start or -1.

    In suffix order, the longest previous factor of a start is shared with its previous or its next smaller start.
    """
    order = np.argsort(rank[starts], kind="stable")
    at = starts[order]
    prev = previous_smaller(at)
    nxt = len(at) - 1 - previous_smaller(at[::-1])[::-1]
    source = np.full(len(at), -1)
    for near in (nxt, prev):
        ok = (near >= 0) & (near < len(at))
        ok[ok] = rank[at[near[ok]]] == rank[at[ok]]
        source[ok] = at[near[ok]]
    out = np.full(len(at), -1)
    out[order] = source
    return out >= 0, out


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def compare(pieces: list[tuple[int, bytes]], min_bytes: int = MIN_BYTES, words: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every piece (group, bytes), flags over its starts: has a twin in its group; occurs earlier in its group."""
    data = symbols(b"".join(p for _, p in pieces), words)
    sizes = [len(p) // data.itemsize for _, p in pieces]
    ends = np.cumsum(sizes)
    group = np.repeat(np.array([g for g, _ in pieces]), sizes)
    valid = np.ones(len(data), bool)
    for e in ends:
        valid[e - min_bytes + 1 : e] = False
    twin, later = np.zeros(len(data), bool), np.zeros(len(data), bool)
    starts = np.flatnonzero(valid)
    # Only strings whose hash is seen twice need an order; the suffixes they run through are kept.
    with np.errstate(over="ignore"):
        h = window_hashes(data, min_bytes)[starts] ^ (group[starts].astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = starts[count[which] > 1]
    if len(starts):
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + min_bytes, -1)
        keep = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        place = np.searchsorted(keep, starts)
        found, source = longest_previous_factors(suffix_ranks(data[keep], group[keep], min_bytes), place)
        later[starts[found]] = True
        twin[starts[found]] = True
        twin[keep[source[found]]] = True
    return [(twin[e - n : e - min_bytes + 1], later[e - n : e - min_bytes + 1]) for n, e in zip(sizes, ends, strict=True)]


_FOUND = "v long, s long, twins array<struct<a:int,b:int>>, laters array<struct<a:int,b:int>>"


def _compare_rows(min_bytes: int, words: bool):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, int] = {}
        got = compare([(ids.setdefault(v, len(ids)), piece) for v, _, piece in rows], min_bytes, words)
        out = [(v, s, _ranges(t), _ranges(x)) for (v, s, _), (t, x) in zip(rows, got, strict=True) if t.any()]
        if out:
            v, s, t, x = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(t, kind), pa.array(x, kind)], names=["v", "s", "twins", "laters"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for b in batches:
            for v, s, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if v != at and size > CHUNK_BYTES:
                    yield from solve(held)
                    held, size = [], 0
                if v == at and held and s == held[-1][1]:
                    continue  # fetched once more from a repeated row
                at = v
                held.append((v, s, piece))
                size += len(piece)
        if held:
            yield from solve(held)

    return rows


def _cut_pieces(min_bytes: int, words: bool):
    codes, width = (word_codes, WORD_BYTES) if words else (byte_codes, 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, s, doc, lo, piece, wide = [], [], [], [], [], []
            for raw, wanted in zip(codes(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                for x in wanted:
                    v.append(x["v"])
                    s.append(x["s"])
                    doc.append(x["doc_id"])
                    lo.append(x["lo"])
                    wide.append(x["wide"])
                    piece.append(raw[width * x["lo"] : width * (x["lo"] + x["starts"] + min_bytes - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64()), pa.array(piece, pa.binary()), pa.array(wide, pa.bool_())], names=["v", "s", "doc_id", "lo", "piece", "wide"])

    return cut


def _string_rows(min_bytes: int, words: bool):
    """Every string of a piece as a row: its start, and 128 bits of hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, s, doc, lo, piece in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                data = symbols(piece, words)
                one = window_hashes(data, min_bytes)
                two = window_hashes(~data, min_bytes) * _U(0xD6E8FEB86659FD93)
                n = len(one)
                k = lambda x, n=n: pa.array([x] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([k(v), k(s), k(doc), k(lo), pa.array(np.arange(n, dtype=np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["v", "s", "doc_id", "lo", "o", "h", "k"])

    return rows


def _wide_groups(pieces: DataFrame, min_bytes: int, words: bool) -> DataFrame:
    """As _compare_rows, for anchors with too many different pieces for one task: strings meet by their hashes."""
    rows = staged(in_batches(pieces, _string_rows(min_bytes, words), "v long, s long, doc_id long, lo long, o int, h long, k long"), "passages-strings")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "lo", "s", "o")
    met = staged(rows.groupBy("h", "k").agg(F.count("*").alias("_n"), F.min(place).alias("_first")).filter("_n > 1"), "passages-met")
    hit = hot_join(rows, met, ["h", "k"], "_n").select("v", "s", "o", (place != F.col("_first")).alias("later"))
    w = W.partitionBy("v", "s").orderBy("o")

    def ranges(df: DataFrame, name: str) -> DataFrame:
        df = df.select("v", "s", "o", (F.col("o") - F.row_number().over(w)).alias("_i"))
        df = df.groupBy("v", "s", "_i").agg(F.min("o").alias("a"), (F.max("o") + 1).cast("int").alias("b"))
        return df.groupBy("v", "s").agg(F.collect_list(F.struct("a", "b")).alias(name))

    return ranges(hit, "twins").join(ranges(hit.filter("later"), "laters"), ["v", "s"], "left").select("v", "s", "twins", F.coalesce("laters", F.array().cast("array<struct<a:int,b:int>>")).alias("laters"))


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", words: bool = False) -> DataFrame:
    """uid, doc_id, spans of the rows of docs (doc_id, text, uid) that lose bytes; spans (a, b) may overlap.

    keep "none": every place of a string that starts twice goes. keep "first": all but its first place, by
    doc_id and position, goes. With `words`, min_bytes counts words, and spans are those of words. The result is
    staged; the tables on the way to it are freed.
    """
    with scratch(docs.sparkSession) as keep_table:
        return keep_table(staged(_find_spans(docs, min_bytes, keep, words), "passages-found-spans"))


def _find_spans(docs: DataFrame, min_bytes: int, keep: str, words: bool) -> DataFrame:
    spark = docs.sparkSession
    least = 2 * min_bytes - 1 if words else min_bytes
    runs = docs.filter(F.octet_length("text") >= least).select("uid", "doc_id", "text")
    every = staged(in_batches(runs, _run_rows(min_bytes, words), "v long, s long, uid long, doc_id long, lo long, starts long, twice boolean"), "passages-runs")
    # Most anchors come once: from here on only runs count whose anchor comes again, in another run or twice in its own.
    again = every.groupBy("v").agg(F.count("*").alias("all"), F.max("twice").alias("any")).filter("all > 1 or any").select("v", "all")
    runs = staged(hot_join(every, staged(again, "passages-again"), ["v"], "all").drop("all"), "passages-shared")
    unstage(every)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "lo")
    same = runs.groupBy("v", "s").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max("starts").alias("starts"), F.max("twice").alias("twice"))
    same = staged(same, "passages-digests")
    by_v = staged(same.groupBy("v").agg(F.count("*").alias("kinds"), F.sum(F.col("starts") + (min_bytes - 1)).alias("size")), "passages-anchors")
    same = hot_join(same, by_v, ["v"], "kinds")
    same = staged(same.withColumn("mixed", F.expr("kinds > 1 or twice")).filter("n > 1 or mixed"), "passages-kinds")
    want = same.filter("mixed").groupBy(F.col("at.uid").alias("_uid"), F.col("at.doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("v", "s", F.col("at.doc_id").alias("doc_id"), F.col("at.lo").alias("lo"), "starts", (F.col("size") > GROUP_BYTES).alias("wide"))).alias("wanted")
    )
    want = staged(want, "passages-want")
    # One plan at any size: of the texts, little more than the wanted ones move.
    hit = likely_in(docs.select("uid", "doc_id", "text"), "uid", want.select("_uid")).join(want, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    schema = "v long, s long, doc_id long, lo long, piece binary, wide boolean"
    pieces = in_batches(hit.select("text", "wanted"), _cut_pieces(min_bytes, words), schema)
    any_wide = same.filter(F.col("size") > GROUP_BYTES).filter("mixed").limit(1).count() > 0
    if any_wide:
        pieces = staged(pieces, "passages-pieces")
    flat = pieces.filter("not wide").repartition(4 * shuffle_partitions(spark), "v").sortWithinPartitions("v", F.col("doc_id").isNull(), "doc_id", "lo")
    found = in_batches(flat.select("v", "s", "piece"), _compare_rows(min_bytes, words), _FOUND)
    if any_wide:
        found = found.unionByName(_wide_groups(pieces.filter("wide").dropDuplicates(["v", "s"]), min_bytes, words))
    found = staged(found, "passages-found")
    none = F.array().cast("array<struct<a:int,b:int>>")
    hits = same.join(found, ["v", "s"], "left").filter("n > 1 or twins is not null").select(
        "v", "s", "n", "at", F.coalesce("twins", none).alias("twins"), F.coalesce("laters", none).alias("laters")
    )
    got = hot_join(runs, staged(hits, "passages-hits"), ["v", "s"], "n")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("starts").cast("int").alias("b")))
    if keep == "none":
        parts = F.when(F.col("n") > 1, whole).otherwise(F.col("twins"))
    else:
        parts = F.when((F.col("n") > 1) & (place != F.col("at")), whole).otherwise(F.col("laters"))
    spans = F.transform(parts, lambda x: F.struct((F.col("lo") + x["a"]).cast("int").alias("a"), (F.col("lo") + x["b"] + (min_bytes - 1)).cast("int").alias("b")))
    out = got.select("uid", "doc_id", spans.alias("spans")).filter(F.size("spans") > 0)
    return out.groupBy("uid", "doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((s["a"], s["b"]) for s in spans or []):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, b) for a, b in out]


def cut_text(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans, words in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = text_bytes(text)
            m = merged(spans)
            out.append((len(raw), sum(y - x for x, y in m), len(m), hashlib.sha256(cut_text(raw, m)).hexdigest(), sum(y - x for x, y in merged(words))))
        n, r, k, h, w = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.int64()), pa.array(h, pa.string()), pa.array(w, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])


def _with_uid(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("uid"))


def _spans(own: DataFrame, min_bytes: int, keep: str, min_words: int | None) -> DataFrame:
    """_uid, _doc, spans (of bytes), words (spans of words; none without min_words), staged."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    spans = repeated_spans(own, min_bytes, keep).withColumn("words", none)
    if min_words:
        more = repeated_spans(own, min_words, keep, words=True)
        both = spans.unionByName(more.select("uid", "doc_id", none.alias("spans"), F.col("spans").alias("words")))
        spans = both.groupBy("uid", "doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "words")])
    return staged(spans.select(F.col("uid").alias("_uid"), F.col("doc_id").alias("_doc"), "spans", "words"), "passages-spans")


def passage_digests(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", min_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words for each row of docs.

    The last counts the words that lie in a string of min_words words that comes twice (with `keep` "first": not for
    the first time); it is 0 without min_words. Null texts are empty; texts under MIN_BYTES lose nothing; rows that
    repeat a text repeat its passages, the same doc_id or not; an empty table gives an empty result; other columns
    are not looked at.
    """
    own = _with_uid(docs)
    spans = _spans(own, min_bytes, keep, min_words)
    got = own.join(spans, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return in_batches(got.select("doc_id", "text", "spans", "words"), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long")


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole characters of UTF-8."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def word_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as spans of the text's bytes, from the first word to the end of the last one."""
    at = [m.span() for m in _WORD.finditer(raw)] if spans else []
    return [{"a": at[a][0], "b": at[b - 1][1]} for a, b in spans]


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "first", min_words: int | None = None) -> DataFrame:
    """docs without the bytes of repeated passages, in whole characters; by default each passage's first place stays.

    A passage is a string of min_bytes, and with min_words also so many words, be they shorter than that. All rows
    and columns of docs stay; n_chars, if there, follows the text; null texts stay null.
    """
    spans = _spans(_with_uid(docs), min_bytes, keep, min_words)
    u, d, s, w = (fresh(x, docs) for x in ("uid", "doc", "spans", "words"))
    spans = spans.toDF(u, d, s, w)
    key = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    names, schema = docs.columns, docs.schema
    got = docs.join(spans, (key == F.col(u)) & F.col("doc_id").eqNullSafe(F.col(d)), "left").select(*[F.col(f"`{c}`") for c in names], s, w)
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns[:-2]
            texts, hit = [], []
            for text, found, worded in zip(*(b.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True):
                hit.append(bool(found or worded))
                if hit[-1]:
                    raw = text_bytes(text)
                    found = (found or []) + word_spans(raw, merged(worded))
                    text = cut_text(raw, whole_characters(raw, merged(found))).decode("utf-8", "replace")
                texts.append(text)
            if count is not None:
                sizes = [len(x or "") if f else n for x, f, n in zip(texts, hit, cols[count].to_pylist(), strict=True)]
                cols[count] = pa.array(sizes, cols[count].type)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return in_batches(got, cut, schema)
