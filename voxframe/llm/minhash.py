"""MinHash near-duplicate components by circulant MinHash (Li and Li, 2022).

A first permutation spreads the hashed shingles over SPACE places; a second one, circularly shifted by 0, 1, ...,
gives every coordinate of the signature. Bands of coordinates propose, and full shingle sets decide.

Plan: texts of equal words meet by a digest first, so that a group of copies is one member from then on. Members
of a band bucket are tied to the bucket's smallest one, which is linear in the bucket; ties give clusters of
candidates, and exact Jaccard links are looked for within clusters only, without one row for each pair. Clusters
over CLUSTER_ROWS members are no one task's work: there each band bucket ties its members to a pivot, in rounds
that leave out what is one component already, until few pairs are left that share a bucket.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.llm.common import ascii_lower, checked_broadcast, fresh, in_batches, shuffle_partitions, staged, unstage, words_of

SHINGLE = 5
PERCENT = 85
SPACE = 1 << 20
BANDS, ROWS = 40, 7
SEED = 20220204
#: Clusters of at most so many members are resolved by one task; larger ones over all.
CLUSTER_ROWS = 4000
#: Nor may the sets of one task's cluster hold more shingles than this.
CLUSTER_SHINGLES = 4_000_000
#: In large clusters, rounds of pivots end when at most so many pairs for each row of a bucket are open, or a round has closed less than half of them.
OPEN_PAIRS = 4
#: A pivot's set is copied so many times, as one pivot may meet all others.
SALTS = 16
#: Hashed words that a worker remembers during a task.
CACHE = 50_000

_U = np.uint64
_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def permutations(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and pi extended to the left by a turn so that every shift is one contiguous window."""
    if seed not in _TABLE:
        rng = np.random.default_rng(seed)
        sigma = rng.permutation(SPACE).astype(np.int32)
        pi = rng.permutation(SPACE).astype(np.int32)
        _TABLE[seed] = sigma, np.concatenate([pi[-(BANDS * ROWS - 1) :], pi])
    return _TABLE[seed]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the A-Z-lowered words; a shorter text is one shingle; none without words."""
    return shingles_of(words_of(ascii_lower(text)) if text else [], size)


def shingles_of(w: list[str], size: int = SHINGLE) -> np.ndarray:
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < size:
        return np.array([_hash(" ".join(w)) ^ (len(w) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)], np.uint64)
    with np.errstate(over="ignore"):
        h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
        n = len(w) - size + 1
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = (out ^ (h[k : k + n] + _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
            out ^= out >> _U(32)
    return np.unique(out)


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Words(dict):
    """Hashes of words; what is forgotten is hashed again, so the bound changes nothing but the time."""

    def __missing__(self, w: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = _hash(w)
        if len(w) <= 64:
            self[w] = h
        return h


_WORDS = _Words()


def _forget() -> None:
    _WORDS.clear()
    _TABLE.clear()


def signature(shingles: np.ndarray, seed: int = SEED) -> np.ndarray:
    """BANDS * ROWS minima; coordinate k of place i is pi[(sigma(i) - k) mod SPACE]."""
    sigma, pi = permutations(seed)
    k = BANDS * ROWS
    at = sigma[(shingles >> _U(44)).astype(np.int64)]
    windows = np.lib.stride_tricks.sliding_window_view(pi, k)
    out = np.full(k, SPACE, np.int32)
    for lo in range(0, len(at), 4096):
        np.minimum(out, windows[at[lo : lo + 4096]].min(axis=0), out=out)
    return out[::-1]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; the band's number is part of it."""
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
        for col in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
            out = (out ^ (col + _U(0x9E3779B97F4A7C15))) * _U(0xD6E8FEB86659FD93)
            out ^= out >> _U(32)
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        digest, count, bands = [], [], []
        for text in part.column(1).to_pylist():
            w = words_of(ascii_lower(text)) if text else []
            s = shingles_of(w)
            digest.append(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() if w else None)
            count.append(len(s))
            bands.append(band_keys(signature(s)) if w else None)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(digest, pa.binary()), pa.array(count, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "digest", "n_shingles", "bands"],
        )


def components(edges: DataFrame, name: str) -> DataFrame:
    """v, root for every vertex of the edges (a, b): the smallest vertex reachable.

    Each round hooks every vertex to its least neighbour, follows that once more, and contracts the edges to
    the vertices hooked to, without loops and repeats: what a round joins is what is still open, not all edges
    again. Rounds are staged, so their lineage is one table; hot vertices are summed before they are shuffled.
    """
    rest = staged(edges.select("a", "b").distinct(), f"{name}-edges")
    labels = staged(rest.select(F.col("a").alias("v")).union(rest.select("b")).distinct().select("v", F.col("v").alias("root")), f"{name}-0")
    rest, n = rest.filter("a <> b"), 0
    while rest.limit(1).count():
        n += 1
        both = rest.union(rest.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hook = staged(hook, f"{name}-hook-{n}")
        over = hook.select(F.col("v").alias("_at"), F.col("up").alias("_far"))
        up = staged(hook.join(over, F.col("up") == F.col("_at"), "left").select("v", F.least("up", "_far").alias("up")), f"{name}-up-{n}")
        to = lambda df, c: df.join(up.select(F.col("v").alias("_v"), F.col("up").alias(f"_{c}")), F.col(c) == F.col("_v"), "left").drop("_v").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")  # noqa: B023, E731
        less = to(to(rest, "a"), "b").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = staged(less, f"{name}-edges-{n}")
        new = staged(to(labels, "root"), f"{name}-{n}")
        for old in (labels, hook, up):
            unstage(old)
        labels = new
    return labels.select("v", "root")


class Forest:
    """Union-find over 0..n-1; the smaller index is the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = both - len(np.union1d(a, b))
    return 100 * shared >= percent * (both - shared)


def resolve(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Exact link components of a list of sets: for each, the least index of its component.

    Two linked sets share a shingle among the rarest (100 - percent) % of each; only such pairs, near in size
    and not yet in one component, are compared in full.
    """
    if len(sets) == 2:
        return [0, 0 if linked(*sets, percent) else 1]
    forest = Forest(len(sets))
    flat = np.concatenate(sets)
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    start, ends = 0, []
    index: dict[int, list[int]] = defaultdict(list)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for s in sets:
        ends.append((start, start + len(s)))
        start += len(s)
    for i in order:  # by growing size: partners so far are no larger
        lo, hi = ends[i]
        ids = at[lo:hi]
        need = -(-len(ids) * percent // 100)
        rare = ids[np.lexsort((ids, count[ids]))][: len(ids) - need + 1]
        tried = set()
        for t in rare.tolist():
            if count[t] < 2:
                continue
            for j in index[t]:
                if j not in tried:
                    tried.add(j)
                    if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], percent):
                        forest.join(i, j)
            index[t].append(i)
    return [forest.root(i) for i in range(len(sets))]


def _cluster_rows(percent: int):
    """Rows (cluster, doc_id, text) sorted by cluster, doc_id -> (doc_id, root) of each cluster."""

    def solved(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[r] for r in resolve(sets, percent)], pa.int64())], names=["v", "root"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []
        for b in batches:
            for c, d, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != at and ids:
                    yield solved(ids, sets)
                    ids, sets = [], []
                at = c
                ids.append(d)
                sets.append(shingle_set(t))
        if ids:
            yield solved(ids, sets)

    return rows


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["v", "shingles"])


def _linked_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.asarray(b.column(i).values).view(np.uint64) for i in (2, 3))
            at, to = (np.asarray(b.column(i).offsets) for i in (2, 3))
            ok = [linked(one[at[i] : at[i + 1]], two[to[i] : to[i + 1]], percent) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows


def _wide_clusters(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(v, root) for clusters of any size: members (v, n, bands), sets (v, shingles).

    Every round takes one pivot for each band bucket that still holds several components, and confirms the links
    of the bucket's other members to it on full sets: one pair for each row. What a round links is one component
    from then on. When few pairs are open, or rounds close few more, the open pairs are confirmed too: those of members
    that share a bucket and aren't linked yet.
    """
    rows = staged(members.select("v", "n", F.explode("bands").alias("band")), "near-buckets")
    total = rows.count()
    roots = staged(members.select("v", F.col("v").alias("root")).distinct(), "near-roots")
    tried, k, before = None, 0, None

    def confirmed(pairs: DataFrame, salts: int) -> DataFrame:
        """Of the distinct pairs (a, b) those that are linked, on full sets."""
        copies = F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt")
        one = pairs.select("a").distinct().join(sets, F.col("a") == F.col("v")).select(F.col("a").alias("_a"), F.col("shingles").alias("one"), copies)
        salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt"))
        met = salted.join(one, (F.col("a") == F.col("_a")) & (F.col("salt") == F.col("_salt"))).select("a", "b", "one")
        met = met.join(sets.withColumnRenamed("shingles", "two"), F.col("b") == F.col("v")).select("a", "b", "one", "two")
        return in_batches(met, _linked_rows(percent), "a long, b long")

    def fresh_pairs(pairs: DataFrame) -> DataFrame:
        """Distinct pairs near enough in size that weren't confirmed before."""
        fits = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        fits = fits.select("a", "b", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).dropDuplicates(["lo", "hi"])
        return fits.join(tried, ["lo", "hi"], "left_anti") if tried is not None else fits

    while True:
        own = rows.join(roots.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select("band", "v", "n", "root")
        each = own.groupBy("band", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("v"), F.col("n").alias("n"))).alias("p"))
        mixed = each.groupBy("band").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count("*").alias("roots"), F.min(F.struct("p", "root")).alias("x")).filter("roots > 1")
        mixed = staged(mixed.select(F.col("band").alias("_band"), "m", "s", F.col("x.p.v").alias("a"), F.col("x.p.n").alias("na"), F.col("x.root").alias("_root")), f"near-pivots-{k}")
        left = mixed.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2).alias("n")).first()["n"] or 0
        if not left:
            return roots
        last = left <= OPEN_PAIRS * total or (before is not None and 2 * left > before)
        before = left
        if last:
            other = own.select(F.col("band").alias("_band"), F.col("v").alias("b"), F.col("n").alias("nb"), F.col("root").alias("_root"))
            open_ = own.join(mixed.select(F.col("_band").alias("_b")), F.col("band") == F.col("_b"), "left_semi")
            pairs = open_.join(other, (F.col("band") == F.col("_band")) & (F.col("root") < F.col("_root"))).select(F.col("v").alias("a"), "b", F.col("n").alias("na"), "nb")
        else:
            pairs = own.join(mixed, F.col("band") == F.col("_band")).filter("root <> _root").select("a", F.col("v").alias("b"), "na", F.col("n").alias("nb"))
        pairs = staged(fresh_pairs(pairs), f"near-pairs-{k}")
        links = staged(confirmed(pairs, 1 if last else SALTS), f"near-links-{k}")
        if links.limit(1).count():
            to = lambda df, c: df.join(roots.select(F.col("v").alias("_v"), F.col("root").alias(f"_{c}")), F.col(c) == F.col("_v")).drop("_v", c).withColumnRenamed(f"_{c}", c)  # noqa: B023, E731
            up = components(to(to(links, "a"), "b"), f"near-wide-{k}").select(F.col("v").alias("_v"), F.col("root").alias("_up"))
            roots = staged(roots.join(up, F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_up", "root").alias("root")), f"near-roots-{k}")
        if last:
            return roots
        tried = pairs.select("lo", "hi") if tried is None else tried.union(pairs.select("lo", "hi"))
        k += 1


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id and kept.

    Documents are linked if 100 * shared >= percent * united shingles. Null or wordless texts have no shingles
    and are linked with nothing; a row without doc_id keeps a null component and stays; rows that repeat a
    doc_id take the least component of it; an empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    signed = staged(in_batches(docs.select("doc_id", "text"), _sign, "doc_id long, digest binary, n_shingles long, bands array<bigint>", _forget), "near-signed")
    real = signed.filter("doc_id is not null and digest is not null")
    groups = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.max("n_shingles").alias("n"))
    groups = staged(groups, "near-groups")
    reps = groups.select("rep", "n", F.explode("bands").alias("band"))
    buckets = reps.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    ties = staged(reps.join(buckets, "band").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "near-ties")
    if ties.limit(1).count():
        clusters = components(ties, "near-cluster")
        member = clusters.join(groups.select("rep", "n", "bands"), F.col("v") == F.col("rep")).select("v", "root", "n", "bands")
        sizes = clusters.join(groups.select("rep", "n"), F.col("v") == F.col("rep")).groupBy("root").agg(F.count("*").alias("_n"), F.sum("n").alias("_sum"))
        fit = staged(clusters.join(sizes, "root").select("v", "root", ((F.col("_n") <= CLUSTER_ROWS) & (F.col("_sum") <= CLUSTER_SHINGLES)).alias("small")), "near-fit")
        text = docs.select("doc_id", "text").filter("doc_id is not null")
        texts = text.join(checked_broadcast(fit), F.col("doc_id") == F.col("v")).select(F.col("root").alias("cluster"), "doc_id", "text", "small")
        parts = 4 * shuffle_partitions(spark)
        small = texts.filter("small").drop("small").repartition(parts, "cluster").sortWithinPartitions("cluster", "doc_id")
        solved = staged(in_batches(small, _cluster_rows(percent), "v long, root long", _forget), "near-solved")
        wide = fit.filter("not small").select(F.col("v").alias("_v"))
        if wide.limit(1).count():
            sets = in_batches(texts.filter("not small").select("doc_id", "text"), _set_rows, "v long, shingles array<bigint>", _forget)
            sets = staged(sets.distinct(), "near-sets")
            solved = solved.union(_wide_clusters(staged(member.join(wide, F.col("v") == F.col("_v")).select("v", "n", "bands"), "near-members"), sets, percent))
        groups = groups.join(solved.groupBy("v").agg(F.min("root").alias("root")), F.col("rep") == F.col("v"), "left")
        groups = groups.select("digest", F.coalesce("root", "rep").alias("component"))
    else:
        groups = groups.select("digest", F.col("rep").alias("component"))
    out = signed.select("doc_id", "digest", "n_shingles").join(groups.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each near-duplicate component, of the least doc_id, and all columns of docs.

    Rows that share a doc_id are one document, of which the least text stays; rows without doc_id all stay.
    """
    verdict = near_duplicates(docs, percent)
    gone = staged(verdict.filter("not kept").select(F.col("doc_id").alias(fresh("gone", docs))).distinct(), "near-gone")
    out = docs.join(checked_broadcast(gone), F.col("doc_id") == F.col(gone.columns[0]), "left_anti")
    ids = docs.filter("doc_id is not null").select("doc_id")
    if ids.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rank = fresh("rank", docs)
        order = W.partitionBy(F.coalesce(F.col("doc_id"), F.lit(0)), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")
        out = out.select("*", F.row_number().over(order).alias(rank)).filter(F.col("doc_id").isNull() | (F.col(rank) == 1)).drop(rank)
    return out
