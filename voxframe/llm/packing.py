"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

A bin holds no two pieces of one source and no two of one duplicate cluster; both are bits of its bitmaps. Open
bins are ordered by residual, and the successor search starts at the piece's length and goes on to the next
larger residual until the tightest bin without a conflict is found; of equally tight ones, the one that has had its
residual longest. Documents longer than a bin are cut at its size, so no token is dropped.

Packing runs in shares of the documents that are dealt by hash, so neither a large source nor a large cluster
lands in one task, and a task's memory is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import in_batches, shuffle_partitions, words_column

CAPACITY = 4096
#: Documents that one share holds, about.
SHARE_ROWS = 8192
#: Sources and clusters with more pieces in a share than this get residual maps of the bins that are free of them.
FREQUENT = 32


class Bins:
    """Open bins by residual, with bitmaps of what they hold."""

    def __init__(self, capacity: int, frequent: set[int]) -> None:
        self.capacity = capacity
        self.residual: list[int] = []
        self.holds: list[int] = []  # bitmap of the sources and clusters in a bin
        self.levels: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.open = 0  # bit r: a bin of residual r is open
        self.frequent = sorted(frequent)
        self.free = {t: [0] * (capacity + 1) for t in self.frequent}  # bins of a residual that are free of t
        self.free_map = dict.fromkeys(self.frequent, 0)

    def _enter(self, b: int, sign: int) -> None:
        r = self.residual[b]
        if not r:
            return
        if sign > 0:
            self.levels[r][b] = None
            self.open |= 1 << r
        else:
            del self.levels[r][b]
            if not self.levels[r]:
                self.open &= ~(1 << r)
        held = self.holds[b]
        for t in self.frequent:
            if not held >> t & 1:
                self.free[t][r] += sign
                if self.free[t][r]:
                    self.free_map[t] |= 1 << r
                else:
                    self.free_map[t] &= ~(1 << r)

    def _tightest(self, need: int, tags: tuple[int, ...], bits: int) -> int | None:
        there = self.open >> need
        for t in tags:
            if t in self.free_map:
                there &= self.free_map[t] >> need
        while there:  # successor search over residuals
            low = there & -there
            for b in self.levels[need + low.bit_length() - 1]:
                if not self.holds[b] & bits:
                    return b
            there ^= low
        return None

    def put(self, need: int, tags: tuple[int, ...]) -> tuple[int, int]:
        """Bin and offset of a piece."""
        bits = 0
        for t in tags:
            bits |= 1 << t
        b = self._tightest(need, tags, bits)
        if b is None:
            b = len(self.residual)
            self.residual.append(self.capacity)
            self.holds.append(0)
        else:
            self._enter(b, -1)
        at = self.capacity - self.residual[b]
        self.residual[b] -= need
        self.holds[b] |= bits
        self._enter(b, 1)
        return b, at


def pack(rows: list[tuple[int | None, str | None, int | None, int]], capacity: int = CAPACITY) -> list[tuple]:
    """Rows (doc_id, source, cluster, tokens) -> (row, piece, start, tokens, bin, offset) by best fit, longest first.

    A null source or cluster conflicts with nothing.
    """
    pieces, names = [], {}
    for i, (_, source, cluster, tokens) in enumerate(rows):
        tags = tuple(names.setdefault(x, len(names)) for x in (("s", source), ("c", cluster)) if x[1] is not None)
        for k, start in enumerate(range(0, tokens, capacity)):
            pieces.append((min(capacity, tokens - start), i, k, start, tags))
    count = Counter(t for *_, tags in pieces for t in tags)
    bins = Bins(capacity, {t for t, n in count.most_common(2 * FREQUENT) if n > FREQUENT})
    out = []
    for need, i, k, start, tags in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        b, at = bins.put(need, tags)
        out.append((i, k, start, need, b, at))
    return out


_OUT = "doc_id long, piece int, start long, n_tokens long, bin_id string, bin_offset int"


def _share_rows(capacity: int):
    def solve(share: int, rows: list[tuple]) -> pa.RecordBatch:
        got = sorted(pack(rows, capacity))
        cols = [[rows[i][0] for i, *_ in got], *([g[k] for g in got] for k in (1, 2, 3)), [f"{share}-{g[4]}" for g in got], [g[5] for g in got]]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for share, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if share != at and rows:
                    yield solve(at, rows)
                    rows = []
                at = share
                rows.append(tuple(row))
        if rows:
            yield solve(at, rows)

    return run


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, share_rows: int = SHARE_ROWS, tokens: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, n_tokens, bin_id, bin_offset.

    `tokens` names a column of docs with each document's number of tokens, such as n_tokens of the encoder's digests;
    one end mark is added to it, and null counts as none. Without it tokens are words and one end mark, so null and
    empty texts take one token. Duplicate clusters are texts that are equal; a null source conflicts with none; equal rows are packed apart, as they share a cluster; an empty
    table gives an empty result; other columns are not looked at. Texts are read but don't move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(
        "doc_id", "source",
        F.when(text != "", F.xxhash64(text)).alias("cluster"),
        ((F.coalesce(F.col(f"`{tokens}`"), F.lit(0)) if tokens else F.size(words_column(text))) + 1).cast("long").alias("tokens"),
        F.xxhash64("doc_id", text).alias("dealt"),
    )
    shares = max(1, -(-docs.count() // share_rows))
    rows = small.select(F.pmod("dealt", F.lit(shares)).cast("int").alias("share"), "doc_id", "source", "cluster", "tokens")
    # A task takes several shares one after the other where there are more of them than tasks.
    rows = rows.repartition(min(shares, 4 * shuffle_partitions(docs.sparkSession)), "share").sortWithinPartitions("share", "doc_id", "cluster", "source")
    return in_batches(rows, _share_rows(capacity), _OUT)
