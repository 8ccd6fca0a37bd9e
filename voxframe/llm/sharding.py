"""Jump consistent hashing (Lamping and Veach, 2014): keys to shards without a ring table.

Law `key`: the doc_id and the number of shards decide, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.llm.common import checked_broadcast, in_batches, staged

SHARDS = 24
OVERHEAD = 8
#: Slots are counted in blocks of about so many rows, so that no task sorts a whole shard.
BLOCK_ROWS = 4096

_U = np.uint64


def mix64(keys: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): neighbouring keys become unlike ones; one to one."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + _U(0x9E3779B97F4A7C15)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every unsigned 64-bit key; about ln(shards) rounds over the keys that still jump."""
    key, out = keys.copy(), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    nxt = np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = nxt[live]
            key[live] = key[live] * _U(2862933555777941757) + _U(1)
            step = float(1 << 31) / ((key[live] >> _U(33)).astype(np.float64) + 1.0)
            nxt[live] = np.floor((out[live] + 1) * step).astype(np.int64)
            live = live[nxt[live] < shards]
    return out


def _place(shards: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            key = mix64(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array((key >> _U(1)).astype(np.int64)),
                    pa.array(jump_hash(key, shards).astype(np.int32)),
                    pa.array(jump_hash(key, shards + 1).astype(np.int32)),
                ],
                names=[*b.schema.names, "key", "shard", "grown_shard"],
            )

    return place


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row.

    Slots run from 0 without gaps in each shard, in the order of the mixed key, doc_id, checksum, size. Null
    texts are empty; a null doc_id is placed as 0; rows alike in all of that are interchangeable and take
    neighbouring slots; an empty table gives an empty result; other columns are not looked at. Only three
    numbers of each row move: the texts stay where they are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    got = staged(in_batches(small, _place(shards), "doc_id long, size long, text_crc32 long, key long, shard int, grown_shard int"), "shards")
    bits = max(0, (got.count() // (shards * BLOCK_ROWS)).bit_length())
    got = got.withColumn("block", F.shiftright("key", 63 - bits).cast("int"))
    counts = got.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("_shard"), F.col("block").alias("_block"), F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("shard", "block").orderBy("key", "doc_id", "text_crc32", "size"))
    got = got.withColumn("_at", within)
    out = got.join(checked_broadcast(starts), (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard"
    )
