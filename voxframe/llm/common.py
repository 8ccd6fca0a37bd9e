"""What the operators of this subpackage share: words, staging in the shared folder, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: A side of a join is broadcast only if its counted rows are at most this many, and their counted bytes at most those.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16_000_000
#: Bits that a filter of keys has for each key, and at most; Spark's bitmaps are blocks of so many bits.
KEY_BITS, FILTER_BITS, BLOCK_BITS = 16, 8 * BROADCAST_BYTES, 32_768
#: Arrow batches that go to Python hold at most so many bytes (of one row at least) and rows.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def words_column(text: Column) -> Column:
    """Native array of words; null and blank texts give an empty array. One-byte separators keep off the regex engine."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.coalesce(F.array_remove(F.split(text, " "), ""), F.array().cast("array<string>"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session of one machine may leave it unset."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    return "file:///tmp/checkpoints/voxframe"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


#: Where the staged tables of the innermost scratch() are noted.
_NOTED: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    if _NOTED:
        _NOTED[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Frees a staged table that no later plan reads."""
    if path := getattr(df, "_staged_at", None):
        _drop(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frees at its end the tables that were staged within, but those passed to the function it gives, which the next outer scratch() has from then on."""
    _NOTED.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_staged_at", ""))
        return df

    try:
        yield keep
    finally:
        for path in _NOTED.pop():
            if path not in kept:
                _drop(spark, path)
            elif _NOTED:
                _NOTED[-1].append(path)


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about BATCH_BYTES, so that the Python objects of a part stay few, whatever the batch holds."""
    rows = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def in_batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, forget: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow over bounded batches; at a task's end its worker forgets what it has kept and gives its memory back."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(part for b in batches for part in slices(b))
        finally:
            if forget:
                forget()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns a worker's free memory to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Hints a broadcast if df has at most `limit` rows (counted), else leaves the join to shuffle.

    Rows that may be of any length give their bytes as `size`; the sum must then be within BROADCAST_BYTES too.
    """
    if df.limit(limit + 1).count() > limit:
        return df
    if size is not None and (df.agg(F.sum(size).alias("n")).first()["n"] or 0) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of left to right, which has one row for each key and, as `count`, how many rows of left have it.

    Keys of over a quarter of a task's even share are few, whatever the data: they are broadcast, so that their
    rows stay where they are. All others are shuffled. Both tables should be staged, as they are read again.
    """
    parts = 4 * shuffle_partitions(left.sparkSession)
    least = max(1000, int(right.agg(F.sum(count).alias("n")).first()["n"] or 0) // parts)
    hot = right.filter(F.col(count) > least)
    if not hot.limit(1).count():
        return left.join(right, keys)
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(count) <= least), keys)
    return left.join(F.broadcast(hot), keys).unionByName(cold)


def likely_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of df whose key is in keys (one column, staged), and few others: about 1 of KEY_BITS where keys are few.

    A bitmap of hashes is broadcast, of at most FILTER_BITS bits; more keys let more other rows pass, but lose none.
    What a join would drop is thus not shuffled. Rows without a key are in no join, and go.
    """
    blocks = max(1, min(KEY_BITS * keys.count(), FILTER_BITS) // BLOCK_BITS)
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks * BLOCK_BITS))
    b, m, at = fresh("block", df), fresh("bits", df), fresh("slot", df)
    bits = keys.dropna().select(slot(F.col(keys.columns[0])).alias("at")).groupBy(F.expr(f"at div {BLOCK_BITS}").alias(b)).agg(F.bitmap_construct_agg(F.col("at") % BLOCK_BITS).alias(m))
    held = F.expr(f"shiftright(cast(conv(hex(substring(`{m}`, cast(`{at}` % {BLOCK_BITS} div 8 as int) + 1, 1)), 16, 10) as int), cast(`{at}` % 8 as int)) % 2 = 1")
    got = df.filter(F.col(f"`{key}`").isNotNull()).withColumn(at, slot(F.col(f"`{key}`"))).withColumn(b, F.expr(f"`{at}` div {BLOCK_BITS}"))
    return got.join(F.broadcast(bits), b).filter(held).select(*[F.col(f"`{c}`") for c in df.columns])


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
