"""Cases that only sizes or extremes bring out: ids at both ends, hot ids, one giant cluster, very long texts and broken pages."""

import hashlib

import numpy as np
import pytest

from voxframe.llm import fingerprints, minhash, substrings


def expected_walk(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        out.append((d, len(t), hashlib.sha256(fingerprints.edited(t, after).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(
    "rows",
    [
        [(9 * 10**18, "top"), (-9 * 10**18, "bottom"), *((i, f"text {i}") for i in range(60)), (2**63 - 1, "a"), (-(2**63), "b")],
        [*((7, f"{i:03d} of one id") for i in range(80)), *((i, f"t{i}") for i in range(20)), *((None, f"n{i % 30}") for i in range(50))],
        [(None, None)] * 5,
    ],
)
def test_walk_over_any_ids(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprints.document_fingerprints(df, buckets=8).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got), key=str) == expected_walk(rows)


def test_one_giant_cluster(spark, monkeypatch):
    """A group of near copies beyond CLUSTER_ROWS goes by pivots; chains and members that aren't linked are told apart."""
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", 20)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 300, int(rng.integers(1, 9))):
            w[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for open_pairs in (4, 0):
        monkeypatch.setattr(minhash, "OPEN_PAIRS", open_pairs)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == root


def test_very_long_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(5000)]
    long = " ".join(rng.choice(words, 100_000))
    rows = [(1, long), (2, long[: len(long) // 2] + " end"), (3, "short"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.passage_digests(df).collect()}
    assert got[1].n_removed == got[1].n_bytes == len(long) and got[2].n_removed in (len(long) // 2, len(long) // 2 + 1) and got[3].n_removed == 0
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id: r.n_chars for r in fingerprints.document_fingerprints(df).collect()} == {d: len(t) for d, t in rows}


def test_pages_of_unclosed_tags_take_linear_time():
    import time

    from voxframe.llm import pages

    def seconds(n):
        html = "<body>" + "<div><i>" * n + "text" + "<p>more" * n + "</b></i>" * n
        t = time.process_time()
        assert pages.main_text(html).startswith("text")
        return time.process_time() - t

    seconds(1000)
    small, large = seconds(5_000), seconds(50_000)
    assert large < 30 * small


def test_hot_keys_join_like_others(spark):
    from pyspark.sql import functions as F

    from voxframe.llm.common import hot_join

    left = spark.range(6000).select(F.when(F.col("id") < 3500, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("first"))
    got = hot_join(left, right, ["k"], "n")
    assert got.exceptAll(left.join(right, ["k"])).count() == 0 and got.count() == 6000


def test_scratch_frees_what_is_not_kept(spark):
    import os

    from voxframe.llm.common import scratch, staged

    with scratch(spark) as keep:
        gone = staged(spark.range(3), "test-gone")
        kept = keep(staged(spark.range(4), "test-kept"))
    assert kept.count() == 4 and not os.path.exists(gone._staged_at.removeprefix("file://"))


def test_kept_tables_go_with_the_outer_scratch(spark):
    import os

    from voxframe.llm.common import scratch, staged

    with scratch(spark):
        with scratch(spark) as keep:
            inner = keep(staged(spark.range(3), "test-inner"))
        assert inner.count() == 3
    assert not os.path.exists(inner._staged_at.removeprefix("file://"))


def test_filter_of_keys_loses_none(spark, monkeypatch):
    from pyspark.sql import functions as F

    from voxframe.llm import common

    df = spark.range(-3000, 3000).select(F.when(F.col("id") != 5, F.col("id")).alias("id"), F.lit("x").alias("at"), F.lit("y").alias("bits"), F.lit("z").alias("block"))
    for many, bits in ((0, None), (1, None), (2500, None), (2500, 1)):
        if bits:
            monkeypatch.setattr(common, "FILTER_BITS", bits)
        keys = spark.range(0, 2 * many, 2).select(F.when(F.col("id") != 6, F.col("id")).alias("k"))
        got = common.likely_in(df, "id", keys)
        here = {r.id for r in got.collect()}
        want = {i for i in range(0, min(2 * many, 3000), 2)} - {6}
        assert got.columns == df.columns and want <= here and None not in here
        assert len(here - want) < (500 if many < 2500 else 6000 if bits else 1000)


def test_few_texts_move_for_passages(spark, monkeypatch):
    """Where the wanted texts are too many to be broadcast, the others stay where they are, and no table on the way stays."""
    import glob

    from pyspark.sql import functions as F

    from voxframe.llm.common import shared_folder

    monkeypatch.setattr(substrings, "checked_broadcast", lambda df, **_: df, raising=False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = np.random.default_rng(7)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    p = text(500)
    # One long text that shares its passage, which differs around it, among many that share none.
    rows = [(i, text(4000)) for i in range(400)] + [(1000 + i, text(200) + p + text(200)) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("uid", F.xxhash64("doc_id", "text"))
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def moved():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    docs = docs.localCheckpoint()
    tables = lambda: set(glob.glob(shared_folder(spark).removeprefix("file://") + "/passages-*"))
    before, there = moved(), tables()
    got = {r.doc_id: r.spans for r in substrings.repeated_spans(docs).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(got) == {1000, 1001}
    assert moved() - before < 400 * 4000 / 2
    assert len(tables() - there) == 1


def test_words_hash_alike_wherever_they_stand():
    from voxframe.llm.common import words_of

    rng = np.random.default_rng(8)
    some = ["a", "b", "aa", "ab", "ba", "é", "\x00", "\x00\x00", "\u00a0", "x" * 63, "x" * 64, "x" * 65, "y" * 5000, *(str(i) for i in range(3000))]
    morse = "a"
    while len(morse) < 4096:  # of this and its mirror image, polynomials of 64 bits are equal
        morse += morse.translate({97: "b", 98: "a"})
    some += [morse, morse.translate({97: "b", 98: "a"})]
    text = "".join(w + rng.choice(list(" \t\n\x0b\x0c\r")) * int(rng.integers(1, 3)) for w in rng.choice(some, 20_000))
    one = {}
    for w, h in zip(words_of(text), substrings.symbols(substrings.word_codes([text])[0], True).tolist(), strict=True):
        assert one.setdefault(w, h) == h
    assert len(set(one.values())) == len(one) > 2900
    texts = ["", text, " \n", morse, some[-1], "a\n", "b a", text]
    apart = [substrings.word_codes([t])[0] for t in texts]
    assert substrings.word_codes(texts) == apart and apart[0] == apart[2] == b"" and apart[3] != apart[4]
    assert substrings.word_codes([]) == [] and all(len(c) == substrings.WORD_BYTES * len(words_of(t)) for t, c in zip(texts, apart, strict=True))
