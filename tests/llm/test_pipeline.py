"""The stages of the pipeline one after the other, on odd rows, on no rows, and on a small table."""

import collections

import corpus_pipeline
import pytest

from voxframe.llm.common import staged


def test_stages(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, sf), f"test-{name}")
            assert docs.columns == columns
        stage(spark, docs, sf).count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert packed.select("doc_id", "piece").count() >= docs.count()


def test_pipeline_keeps_what_it_should(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, sf), "test")
    rows = {r.doc_id: r.text for r in kept.collect()}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(rows)
    tokens = collections.Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    assert all(tokens[d] == len(t.split()) + 1 for d, t in rows.items() if t.isascii())


@pytest.mark.parametrize("name", ["op1_quality", "op3_sharding", "op4_minhash"])
def test_sql(spark, duck, sf, name):
    from voxframe.llm import queries

    got = queries.QUERIES[name](spark, sf)
    r = duck("sf0.001").execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(x[c] for c in sorted(names)) for x in got.collect()))) == sorted(map(str, (tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall())))
