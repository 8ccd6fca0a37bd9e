"""From raw documents to packed training bins, stage by stage; each stage takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import minhash, packing, secrets, substrings, toxicity
from voxframe.llm.common import documents, scratch, staged, unstage

#: Documents are near duplicates from this Jaccard similarity of shingles on, in hundredths; op4 has its own.
NEAR_PERCENT = 80
#: Passages of over 50 words that repeat go, and strings of op5's length.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. Null and empty texts stay; equal texts share a verdict; no rows give no rows; columns stay as they are."""
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the least doc_id. Wordless and null texts and rows without an id all stay; columns stay."""
    return minhash.one_of_each(docs, NEAR_PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages but their first places go from the texts; no row goes. Null texts stay null; n_chars follows the text; columns stay."""
    return substrings.without_repeats(docs, min_words=PASSAGE_WORDS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no row goes. Null texts stay null; n_chars follows the text; columns stay."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in bins, by pieces; null and empty texts take one token, equal rows are packed apart, no rows give no rows."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The toxicity model, the passages' places and the packing order have no form in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's own tables, and the documents it has read, go when its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            new = keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        unstage(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
