import pytest

#: Nulls in any column, empty and blank texts, a long text, ties, repeated rows, and a doc_id with two texts.
LONG = "lorem ipsum dolor sit amet " * 800


@pytest.fixture(scope="session")
def odd_rows():
    copy = " ".join(f"word{k}" for k in range(120))
    near = copy.replace("word60", "other")
    return [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, copy, "en", "a", len(copy)), (5, copy, "de", None, len(copy)), (6, near, "en", "a", len(near)),
        (6, near, "en", "a", len(near)), (7, LONG, "en", "b", len(LONG)), (8, "short text é😀", "fr", "b", 13), (9, 'password = "Zx81kq0Lmn7TrWv2" tail', "en", "a", 35),
        (None, "a row without an id", "en", "a", 19), (10, copy.upper(), "en", "a", len(copy)), (11, "idiot " * 3 + "you are", "en", "b", 25),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3, "lang")
    for name in ("score", "kept", "spans", "uid", "v", "bands", "component_id", "key", "shard", "_text", "_w", "n_words", "rank", "gone", "bucket", "host", "tokens"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
