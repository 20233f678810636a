import pytest

#: Texts with every awkwardness: null, empty, blank, one word, non-ASCII, very long, repeated rows, null id.
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, "Ünï cødé ▁ 日本語 🎉 text with \x00 odd \x85 signs"),
    (7, "long " * 30_000), (8, "x" * 200_000), (9, "the quick brown fox jumps over the lazy dog and runs away from it all today"), (9, "the quick brown fox jumps over the lazy dog and runs away from it all today"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from it all today"), (10, "a line that repeats itself\na line that repeats itself\n\nlast one here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward documents, with extra columns whose names clash with those inside operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("score", "set", "tokens", "label", "_row", "row", "nos", "_score", "n"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{sf}/documents.parquet")
