from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture()
def odd(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a long text, and extra columns with names that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    same = "the same words stand here twice for a test of copies and ties in order"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, None, None), (4, same, "en", "a", 70), (5, same, "en", "b", 70), (5, same, "en", "b", 70),
        (None, same, "en", "b", 70), (None, None, None, None, None), (6, "12 34 --", "de", "c", 8), (7, "x", "de", None, 1), (8, long, "fr", "c", len(long)), (9, "Ärger über Öl, naïve façade \U0001f600 中文 <|endoftext|>", "de", "c", 40),
        (20, same + " once more", "en", "z", 80),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("uid", "bucket", "block", "score", "start", "place", "key", "rep", "region", "chunk", "size", "fingerprint"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture()
def nothing(odd):
    return odd.where("false")
