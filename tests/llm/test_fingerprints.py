from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from quillon.llm.fingerprints import SAMPLES, fingerprint_documents


def jaccard(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    terms = set(x) | set(y)
    return sum(min(x[t], y[t]) * len(t) for t in terms) / max(1, sum(max(x[t], y[t]) * len(t) for t in terms))


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint_documents(docs).toPandas().set_index("doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = docs.select("doc_id", "text").orderBy("doc_id", ascending=False).collect()
    error = [0.0, 0.0]
    for row, after in zip(rows, rows[1:] + rows[:1]):
        text, cut = row["text"], len(row["text"]) // 3
        edited = text[: len(text) - cut] + after["text"][:cut]
        mine = got.loc[row["doc_id"]]
        assert mine.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and mine.n_chars == len(text)
        for i, (near, true) in enumerate(((mine.near_edited, jaccard(text, edited)), (mine.near_next, jaccard(text, after["text"])))):
            error[i] += near - true
            assert abs(near - true) <= 4.5 * math.sqrt(true * (1 - true) / SAMPLES) + 2 / SAMPLES  # each document: what so many samples allow
        same = sum(mine.fingerprint[4 * i : 4 * i + 4] == mine.edited_fingerprint[4 * i : 4 * i + 4] for i in range(32)) / 32
        assert mine.near_edited == same
    assert abs(error[0] / len(rows)) < 0.03 and abs(error[1] / len(rows)) < 0.03
    for _, group in docs.toPandas().groupby("text"):
        assert got.loc[group.doc_id].fingerprint.nunique() == 1


def test_odd_rows(odd, nothing):
    got = fingerprint_documents(odd).toPandas()
    assert len(got) == odd.count()
    blank = got[got.doc_id.isin([1, 2, 3])]
    assert blank.fingerprint.nunique() == 1
    same = got[got.doc_id.isin([4, 5])]
    assert len(same) == 3 and same.fingerprint.nunique() == 1
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    assert fingerprint_documents(nothing).count() == 0
    lone = fingerprint_documents(odd.where("doc_id = 4")).first()
    assert lone["near_next"] == 1.0
    assert fingerprint_documents(odd.where("doc_id IS NULL")).count() == 2
    assert "Python" not in fingerprint_documents(odd)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("partitions", "shift"), [(1, 0), (6, 0), (6, 40)])
def test_hot_ids_are_dealt_to_several_buckets(spark, partitions, shift):
    """A third of the rows without an id, a third with one id: every row's next is the one behind it, by id and then by the text's hash."""
    from pyspark.sql import functions as F

    from quillon.llm import fingerprints

    rows = [(None, f"lost words {i} and {i * 7 % 13}") for i in range(90)] + [(5000, f"one id {i} for all {i % 11} of them") for i in range(90)] + [(i, f"own id {i} alone {i % 5}") for i in range(0, 9000, 100)]
    rows = [(i if i is None else (i << shift) + i % 7 - (1 << 62) * (shift > 0), t) for i, t in rows]  # ids of up to 63 bits too
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprint_documents(df).collect()
        placed = fingerprints._place(df.withColumn("tie", F.xxhash64("text")), 3 * partitions).where("ghost = 0").groupBy("bucket").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = df.withColumn("tie", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), "tie").collect()
    expected = []
    for row, after in zip(ordered, ordered[1:] + ordered[:1]):
        cut = len(row["text"]) // 3
        expected.append((row["doc_id"], hashlib.sha256((row["text"][: len(row["text"]) - cut] + after["text"][:cut]).encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in got), key=key) == sorted(expected, key=key)
    assert shift or max(r["count"] for r in placed) <= 270 / (3 * partitions) * 3


def test_rows_alike_and_few(spark):
    same = spark.createDataFrame([(1, "same text here")] * 40 + [(None, "none")] * 40, "doc_id long, text string")
    got = fingerprint_documents(same.repartition(3)).collect()
    assert len(got) == 80 and sum(r["near_next"] < 1 for r in got) <= 2
