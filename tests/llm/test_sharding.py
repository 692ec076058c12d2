from __future__ import annotations

import zlib

import pytest

from quillon.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 97, 1000])
def test_permutation(n):
    assert sorted(sharding.permute(i, n, 5) for i in range(n)) == list(range(n))
    assert n < 40 or [sharding.permute(i, n, 5) for i in range(n)] != list(range(n))


@pytest.mark.parametrize("n", range(1, 60))
def test_landings(n):
    a, b = sharding.dimensions(n)
    ends = dict(sharding.landings(n, 5))
    assert a * b - n < a
    for i in range(n):
        x = sharding._step(i, a, b, 5)
        assert ends.get(x, x) == sharding.permute(i, n, 5)


def test_sizes_and_slots(spark, docs):
    got = sharding.shard_documents(docs, 7).toPandas()
    counts = got.groupby("shard").slot.agg(["count", "min", "max"])
    assert counts["count"].max() - counts["count"].min() <= 1
    assert (counts["max"] == counts["count"] - 1).all() and (counts["min"] == 0).all() and not got.duplicated(["shard", "slot"]).any()
    assert all(sharding.place(r.row_number, len(got), 7, 7919) == (r.shard, r.slot) for r in got.itertuples())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.itertuples():
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "rows")


def test_layout_does_not_matter(docs):
    key = lambda df: sorted(map(tuple, sharding.shard_documents(df, 5).collect()), key=repr)
    assert key(docs) == key(docs.repartition(7, "source")) == key(docs.orderBy("text").coalesce(2))


def test_odd_rows(odd, nothing):
    got = sharding.shard_documents(odd, 4).toPandas()
    assert len(got) == odd.count() and sorted(got.row_number) == list(range(len(got)))
    assert sorted(got[got.doc_id.isin([1, 2])]["size"]) == [16, 16]
    assert sharding.shard_documents(nothing, 4).count() == 0
