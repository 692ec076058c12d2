from __future__ import annotations

import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quillon.llm.bpe import TrieBpe, encode_documents
from quillon.llm.packing import BestFit, cut, pack_documents
from quillon.llm.tokens import byte_bpe

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    "", "  ", "Don't it's WE'LL'd <|endoftext|> x<|startoftext|>y", "naïve café ½ ² ٣ Ünï İstanbul ΣΑΣ ŉ", "日本語 123", "áé ẛ̣ ſ K Å", "\U0001f468‍\U0001f469 \x85\xa0z\x1cq\x00", "'''sss 12'34", "x" * 3000, "aaaa" * 50 + "!!!???",
    "a\r\n\t\n  b   \n", "ƁƆƊ ꝑ", "\xad­soft",
]


def texts():
    rng = random.Random(4)
    ranges = [(32, 127), (0xA0, 0x180), (0x180, 0x3000), (0x4E00, 0x4F00), (0x1F300, 0x1F600)]
    return TRICKY + ["".join(chr(rng.randrange(*rng.choice(ranges[:k]))) for _ in range(120)) for k in (1, 2, 5) for _ in range(60)]


@pytest.fixture(scope="module")
def trie():
    return TrieBpe(WORD)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_word_bpe_equals_the_library(trie):
    full = Tokenizer.from_file(WORD)
    for text, (ids, decoded) in zip(texts(), trie.encode_all(texts())):
        expected = full.encode(text, add_special_tokens=False).ids
        assert ids == packed(expected), repr(text)
        assert decoded == full.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_word_bpe_property(some):
    full, mine = Tokenizer.from_file(WORD) if not hasattr(test_word_bpe_property, "full") else test_word_bpe_property.full, getattr(test_word_bpe_property, "mine", None) or TrieBpe(WORD)
    test_word_bpe_property.full, test_word_bpe_property.mine = full, mine
    for text, (ids, _) in zip(some, mine.encode_all(some)):
        assert ids == packed(full.encode(text, add_special_tokens=False).ids)


def test_forgetting_words_changes_nothing(trie, monkeypatch):
    before = trie.encode_all(TRICKY)
    monkeypatch.setattr("quillon.llm.bpe.KEPT", 1)
    assert trie.encode_all(TRICKY) == before


def test_byte_bpe_equals_the_library():
    full, mine = Tokenizer.from_file(BYTE), byte_bpe(BYTE)
    for text in texts():
        assert mine(text).tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)


def test_encode_documents(docs, odd, nothing):
    full = Tokenizer.from_file(WORD)
    for r, d in zip(encode_documents(docs, WORD).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        ids = full.encode(d["text"], add_special_tokens=False).ids
        assert (r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) == (d["doc_id"], len(ids), packed(ids), full.decode(ids, skip_special_tokens=False))
    got = encode_documents(odd, WORD).toPandas()
    assert len(got) == odd.count() and (got[got.doc_id.isin([1, 2, 3])].n_tokens == 0).all()
    assert encode_documents(nothing, WORD).count() == 0


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 6))
def test_best_fit(lengths, max_open):
    fit, used = BestFit(64, max_open), {}
    for n in lengths:
        at, offset = fit.place(n)
        assert used.get(at, 0) == offset
        used[at] = offset + n
        assert used[at] <= 64 and fit.open <= max_open


def test_best_fit_takes_the_fullest_that_fits():
    fit = BestFit(10, 8)
    assert [fit.place(n)[0] for n in (6, 8, 7, 3, 2, 4)] == [0, 1, 2, 2, 1, 0]


def check_packing(df, got, capacity):
    full = Tokenizer.from_file(BYTE)
    expected = sorted((r["doc_id"] if r["doc_id"] is not None else -1, packed(full.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in df.collect())
    pieces = {}
    for r in got.sort_values(["doc_id", "piece", "start"]).itertuples():
        pieces.setdefault(r.doc_id if r.doc_id == r.doc_id else -1, []).append(r)
    total = 0
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == np.concatenate(([0], np.cumsum(rows.length)[:-1])).tolist() and rows.length.sum() <= capacity
    for doc_id in {i for i, _ in expected}:
        whole = sorted(t for i, t in expected if i == doc_id)
        if len(whole) == 1:
            rows = pieces[doc_id]
            assert [r.piece for r in rows] == list(range(len(rows))) and b"".join(bytes(r.ids) for r in rows) == whole[0]
            assert rows[0].start == 0 and all(r.length == len(r.ids) // 4 for r in rows) and all(r.length == capacity for r in rows[1:])
    total = sum(len(t) // 4 for _, t in expected)
    assert got.length.sum() == total
    return got.sequence_id.nunique(), -(-total // capacity)


def test_packing(docs, odd, nothing):
    used, least = check_packing(docs, pack_documents(docs, BYTE, 2048).toPandas(), 2048)
    assert used <= least + 2
    check_packing(docs, pack_documents(docs, BYTE, 256, max_open=2, window=16).toPandas(), 256)
    check_packing(odd, pack_documents(odd.repartition(3), BYTE, 128).toPandas(), 128)
    assert pack_documents(nothing, BYTE).count() == 0


def plain_best_fit(lengths, capacity, max_open):
    """Bounded-space best-fit with a plain list of open sequences: (sequence, offset) of each piece."""
    open_bins, out, made = [], [], 0  # (free space, when it came to that space, sequence)
    for clock, n in enumerate(lengths):
        fitting = [b for b in open_bins if b[0] >= n]
        if fitting:
            best = min(fitting, key=lambda b: (b[0], -b[1]))
            open_bins.remove(best)
            free, at = best[0], best[2]
        else:
            free, at, made = capacity, made, made + 1
        out.append((at, capacity - free))
        if free - n:
            if len(open_bins) >= max_open:
                open_bins.remove(min(open_bins, key=lambda b: (b[0], -b[1])))
            open_bins.append((free - n, clock, at))
    return out


@pytest.mark.parametrize("max_open", [1, 2, 5, 1000])
def test_best_fit_with_a_limit_that_binds(max_open):
    import random

    from quillon.llm.packing import BestFit

    rng = random.Random(max_open)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 20), 64]) for _ in range(3000)]
    fit = BestFit(64, max_open)
    got = [fit.place(n) for n in lengths]
    assert got == plain_best_fit(lengths, 64, max_open)
    used = {}
    for (at, offset), n in zip(got, lengths):
        assert offset == used.get(at, 0) and offset + n <= 64
        used[at] = offset + n
    assert len(used) >= -(-sum(lengths) // 64) and fit.open <= max_open


def test_a_binding_limit_loses_nothing(spark, docs):
    import public_tokenizers

    from quillon.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    for max_open, window in ((1, 1), (3, 7)):
        got = pack_documents(docs, path, capacity=256, max_open=max_open, window=window).toPandas()
        full = pack_documents(docs, path, capacity=256).toPandas()
        assert got.groupby("doc_id").length.sum().to_dict() == full.groupby("doc_id").length.sum().to_dict()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
        assert got.sequence_id.nunique() >= full.sequence_id.nunique()


def test_tables_in_order_of_length_pack_well(spark):
    """One partition of documents a little over half a sequence, another of ones a little under: they meet in the second pass."""
    from pyspark.sql import functions as F

    from quillon.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, " a" * 139) for i in range(60)] + [(100 + i, " a" * 115) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
    got = pack_documents(df, path, capacity=256).toPandas()
    assert got.sequence_id.nunique() == 60
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 256
    assert sorted(got.doc_id) == sorted(i for i, _ in rows)
    before, packing.BROADCAST = packing.BROADCAST, -1
    try:
        joined = pack_documents(df, path, capacity=256)
        assert joined.agg(F.countDistinct("sequence_id"), F.sum("length")).first() == (60, int(got.length.sum()))
    finally:
        packing.BROADCAST = before
