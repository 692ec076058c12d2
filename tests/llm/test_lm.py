from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lm

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*_WORD.findall((text or "").translate(_LOWER)), None]


def check_base(got, rows):
    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    counts = Counter(t for _, text in learned for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (i if i is not None else -1, len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text)), 5)) for i, text in rows
    )
    mine = sorted((int(r.doc_id) if r.doc_id == r.doc_id else -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.itertuples())
    assert [m[:3] for m in mine] == [e[:3] for e in expected]
    assert np.allclose([m[3] for m in mine], [e[3] for e in expected], rtol=1e-9, atol=2e-5)
    assert set(got.train_tokens) <= {n}


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score_documents(docs).toPandas()


def test_base(docs, scored):
    check_base(scored, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in scored.itertuples())


def test_score_is_a_good_model(spark):
    """Over a larger table the held-out texts are likelier under the model than under add-half unigrams, which give unseen words less than nothing to spell."""
    held = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()
    assert held.bits_per_byte.mean() < 2.6


def test_layout_does_not_matter(spark, docs, scored):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        other = lm.score_documents(docs.repartition(3, "source")).toPandas().sort_values("doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    mine = scored.sort_values("doc_id")
    assert np.allclose(other.base_score, mine.base_score, rtol=1e-12) and np.allclose(other.score, mine.score, rtol=1e-9)


def counted(data, classes, before):
    counts = np.zeros((lm.CONTEXTS, lm.TABLE, 2))
    of, _ = lm.predictors(data, classes, before)
    for k in range(lm.CONTEXTS):
        halves = np.zeros(lm.TABLE, np.uint64)
        lm.count_halves(of[k], data, np.ones(len(data), np.uint64), halves)
        counts[k] = lm.cells(halves)
    return counts


def test_spelling_is_a_distribution():
    """The probabilities of a word's next byte sum to one."""
    rng = np.random.default_rng(2)
    data = np.frombuffer(b"the cat and the hat " * 20, np.uint8)
    classes, before = np.zeros(100, np.uint8), np.zeros(100, np.uint32)
    counts = counted(data, classes, before)
    model = lm.Spelling(counts)
    model.learn(data, classes, before, np.ones(100))
    model = lm.Spelling(counts, model.weights + 0.01 * rng.random(model.weights.shape), model.rates)
    cost = lambda word: model.cost(np.frombuffer(word, np.uint8), np.zeros(1 + word.count(b" "), np.uint8), np.zeros(1 + word.count(b" "), np.uint32))
    total = sum(math.exp(cost(b"th" + bytes([b]))[2]) for b in range(256))
    assert abs(total - 1) < 1e-4
    assert cost(b"the ").sum() > cost(b"xqz ").sum()


def test_contexts_stay_in_the_word():
    a, _ = lm.contexts(np.frombuffer(b"xx the", np.uint8))
    b, _ = lm.contexts(np.frombuffer(b"yyyy the", np.uint8))
    assert all((x[3:] == y[5:]).all() for x, y in zip(a, b))
    one = lm.predictors(np.frombuffer(b"xx the ", np.uint8), np.array([1, 2]), np.array([0, 7], np.uint32))[0]
    two = lm.predictors(np.frombuffer(b"yyyy the ", np.uint8), np.array([5, 2]), np.array([9, 7], np.uint32))[0]
    other = lm.predictors(np.frombuffer(b"yyyy the ", np.uint8), np.array([5, 3]), np.array([9, 8], np.uint32))[0]
    assert all((x[3:] == y[5:]).all() for x, y in zip(one, two))
    differ = [k for k in range(lm.CONTEXTS) if (one[k][3:] != other[k][5:]).all()]
    assert differ == sorted({*lm.BY_CLASS, 6})


def brute_tokens(rows, pull):
    """(flags by row, tokens by row) over whole texts: each word's bytes, its class and the hash of the word before, if that foretells."""
    learn = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    words = [[w.encode() for w in tokens(t)[:-1]] for _, t in rows]
    behind: dict[bytes, Counter] = {}
    for ws, ok in zip(words, learn):
        for a, b in zip(ws, ws[1:]):
            if ok:
                behind.setdefault(a, Counter())[b] += 1
    sure = {a for a, c in behind.items() if max(c.values()) >= 2 and 4 * max(c.values()) >= sum(c.values())}
    out = []
    for ws in words:
        place, mine = np.zeros(lm.AXES, np.int64), []
        for i, w in enumerate(ws):
            kind = sum(1 << k for k in range(lm.AXES) if place[k] > 0) + (16 if i else 0)
            hashed = int(lm.word_hashes([ws[i - 1]])[0]) >> 32 | 1 if i and ws[i - 1] in sure else 0
            mine.append((w, kind, hashed))
            for a, b in zip(b" " + w, w + b" "):
                place = place + pull[((a * 251 + b) * 0x9E3779B1 & 0xFFFFFFFF) >> 25]
        out.append(mine)
    return learn, out


def brute_log(model, counts, token):
    """Natural log of one token's probability, bit by bit in plain numbers."""
    word, kind, hashed = token
    data = np.frombuffer(word + b" ", np.uint8)
    of, last = lm.predictors(data, np.array([kind]), np.array([hashed], np.uint32))
    total = 0.0
    for i, byte in enumerate(data.tolist()):
        for place in range(8):
            half, within = (byte >> 4, place) if place < 4 else (byte & 15, place - 4)
            before = 0 if place < 4 else (byte >> 4) + 16
            cell = (1 << within) | (half >> (4 - within))
            bit, node = (byte >> (7 - place)) & 1, (1 << place) | (byte >> (8 - place))
            x, trust = [], []
            for k in range(lm.CONTEXTS):
                at = int(lm.slots(of[k][i : i + 1], np.array([before], np.uint32), len(counts[k]))[0]) + cell
                zero, one = (int(c) for c in counts[k][at])
                x.append(round(min(max(math.log(one + 0.4) - math.log(zero + 0.4), -8), 8) * 15) / 15)
                trust.append((zero + one > 0) + (zero + one > 1) + (zero + one > 6))
            gate = (int(last[i]) * 8 + place) * 16 + trust[5] * 4 + trust[6]
            mixed = sum(a * w for a, w in zip([*x, 1.0], model.weights[gate]))
            level = int(min(max(round((mixed + 8) * 2), 0), 32))
            seen = model.rates[node * 33 + level]
            refined = (seen[1] + 20 / (1 + math.exp(-(level / 2 - 8)))) / (seen.sum() + 20)
            p = 0.5 * (1 / (1 + math.exp(-min(max(mixed, -12), 12))) + refined)
            total += math.log(p if bit else 1 - p)
    return total


def test_score_equals_brute_force(spark):
    """Counts, mixer and scores of a tiny corpus, over every byte of every text one after the other."""
    rng = np.random.default_rng(5)
    names = ["ada", "bo", "cleo", "dünn", "eve", "fo", "gil", "h"]
    rows = [(i, " ".join(x for w in rng.choice(names, 6) for x in ([w, "never alone"] if w == "cleo" else [w]))) for i in range(40)] + [(100, None), (101, " "), (None, "ada bo"), (102, "Ada\tBO zebra 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fitted = lm.Fitted(df, 5, 1, "doc_id", "text")
    learn, of = brute_tokens(rows, fitted.small["pull"])
    counts = np.zeros((lm.CONTEXTS, lm.TABLE, 2))
    for ok, mine in zip(learn, of):
        for word, kind, hashed in mine if ok else ():
            counts += counted(np.frombuffer(word + b" ", np.uint8), np.array([kind]), np.array([hashed], np.uint32))
    assert (counts == fitted.counts).all()
    seen = Counter(t for ok, mine in zip(learn, of) if ok for t in mine)
    order = sorted(seen, key=lambda t: (int(lm.word_hashes([t[0]])[0]), t[1], t[2]))
    model = lm.Spelling(counts)
    model.learn(np.frombuffer(b"".join(w + b" " for w, _, _ in order), np.uint8), np.array([k for _, k, _ in order]), np.array([h for _, _, h in order], np.uint32), np.array([seen[t] for t in order]))
    assert np.allclose(model.average, fitted.weights) and np.allclose(model.rates, fitted.rates)
    got = {r["doc_id"]: r for r in lm.score_documents(df).collect()}
    lengths = [len(m) for ok, m in zip(learn, of) if ok]
    end = lambda n: min(max((sum(lm.lag(np.array([m]))[0] == lm.lag(np.array([n]))[0] for m in lengths) + 0.05) / (sum(lm.lag(np.array([k]))[0] == lm.lag(np.array([n]))[0] for m in lengths for k in range(m + 1)) + 0.1), 1e-9), 1 - 1e-9)
    for (i, _), mine in zip(rows, of):
        expected = sum(brute_log(fitted, counts, t) for t in mine) + sum(math.log(1 - end(k)) for k in range(len(mine))) + math.log(end(len(mine)))
        assert abs(got[i]["score"] - expected / math.log(10)) < 1e-3 * max(1, abs(expected))


def test_blocks_round_trip():
    ids, flags, texts = [3, None, -5], [1, 2, 0], ["é x", None, ""]
    got = lm.unpack_block(lm.pack_block(ids, flags, texts))
    assert got[0] == ids and got[1].tolist() == flags and got[2] == ["é x".encode(), b"", b""]
    x = np.array([[0, 1, 70000], [2, 0, 255]], np.uint64)
    assert (lm._unplanes(lm._planes(x)).reshape(2, 3) == x).all()
    x[0, 0] = 2**40
    assert (lm._unplanes(lm._planes(x)).reshape(2, 3) == x).all()


def test_odd_rows(odd, nothing):
    got = lm.score_documents(odd).toPandas()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_base(got, rows)
    assert np.isfinite(got.score).all() and (got.score < 0).all()
    assert (got[got.doc_id.isin([1, 2, 3])].n_tokens == 1).all()
    assert lm.score_documents(nothing).count() == 0
    unlearned = lm.score_documents(odd.where("doc_id IS NULL")).toPandas()
    assert len(unlearned) == 2 and np.isfinite(unlearned.score).all() and (unlearned.n_known == 0).all()


def test_words_are_scored_behind_the_words_before_them(spark):
    """The order of the words counts, and what follows reliably costs little."""
    rng = np.random.default_rng(3)
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("n", "r", "st", "l", "x")]
    after = dict(zip(names, rng.permutation(names).tolist()))
    rows = [(i, " ".join(f"{w} {after[w]}" for w in rng.choice(names, 40))) for i in range(300)]
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    rows += [(1000 + 10 * i + k, " ".join(rng.permutation(t.split()).tolist())) for i, t in held for k in range(10) if zlib.crc32(str(1000 + 10 * i + k).encode()) % 5 == 1]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    whole, mixed = got[got.doc_id < 1000], got[got.doc_id >= 1000]
    assert len(mixed) and whole.bits_per_byte.mean() < 0.8 * mixed.bits_per_byte.mean()
