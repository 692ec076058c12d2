from __future__ import annotations

import re

from hypothesis import given, settings, strategies as st

from quillon.llm import personal
from quillon.llm.personal import base_spans, find_personal_data, mask_personal_data, masked

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    valid = {
        "email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(s)[::-1])) % 10 == 0, "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in _PATTERNS.items() for m in re.finditer(p, text) if valid[k](m.group())]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+%_ 0123456789()\n=é:", max_size=60))
def test_base_equals_plain_patterns(text):
    assert base_spans(text) == plain(text)


def test_base_cases():
    for text in ("a@b.c@d.e", "@b.c@d.e", "x@y", "1.2.3.4567.8.9.10", "256.1.1.1 001.002.003.004", "4111 1111-1111 1111", "+1 (386) 555-1234.", "+1" + "2" * 20, "9" * 5000, "a" * 50000 + "@", "+" * 1000 + "1", "..@a.b", "4111111111111111 4111111111111111"):
        assert base_spans(text) == plain(text), text[:40]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call +1 (386) 555-{1000 + i} soon") for i in range(20)]
    rows += [(100 + i, f"please call 38655{i}99 soon") for i in range(3)]  # same context, no base pattern
    rows += [(200 + i, f"chapter 1234{i}6 begins here") for i in range(20)]
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in got[i]["base"]]
        found = [text[s["start"] : s["end"]] for s in got[i]["found"]]
        assert base == plain(text)
        assert found == ([f"38655{i - 100}99"] if 100 <= i < 200 else [])


def test_masked():
    assert masked("a b c", []) == "a b c"
    assert masked("abcdef", [("ip", 3, 5), ("email", 0, 2), ("card", 1, 4)]) == "[EMAIL]f"
    assert masked("x 1 y", [("ip", 2, 3)]) == "x [IP] y"


def test_both_ways_of_masking_agree(spark, monkeypatch, docs):
    before = sorted(map(tuple, mask_personal_data(docs).collect()))
    monkeypatch.setattr(personal, "_BROADCAST", -1)
    assert sorted(map(tuple, mask_personal_data(docs).collect())) == before
    for (doc_id, text, *_, n), r in zip(before, docs.orderBy("doc_id").collect()):
        assert doc_id == r["doc_id"] and n == len(text) and not base_spans(text)


def test_odd_rows(odd, nothing):
    got = find_personal_data(odd).toPandas()
    assert len(got) == odd.count() and got.base.map(len).sum() == 0
    kept = mask_personal_data(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.where("doc_id = 1").first()["text"] is None
    assert find_personal_data(nothing).count() == 0 and mask_personal_data(nothing).count() == 0


def spans_of(text):
    return [(text[a:b], seed) for a, b, _, seed, _ in personal.instances(text, base_spans(text))]


def test_instances_have_no_length_bounds():
    long = "a" * 140 + "@" + "b" * 300 + ".example"
    assert spans_of(f"mail {long} now") == [(long, True)]
    token = "K" * 200 + "7"
    assert spans_of(f"key {token}, then 12345 or 7.") == [(token, False), ("12345", False), ("7", False)]
    assert spans_of("no digits here at all") == []


def test_grouped_identifiers_are_one_instance():
    for text in ("DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "00:1A:2B:3C:4D:5E", "fe80::1ff:fe23:4567:890a", "0171 234 5678", "0171-2345678"):
        assert spans_of(f"number {text} is") == [(text, False)], text
    assert spans_of("id=48213377, day 2024-05-01") == [("48213377", False), ("2024-05-01", False)]
    assert spans_of("a12b:c3 x") == [("a12b", False), ("c3", False)]


def test_contexts_beyond_48_characters_count():
    word = "w" * 60
    a, b = (personal.instances(f"{word}{x} 1234", [])[0][4] for x in "xy")
    assert not set(a) & set(b)


def test_odd_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for text in ("1=" * 200_000, "x" * 400_000 + " 1", "12 " * 150_000, "((((" * 50_000 + "1" + "))))" * 50_000, "1:" * 200_000, "a1," * 100_000, "=" * 400_000 + "1", "1 " + "." * 400_000, "AB12 " + "CDEF " * 50_000):
        personal.instances(text, base_spans(text))
    assert time.perf_counter() - began < 30


def brute_scores(edges, seeds, rounds, confidence, support):
    score = {i: 1.0 for i in seeds}
    for _ in range(rounds):
        accepted = {}
        for p in {p for p, _ in edges}:
            own = [score.get(i, 0.0) for q, i in edges if q == p]
            if sum(own) >= support - 1e-9 and sum(own) / len(own) >= confidence:
                accepted[p] = sum(own) / len(own)
        score = {}
        for p, i in edges:
            if p in accepted:
                score[i] = max(score.get(i, 0.0), accepted[p])
        score.update({i: 1.0 for i in seeds})
    return score


def test_graph_scores_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    edges = sorted({(rng.randrange(25), rng.randrange(120)) for _ in range(420)} | {(100, i) for i in range(60)} | {(101, i) for i in range(0, 40, 2)})
    seeds = sorted(rng.sample(range(120), 75))
    df, first = spark.createDataFrame(edges, "pattern long, instance long"), spark.createDataFrame([(i,) for i in seeds], "instance long")
    for rounds, confidence, support in ((1, 0.6, 3.0), (3, 0.6, 3.0), (4, 0.5, 6.0)):
        got = {r["instance"]: r["score"] for r in personal.score_instances(df, first, rounds, confidence, support).collect()}
        expected = brute_scores(edges, seeds, rounds, confidence, support)
        assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got)
        assert len(got) > len(seeds)


def test_found_spans_equal_brute_force(spark, docs):
    """The whole operator over a table, in plain Python."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rows += [(10_000 + i, f"account holder id: {400 + i} 55{i:02d} {i:04d} end") for i in range(9)] + [(20_000 + i, f"account holder id: +1 (386) 555-{1000 + i} end") for i in range(30)]
    of = {i: personal.instances(t, base_spans(t)) for i, t in rows}
    edges = {(p, x) for found in of.values() for _, _, x, _, patterns in found for p in patterns}
    seeds = {x for found in of.values() for _, _, x, seed, _ in found if seed}
    score = brute_scores(sorted(edges), seeds, personal.ROUNDS, personal.CONFIDENCE, personal.SUPPORT)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {i: sorted({(a, b) for a, b, x, seed, _ in found if not seed and x not in seeds and score.get(x, 0) >= personal.CONFIDENCE - 1e-9}) for i, found in of.items()}
    assert got == expected and all(len(got[10_000 + i]) == 1 for i in range(9))
