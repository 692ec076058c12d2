from __future__ import annotations

import random
import re

import numpy as np
import pytest

from quillon.llm import graph, neardup, setjoin
from quillon.llm.common import Words, shingles

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def sets_of(rows, size):
    out = {}
    for i, text in rows:
        words = _WORD.findall((text or "").translate(_LOWER))
        out[i] = frozenset(zip(*[words[k:] for k in range(size)])) if len(words) >= size else frozenset([tuple(words)] if words else [])
    return out


def components(sets, percent):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and find(a) != find(b):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


def check(df, size, percent=80):
    got = neardup.near_duplicates(df, size, percent).toPandas()
    sets = sets_of([(r["doc_id"], r["text"]) for r in df.collect()], size)
    expected = components(sets, percent)
    assert dict(zip(got.doc_id, got.component_id)) == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got.itertuples())
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i] or i, i)
    assert all(r.class_id == first[sets[r.doc_id] or r.doc_id] for r in got.itertuples())


@pytest.mark.parametrize("size", [2, 5])
def test_table(docs, size):
    check(docs.select("doc_id", "text"), size)


def near_copies(n, words=120, seed=3):
    """Copies of one text, each edited its own way: most are near the text, few near each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_large_group_in_tiles(spark):
    rows = near_copies(300) + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2)


def test_threshold_is_exact(spark):
    """Sets of 9 and 10 one-word shingles that share 8: 8 / 11; that share 9: 9 / 10. At exactly 80 in 100: linked."""
    words = [f"w{i}" for i in range(20)]
    text = lambda *ids: " ".join(words[i] for i in ids)
    rows = [(1, text(*range(8))), (2, text(*range(10))), (3, text(*range(2, 12)) + " z"), (4, "A b C"), (5, "a B\tc")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 1)


def test_odd_rows(odd, nothing):
    got = neardup.near_duplicates(odd, 2).toPandas()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id}
    assert all(by[i].component_id == i and by[i].kept and by[i].n_shingles == 0 for i in (1, 2, 3))
    assert by[5].component_id == 4 and not by[5].kept and by[20].component_id == 4
    lost = got[got.doc_id.isna()]
    assert len(lost) == 2 and lost.component_id.isna().all() and lost.kept.all()
    assert neardup.near_duplicates(nothing, 2).count() == 0


def test_words_and_shingles():
    texts = ["A bb\x0bccc", None, "", " \t", "bb CCC a bb ccc", "é\xa0é x", "q" * 200_000 + " r"]
    words = Words(texts)
    h = words.hashes()
    spelled = [words.word(i).decode() for i in range(len(words))]
    assert spelled == [w for t in texts for w in _WORD.findall((t or "").translate(_LOWER))]
    assert len(set(h.tolist())) == len(set(spelled)) and all((h[i] == h[j]) == (spelled[i] == spelled[j]) for i in range(len(h)) for j in range(len(h)))
    flat, bounds = shingles(words, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 0, 3, 1, 1]
    assert set(flat[: bounds[1]].tolist()) <= set(flat[bounds[4] : bounds[5]].tolist())


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, graph.LINK).repartition(6)).collect()}
    forest = graph.Forest()
    for a, b in edges:
        forest.union(a, b)
    assert got == {x: forest.find(x) for x in forest.parent}
    assert graph.connected_components(spark.createDataFrame([], graph.LINK)).count() == 0


def test_components_by_stars(spark, monkeypatch):
    """A graph that no one task may contract: long paths, a hub, and noise."""
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 501 + i) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(260)] + [(900, 250)]
    rng.shuffle(edges)
    forest = graph.Forest()
    for a, b in edges:
        forest.union(a, b)
    monkeypatch.setattr(graph, "ONE_TASK", -1)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, graph.LINK).repartition(7)).collect()}
    assert got == {x: forest.find(x) for x in forest.parent}


def test_units_are_bounded_and_cut_at_short_prefixes():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 3, (20_000, neardup.DEPTH)).astype(np.uint16)
    keys = keys[np.lexsort(keys.T[::-1])]
    unit, near = neardup.units(np.zeros(len(keys), np.int32), keys)
    size = np.bincount(unit)
    assert size.max() <= neardup.UNIT and near.any()
    runs = np.unique(keys[:, : neardup.MIN_DEPTH], axis=0, return_inverse=True)[1].ravel()
    assert len(np.unique(np.stack((unit, runs)), axis=1).T) == len(size)  # no unit crosses a run
    cuts = np.flatnonzero(np.diff(unit))
    shared = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    assert shared[cuts].mean() < shared.mean() - 0.5


def boilerplate(n, pairs, common, own, seed=8):
    """Documents of which each holds the same ``common`` words and ``own`` words of its own; the last ones are near copies of the first."""
    rng = random.Random(seed)
    shared = [f"c{i}" for i in range(common)]
    rows = []
    for i in range(n):
        rows.append(shared + [f"d{i}_{j}" for j in range(own)])
    for i in range(pairs):  # a few words of the other's own changed: similarity a little above 0.8
        words = list(rows[i])
        most = (common + own - 1) // 10 // 2
        for at in rng.sample(range(common + 2, common + own, 2), most):
            words[at] = f"e{i}_{at}"
        rows.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("common", "own"), [(60, 45), (80, 32)])
def test_shared_boilerplate_stays_bounded_and_found(spark, monkeypatch, common, own):
    """Background similarity 0.4 and 0.55 in 20,000 documents: bounded groups, recall against exact links."""
    n, pairs = 20_000, 300
    rows = boilerplate(n, pairs, common, own)
    seen = []
    plain = neardup._places

    def places(found, reps):
        out = neardup.saved(plain(found, reps))
        seen.append(out.selectExpr("inline(places)").groupBy("region").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(neardup, "_places", places)
    monkeypatch.setattr(neardup, "REGION", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    sets = sets_of(rows, 2)
    linked = [i for i in range(pairs) if 100 * len(sets[i] & sets[n + i]) >= 80 * len(sets[i] | sets[n + i])]
    found = [i for i in linked if got[n + i] == i]
    background = len(sets[1] & sets[5]) / len(sets[1] | sets[5])
    print(f"background {background:.2f}: linked {len(linked)}, found {len(found)}, largest group {seen}")
    assert len(linked) > 0.9 * pairs and len(found) >= 0.9 * len(linked)
    assert seen[0] <= 2000
    alone = set(range(n)) - set(linked)
    assert all(got[i] == i for i in alone)


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (5, b), (7, a + " x"), (9, b + " y"), (9, b)]
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    assert got == sorted([(5, 5, 29)] * 3 + [(7, 5, 30), (9, 5, 30), (9, 5, 29)])


def test_large_regions_by_units(spark, monkeypatch):
    """Regions too large to compare whole: units of all trees find the same components here."""
    monkeypatch.setattr(neardup, "REGION", 50)
    rows = near_copies(200) + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 2)


def test_links_that_units_cut_are_found(spark, monkeypatch):
    """A region compared by units in which any two texts are nearly similar (0.76): runs are cut at random, yet every link is found."""
    n, pairs = 2500, 400
    monkeypatch.setattr(neardup, "REGION", 500)
    rows = boilerplate(n, pairs, 104, 16)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    sets = sets_of(rows, 2)
    assert all(100 * len(sets[i] & sets[n + i]) >= 80 * len(sets[i] | sets[n + i]) for i in range(pairs))
    assert [i for i in range(pairs) if got[n + i] != i] == []
    assert all(got[i] == i for i in range(n))


def test_runs_cut_without_a_large_region(spark):
    """Texts too far apart (0.55) to make a region, in runs that are cut: their links are found too, and sizes do not matter."""
    n, pairs = 3000, 300
    rows = boilerplate(n, pairs, 80, 32)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 2).collect()}
    assert got == {**{i: i for i in range(n)}, **{n + i: i for i in range(pairs)}}


@pytest.mark.parametrize("side", [setjoin.SIDE, 40])
def test_links_between_components(spark, monkeypatch, side):
    """All links between sets of different components, as by brute force, also where shingles are dealt to tiles."""
    monkeypatch.setattr(setjoin, "SIDE", side)
    rng = np.random.default_rng(6)
    universe = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = []
    for i in range(240):
        base = universe[rng.choice(400, int(rng.integers(1, 60)), replace=False)] if i % 2 == 0 else np.union1d(sets[-1][: max(1, len(sets[-1]) - int(rng.integers(0, 8)))], universe[rng.choice(400, int(rng.integers(1, 5)))])
        sets.append(np.unique(base))
    component = [i // 7 for i in range(len(sets))]
    alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if component[i] != component[j] and alike(sets[i], sets[j])}
    levels = np.full(1 << 12, 64, np.uint8)
    entries = setjoin.prefixes(np.arange(len(sets)), np.array(component), [s.tobytes() for s in sets], 80, levels)
    assert len(want) > 5 and want <= {(int(u), int(v)) for found in setjoin.pairs(entries, 80) for u, v in found}
    df = spark.createDataFrame([(i, component[i], s.tobytes()) for i, s in enumerate(sets)], "rep long, component long, shingles binary").repartition(5)
    forest, brute = graph.Forest(), graph.Forest()
    for r in setjoin.links_between(df, 80).collect():
        forest.union(r["u"], r["v"])
    for u, v in want:
        brute.union(u, v)
    assert {x: forest.find(x) for x in brute.parent} == {x: brute.find(x) for x in brute.parent} and {forest.find(x) for x in forest.parent} == {brute.find(x) for x in brute.parent}
