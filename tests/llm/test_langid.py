from __future__ import annotations

import zlib

import numpy as np

from quillon.llm import langid


def test_presence_is_of_whole_texts():
    long = "abc " * 10 + "z" * 5
    whole = langid.presence("the cat sat on the mat " * 5 + "quixotic")
    assert langid.presence("quixotic")[whole].sum() >= 15
    assert (langid.presence(long.upper()) == langid.presence(long)).all()
    assert (langid.presence("a1 !! b") == langid.presence("a b")).all()
    assert langid.presence("").sum() == 0


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdefgh ij")) for _ in range(5000))
    text = " ".join(text.split())
    before = langid.presence(text)
    monkeypatch.setattr(langid, "SLICE", 997)
    after = langid.presence(text)
    assert (after & before == before).all() and after.sum() - before.sum() <= 12  # a slice's first gram may begin with a space


def test_fit_and_scores_equal_plain_kernel_ridge():
    """Kernels from sets, the normal equations of the Nyström ridge solved as they stand, scores as sums over landmarks."""
    train = [("der die und das ist", "de"), ("the and of it was", "en"), ("und die der haus", "de"), ("of the and house", "en"), ("le la et les des", "fr"), ("ein haus und der hund", "de"), ("les maisons et la rue", "fr")]
    sets = [frozenset(np.flatnonzero(langid.presence(t)).tolist()) for t, _ in train]
    labels = [x for _, x in train]
    kernel = lambda a, b: len(a & b) / (max(len(a), 1) ** 0.5 * max(len(b), 1) ** 0.5)
    names, folded = langid.fit([np.array(sorted(s)) for s in sets], labels, landmarks=12, ridge=1e-3)
    assert names == ["de", "en", "fr"]
    marks = [i for name in names for i in [j for j, x in enumerate(labels) if x == name][:4]]
    rows = np.array([[kernel(s, sets[m]) for m in marks] for s in sets])
    share = np.diag([1 / labels.count(x) for x in labels])
    target = np.array([[1.0 if x == n else -1.0 for n in names] for x in labels])
    inner = np.array([[kernel(sets[a], sets[b]) for b in marks] for a in marks])
    alpha = np.linalg.solve(rows.T @ share @ rows + 1e-3 * inner + 1e-6 * np.eye(len(marks)), rows.T @ share @ target)
    asked = ["die und der", "it of the", "la rue des", "zz", "ein the"]
    flags = np.stack([langid.presence(t) for t in asked])
    expected = [[sum(kernel(frozenset(np.flatnonzero(f).tolist()), sets[m]) * alpha[i, c] for i, m in enumerate(marks)) for c in range(3)] for f in flags]
    np.testing.assert_allclose(langid.scores(flags, folded), expected, atol=2e-4)
    assert langid.scores(flags, folded).argmax(axis=1)[:3].tolist() == [0, 1, 2]


def test_query_equals_plain_kernel_ridge(spark, docs):
    """The query's predictions from its own documented sample, brute force: one row at a time, over sets."""
    sample = langid.training_sample(docs, langid.held_out_rows(), 200)
    assert all(sum(x == name for _, x in sample) <= 200 for name in {x for _, x in sample})
    held = {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    names, folded = langid.fit([s for s, _ in sample], [x for _, x in sample])
    got = {r["doc_id"]: r for r in langid.identify_languages(docs).collect()}
    for r in docs.collect():
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (r["doc_id"] in held)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        slots = np.flatnonzero(langid.presence(r["text"]))
        score = folded[slots].astype(np.float64).sum(axis=0) / len(slots) ** 0.5
        best = np.sort(score)[::-1]
        assert mine["lang_pred"] == names[int(score.argmax())] or best[0] - best[1] < 1e-4
        assert abs(mine["score"] - 1 / (1 + np.exp(-4 * (best[0] - best[1])))) < 1e-3


def test_letters():
    assert not any(langid.has_letter(t) for t in (None, "", "½ ² Ⅷ ① 12 _ -", "\u0301 ٣", "\U0001f600"))
    assert all(langid.has_letter(t) for t in ("½a", "中", "ª", "1 é", "\U00010400"))


def test_held_out_accuracy(spark, docs):
    got = langid.identify_languages(docs).toPandas().set_index("doc_id")
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(got) == len(rows) and sorted(got.index[got.held_out]) == sorted(r["doc_id"] for r in held)
    assert np.mean([got.lang_pred[r["doc_id"]] == r["lang"] for r in held]) >= 0.95
    assert got.score.between(0, 1).all()


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, docs):
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(langid.held_out_rows(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (langid.identify_languages(d).orderBy("doc_id").select("doc_id", "lang_pred", "score").collect() for d in (docs, changed))
    assert a == b


def test_odd_rows(odd, nothing):
    got = langid.identify_languages(odd).toPandas()
    assert len(got) == odd.count()
    by = {r.doc_id: r.lang_pred for r in got.itertuples() if r.doc_id == r.doc_id}
    assert by[1] == by[2] == by[3] == by[6] == "und" and by[9] in ("de", "en", "fr")
    assert (got[got.lang_pred == "und"].score == 0).all()
    kept = langid.identify_languages(odd, keep=True)
    assert kept.columns == [*odd.columns, "__lang_pred", "__score"] and kept.drop("__lang_pred", "__score").exceptAll(odd).isEmpty()
    assert langid.identify_languages(nothing).count() == 0
    unlabelled = langid.identify_languages(odd.withColumn("lang", odd.lang.substr(5, 0)).where("doc_id = 4").replace("", None, ["lang"])).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
