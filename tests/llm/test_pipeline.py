from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import neardup
from quillon.llm.langid import has_letter
from quillon.llm.personal import base_spans
from tests.llm.test_neardup import components, sets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, docs):
    now, rows = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == COLUMNS
        before, rows = rows, now.collect()
        ids = {r["doc_id"] for r in rows}
        if name == "language":
            assert ids == {r["doc_id"] for r in before if has_letter(r["text"])}
        elif name == "near_duplicates":
            group = components(sets_of([(r["doc_id"], r["text"]) for r in before], 5), 80)
            assert ids == {i for i, c in group.items() if i == c}
        else:
            assert ids == {r["doc_id"] for r in before} and not any(base_spans(r["text"]) for r in rows)
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {r["doc_id"]: len(full.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").toPandas()
    assert packed.groupby("doc_id").length.sum().to_dict() == expected


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.select("sequence_id").distinct().count() < out.count()


def test_odd_rows(spark, odd, nothing):
    """Nulls anywhere, long and empty texts, repeated rows, and more columns whose names the stages use themselves."""
    from pyspark.sql import functions as F

    for df in (odd, nothing, odd.select(COLUMNS)):
        for name in ("__lang_pred", "__letter", "__uid", "__spans", "text_key", "__text_key", "kept", "component_id", "set_hash") if len(df.columns) > 5 else ():
            df = df.withColumn(name, F.lit("x"))
        now = df
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, "")
            if name != "packing":
                assert now.columns == before.columns
                assert all(r[c] == "x" or c in COLUMNS or r[c] == c for r in now.collect() for c in now.columns)
        now.collect()


def test_repeated_rows_and_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, b), (7, a + " x"), (8, b), (9, b + " y"), (None, a), (None, a), (10, "c d e"), (10, "c d e"), (11, None), (11, None), (12, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate(spark, df, "").collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (None, a), (None, a), (10, "c d e"), (11, None), (12, " ")], key=str)


def test_nothing_to_learn_drops_nothing_with_letters(spark, docs):
    from pyspark.sql import functions as F

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, bare, "").collect()}
    assert kept and kept == {r["doc_id"] for r in docs.collect() if has_letter(r["text"])}


def test_near_duplicates_do_not_depend_on_the_size_of_regions(spark, monkeypatch):
    """Texts that are nearly similar to all others (0.76), some with one copy (0.84): what is kept is the same in regions above and below the bound."""
    n, pairs, own = 2500, 400, 16
    rows = [[f"c{j}" for j in range(104)] + [f"d{i}_{j}" for j in range(own)] for i in range(n)]
    for i in range(pairs):  # two words that five shingles hold each
        words = list(rows[i])
        words[-11], words[-5] = f"e{i}", f"f{i}"
        rows.append(words)
    df = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    for bound in (1 << 14, 500):
        monkeypatch.setattr(neardup, "REGION", bound)
        kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, df, "").collect()]
        assert sorted(kept) == list(range(n))
