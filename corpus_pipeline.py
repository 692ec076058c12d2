"""From raw documents to packed token sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``;
what it returns is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import fresh, saved, stored, table
from quillon.llm.langid import identify_languages
from quillon.llm.neardup import near_duplicates
from quillon.llm.packing import pack_documents
from quillon.llm.personal import mask_personal_data


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts and texts without a letter; documents stay where no language could be learned.

    Nulls in other columns, repeated rows and other columns of any name pass; an empty table gives no rows.
    """
    names = [fresh(docs, n) for n in ("__lang_pred", "__score", "__letter")]
    return identify_languages(docs, keep=True, letter=True, added=names).where(F.col(names[2])).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Rows without an id stay, as do null, empty and blank texts. Of rows alike in
    id and text one stays; rows that share an id only are judged each by its
    text. Other columns of any name pass; an empty table gives no rows.
    """
    key = fresh(docs, "__text_key")
    found = saved(near_duplicates(docs, words=5, percent=80, key=True).select("doc_id", F.col("text_key").alias(key), "kept"), small=True)
    rows = docs.withColumn(key, F.xxhash64("text"))
    kept = rows.join(found.where("NOT kept").select("doc_id", key).distinct(), ["doc_id", key], "left_anti")
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", key)
    if not again.isEmpty():
        once = kept.join(again, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
        kept = kept.join(again, ["doc_id", key], "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and brings their length up to date; all rows stay.

    Nulls stay null, repeated rows are masked alike, other columns of any name pass; an empty table gives no rows.
    """
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each at its place in a sequence of 2048 tokens.

    A null or empty text is its end token alone, a null id stays null, repeated
    rows are packed each on its own; other columns are left behind; an empty
    table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("language", language), ("near_duplicates", near_duplicate), ("personal", personal), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each on what the one before has kept; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Signatures, learned models and packing are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
