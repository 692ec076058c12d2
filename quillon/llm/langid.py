"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (n = 1..4, blended)
present in both, normalised by the geometric mean of the numbers present in
each. Nyström landmarks and one-versus-rest kernel ridge regression learn from
a bounded labelled sample; n-grams are hashed to ``SLOTS`` slots. With landmark
presence rows L and coefficients A, the scores of a batch of texts with
presence rows X are X @ (L' A), one matrix product (the landmarks are folded
into the coefficients once, since the kernel is linear in X).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLOTS_LOG2 = 16
SLOTS = 1 << SLOTS_LOG2
ORDERS = 4
SLICE, BATCH = 1 << 20, 128
#: Runs of word characters other than digits and the underscore: letters, and numerals that are none.
_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)], dtype=bool)


def presence(text: str) -> np.ndarray:
    """Which slots the text's n-grams fall into; lower-cased letters, runs of anything else as one space. Long texts go slice by slice."""
    flags = np.zeros(SLOTS, dtype=bool)
    letters = _letters()
    for lo in range(0, max(len(text), 1), SLICE):
        part = text[max(0, lo - ORDERS + 1) : lo + SLICE].lower()
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known = codes < 0x10000
        codes = np.where(~known | letters[np.where(known, codes, 0)], codes, 32).astype(np.uint64)
        if not len(codes):
            continue
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        with np.errstate(over="ignore"):
            grams = codes
            for n in range(1, ORDERS + 1):
                if n > 1:
                    if len(codes) < n:
                        break
                    grams = (grams[:-1] + np.uint64(n)) * _FACTOR + codes[n - 1 :]
                flags[(grams * _MIX) >> np.uint64(64 - SLOTS_LOG2)] = True
    return flags


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of two lists of slot arrays' dense rows."""
    na, nb = np.sqrt(np.maximum(a.sum(axis=1), 1)), np.sqrt(np.maximum(b.sum(axis=1), 1))
    return (a @ b.T) / na[:, None] / nb[None, :]


def _dense(slots: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(slots), SLOTS), dtype=np.float32)
    for row, s in zip(out, slots):
        row[s] = 1
    return out


def fit(slots: list[np.ndarray], labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> tuple[list[str], np.ndarray]:
    """(languages, folded coefficients SLOTS x languages) of the sample."""
    names = sorted(set(labels))
    if not names:
        return [], np.zeros((SLOTS, 0), dtype=np.float32)
    each = max(4, landmarks // len(names))
    chosen = [i for name in names for i in [j for j, x in enumerate(labels) if x == name][:each]]
    marks = _dense([slots[i] for i in chosen])
    rows = np.concatenate([_kernel(_dense(slots[i : i + BATCH]), marks) for i in range(0, len(slots), BATCH)]).astype(np.float64)
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([labels.count(x) for x in labels], dtype=np.float64)
    weighted = rows / share[:, None]
    inner = _kernel(marks, marks).astype(np.float64)
    left = weighted.T @ rows + ridge * inner + 1e-6 * np.eye(len(chosen))
    alpha = np.linalg.solve(left, weighted.T @ target)
    folded = (marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).T.astype(np.float64) @ alpha
    return names, folded.astype(np.float32)


def scores(flags: np.ndarray, folded: np.ndarray) -> np.ndarray:
    """One-versus-rest scores of a batch of presence rows."""
    x = flags.astype(np.float32)
    return (x @ folded) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def has_letter(text: str | None) -> bool:
    """Whether the text holds a letter (Unicode category L): numerals such as ``½``, ``²`` or ``Ⅷ`` are none."""
    return text is not None and any(c.isalpha() for m in _LETTERS.finditer(text) for c in m.group())


def training_sample(docs: DataFrame, held_out: Column, per_language: int) -> list[tuple[np.ndarray, str]]:
    """(slots, language) of at most ``per_language`` labelled documents of each language, chosen evenly by a hash of the id."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    spread = F.xxhash64("doc_id")
    chosen = labelled.select("doc_id", "lang", spread.alias("h")).groupBy("lang", F.pmod("h", F.lit(per_language)).alias("cell")).agg(F.min_by("doc_id", "h").alias("doc_id"))
    ids = sorted({r["doc_id"] for r in chosen.select("doc_id").collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, lang, np.flatnonzero(presence(t)).astype("<u2").tobytes()) for i, lang, t in zip(*[batch.column(c).to_pylist() for c in range(3)]) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.binary())], names=["doc_id", "lang", "slots"])

    rows = labelled.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, slots binary").collect()
    first = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], bytes(r["slots"]))):
        first.setdefault(r["doc_id"], r)  # rows that share an id: one of them
    order = sorted(first.values(), key=lambda r: (r["doc_id"] * 0x9E3779B97F4A7C15) % (1 << 64))
    return [(np.frombuffer(r["slots"], dtype="<u2"), r["lang"]) for r in order]


def held_out_rows(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify_languages(docs: DataFrame, per_language: int = 200, landmarks: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False, letter: bool = False, added: Sequence[str] = ("__lang_pred", "__score", "__letter")) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score.

    Learns from the text and non-null language of at most ``per_language``
    documents of each language (the documented bound of the sample), none of
    them held out; only the text is used to predict. ``und`` with score 0 where
    the text is null or has no letter, or where nothing could be learned; else
    the best language and, as score, the logistic of its lead over the second
    (0.5 to 1). Rows without an id are predicted but not learned from; repeated
    rows are predicted alike; an empty table gives no rows. ``keep`` returns
    the rows' own columns and the first two of ``added`` instead, and with
    ``letter`` the third: whether the text has a letter. Columns of other names
    are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = training_sample(rows.where("doc_id IS NOT NULL"), held_out_rows(), per_language)
    names, folded = fit([s for s, _ in sample], [x for _, x in sample], landmarks)
    model = spark.sparkContext.broadcast((names, folded))  # SLOTS numbers for each language

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, folded = model.value
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if names and has_letter(t)]
        for lo in range(0, len(able), BATCH):
            some = able[lo : lo + BATCH]
            f = scores(np.stack([presence(texts[i]) for i in some]), folded)
            best = f.argmax(axis=1)
            top = np.sort(f, axis=1)
            lead = top[:, -1] - (top[:, -2] if len(names) > 1 else -1.0)
            for i, b, d in zip(some, best, lead):
                lang[i], score[i] = names[b], float(1 / (1 + np.exp(-4.0 * d)))
        return lang, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col if keep else "text")).to_pylist()
            lang, score = predict(texts)
            able = [pa.array([has_letter(t) for t in texts], pa.bool_())] if keep and letter else []
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names if keep or n != "text"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), *able], names=[*[n for n in names if keep or n != "text"], *added[: 2 + len(able)]])

    if keep:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return docs.mapInArrow(run, f"{fields}, `{added[0]}` string, `{added[1]}` double" + f", `{added[2]}` boolean" * letter)
    out = rows.select("doc_id", held_out_rows().alias("held_out"), "text").mapInArrow(run, f"doc_id long, held_out boolean, `{added[0]}` string, `{added[1]}` double")
    return out.select("doc_id", "held_out", F.col(added[0]).alias("lang_pred"), F.col(added[1]).alias("score"))
