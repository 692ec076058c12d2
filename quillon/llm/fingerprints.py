"""Document fingerprints by consistent weighted sampling, in built-in functions only.

A text's terms are its words; a term weighs the characters it covers (its
count times its length). For sample k and term t, r and c are Gamma(2, 1) and
b is uniform, all drawn from a hash of (k, t). With weight S the quantised
level is q = floor(ln S / r + b) and the sample's value

    ln a = ln c - r * (q - b + 1);

the least value over the terms is the sample. It depends on the winning term
and its level only, and two texts share a sample with probability equal to the
generalised Jaccard similarity of their weights (sum of minima over sum of
maxima). A fingerprint holds ``SAMPLES`` samples of 16 bits each, in hex; the
likeness of two fingerprints is their share of equal samples.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.llm.common import partitions

SAMPLES = 32
#: Buckets a shuffle partition: small buckets even out.
BUCKETS = 3
_WORD_BREAK = r"[\x20\x09-\x0D]+"
_UNIT = 1.0 / (1 << 21)


def _uniforms(h: Column) -> list[Column]:
    """Three uniforms in (0, 1) from the 63 upper bits of a hash."""
    mask = F.lit((1 << 21) - 1)
    return [(F.shiftrightunsigned(h, bits).bitwiseAND(mask).cast("double") + 0.5) * _UNIT for bits in (43, 22, 1)]


def sample_value(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of sample ``k`` for a term (its 64-bit hash) of the given log weight."""
    u = _uniforms(F.xxhash64(term, F.lit(2 * k)))
    v = _uniforms(F.xxhash64(term, F.lit(2 * k + 1)))
    r = -F.log(u[0] * u[1])
    log_c = F.log(-F.log(v[0] * v[1]))
    return log_c - r * (F.floor(log_weight / r + u[2]).cast("double") - u[2] + 1.0)


def _add_terms(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row for each distinct word of each row's text: keys, term (hash) and log_weight; a text without words has one row of nulls."""
    df = df.withColumn("__text", F.btrim(F.col(text), F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("__text") == "", F.array().cast("array<string>")).otherwise(F.split("__text", _WORD_BREAK))
    df = df.withColumn("__words", F.sort_array(words)).select(*keys, "__words", F.size("__words").alias("__n"))
    starts = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (i == 0) | (F.get("__words", i - 1) != F.get("__words", i)))
    df = df.withColumn("__starts", F.when(F.col("__n") > 0, starts).otherwise(F.array().cast("array<int>")))
    runs = F.transform("__starts", lambda s, j: F.struct(F.get("__words", s).alias("word"), (F.coalesce(F.get("__starts", j + 1), F.col("__n")) - s).alias("count")))
    rows = df.withColumn("__runs", runs).select(*keys, F.inline_outer("__runs").alias("__word", "__count"))
    return rows.select(*keys, F.xxhash64("__word").alias("term"), F.when(F.col("__word").isNotNull(), F.log(F.col("__count") * F.char_length("__word"))).alias("log_weight"))


def _signature(samples: list[Column]) -> Column:
    """The samples as 16 bits each, in hex; a text without terms has the samples of nothing."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(F.coalesce(s, F.lit(0.0))), F.lit(65536)))), 4, "0") for s in samples])


def fingerprint_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, fingerprint) of rows told apart by their non-null ``keys``."""
    terms = _add_terms(df, text, keys)
    samples = [F.min(sample_value(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(SAMPLES)]
    grouped = terms.groupBy(*keys).agg(*samples)
    return grouped.select(*keys, _signature([F.col(f"s{k}") for k in range(SAMPLES)]).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = [F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(SAMPLES)]
    total = equal[0]
    for e in equal[1:]:
        total = total + e
    return total / F.lit(float(SAMPLES))


def _bucket_table(rows: DataFrame, buckets: int, shift: int) -> tuple[DataFrame, int]:
    """One row that tells the bucket of an id's code and a text's cut, and the number of buckets: about ``buckets``, of about equal row counts, in descending id order, null ids last.

    ``codes`` holds the largest code of each run of buckets, ``base`` the run's
    first bucket, ``width`` its buckets: more than one where a single id has the
    rows of several. Those are told apart by ``cuts``, the smallest of each, as
    null ids are by ``null_cuts`` where they are many. All of these are values
    of the table, so no bucket is empty.
    """
    shares = [i / buckets for i in range(1, buckets + 1)]
    found = rows.agg(F.percentile_approx("code", shares, 10 * buckets).alias("codes"), F.max("code").alias("most"), F.count(F.when(F.col("code").isNull(), 1)).alias("nulls"), F.count(F.lit(1)).alias("all")).first()
    times = Counter([*(found["codes"] or []), *([found["most"]] if found["most"] is not None else [])])
    codes = sorted(times, reverse=True)
    hot = [c for c in codes if times[c] > 2 and not shift]
    null_pieces = buckets * found["nulls"] // max(found["all"], 1)
    cuts: dict = {}
    if hot or null_pieces > 1:
        pieces = max([null_pieces, *(times[c] for c in hot)])
        of = rows.where(F.col("code").isin(hot) | (F.col("code").isNull() & F.lit(null_pieces > 1))).groupBy("code")
        cuts = {r["code"]: sorted({r["least"], *r["cuts"]}) for r in of.agg(F.min("cut").alias("least"), F.percentile_approx("cut", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("cuts")).collect()}
    width = [len(cuts.get(c, ())) or 1 for c in codes]
    base = list(accumulate([0, *width]))
    schema = "codes array<bigint>, base array<int>, width array<int>, cuts map<bigint,array<bigint>>, null_base int, null_cuts array<bigint>"
    null_cuts = cuts.pop(None, [])
    table = rows.sparkSession.createDataFrame([(codes, base[:-1], width, cuts, base[-1], null_cuts)], schema)
    return table, max(1, base[-1] + len(null_cuts))


def _place(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of (doc_id, text, tie) by bucket; a bucket's first rows are also sent, as ghosts, to the bucket before, whose last row needs one."""
    ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    # quantiles are taken over doubles: ids of more bits than those hold are coded by their upper bits, ties always
    shift = max(0, max((abs(x).bit_length() for x in ends if x is not None), default=0) - 52)
    rows = rows.withColumn("code", F.shiftright("doc_id", shift)).withColumn("cut", F.shiftright("tie", 12))
    table, total = _bucket_table(rows.select("code", "cut"), buckets, shift)
    side = max(1, int(total**0.5))
    near = table.select("*", F.expr(f"filter(codes, (h, i) -> i % {side} = 0)").alias("coarse"))
    rows = rows.crossJoin(F.broadcast(near))  # one row
    none = F.array().cast("array<bigint>")
    group = F.greatest(F.expr("size(filter(coarse, h -> h >= code)) - 1"), F.lit(0))
    rows = rows.withColumn("run", F.when(F.col("code").isNotNull(), group * side + F.size(F.filter(F.slice("codes", group * side + 1, F.lit(side)), lambda h: h >= F.col("code"))) - 1))
    rows = rows.withColumn("own", F.coalesce(F.col("code") == F.get("codes", F.col("run")), F.lit(False)))
    rows = rows.withColumn("known", F.when(F.col("code").isNull(), F.col("null_cuts")).when(F.col("own"), F.coalesce(F.col("cuts")[F.col("code")], none)).otherwise(none))
    rows = rows.withColumn("piece", F.greatest(F.size(F.filter("known", lambda t: t <= F.col("cut"))) - 1, F.lit(0)))
    of_id = F.get("base", F.col("run")) + F.when(F.col("own"), F.col("piece")).otherwise(F.get("width", F.col("run")) - 1)
    of_null = F.when(F.size("null_cuts") > 0, F.col("null_base") + F.col("piece")).otherwise(F.greatest(F.col("null_base") - 1, F.lit(0)))
    rows = rows.withColumn("bucket", F.when(F.col("code").isNull(), of_null).otherwise(of_id))
    first = F.when(F.size("known") > 0, F.get("known", F.col("piece")) == F.col("cut")).otherwise(F.col("own"))
    before = F.pmod(F.col("bucket") - 1, F.lit(total))
    own, ghost = F.struct("bucket", F.lit(0).alias("ghost")), F.struct(before.alias("bucket"), F.lit(1).alias("ghost"))
    rows = rows.select("doc_id", "text", "tie", F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("__at"))
    return rows.select("doc_id", "text", "tie", "__at.bucket", "__at.ghost")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The next document is the one behind in descending id order (ties by the
    text's hash), after the last the first; a lone row is its own next. The
    edited text has the last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document's. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as empty; texts without words share one fingerprint, of no
    terms; null ids come last; rows alike in id and text give rows alike; an
    empty table gives no rows.

    The text is shuffled once, into buckets of neighbouring ids; the first row
    of each bucket is also sent to the bucket before, whose last row needs it.
    An id, or null, that many rows share is dealt to several buckets by the
    text's hash; rows alike in id and text share one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = _place(rows, BUCKETS * partitions(docs.sparkSession))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "tie")
    n_chars = F.char_length("text")
    cut = F.floor(n_chars / 3).cast("int")
    rows = rows.withColumns({"place": F.row_number().over(order), "next": F.coalesce(F.lead("text").over(order), F.first("text").over(order)), "behind": F.lag("ghost", 1, 0).over(order)})
    rows = rows.where("ghost = 0 OR behind = 0")  # of ghosts, the first is enough
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut), F.substring(F.col("next"), F.lit(1), cut))
    rows = rows.select("bucket", "place", "ghost", "doc_id", n_chars.cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    pair = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))))
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256", "side"]
    both = rows.select("bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256", pair)
    prints = fingerprint_rows(both, "body", keys)
    # one row for each document again; the keys hold the bucket, so nothing moves
    of_side = lambda s: F.max(F.when(F.col("side") == s, F.col("fingerprint")))
    one = prints.groupBy(*keys[:-1]).agg(of_side(0).alias("fingerprint"), of_side(1).alias("edited_fingerprint"))
    by_place = Window.partitionBy("bucket").orderBy("place")
    one = one.withColumn("__next", F.coalesce(F.lead("fingerprint").over(by_place), F.first("fingerprint").over(by_place))).where("ghost = 0")
    return one.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"),
    )
