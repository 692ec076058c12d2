"""Personal data: exact base patterns, and identifiers found by bootstrapped contexts.

Base spans (e-mail, IP, payment card, phone) are the seeds. Every
identifier-like token is an instance: a seed, a token with a digit of whatever
length, or groups joined by single blanks, dashes or colons (account numbers,
national phones, hardware and long IP addresses). Its surroundings induce
lexical patterns: the word before it, the two words before it, the word before
it with its shape, and the words on both sides. Patterns and instances form a
bipartite graph, which Spark scores in rounds: a pattern is accepted where its
instances' scores add up to ``support`` and their mean, its confidence, is high
enough; an instance's score is the confidence of its best accepted pattern.
Instances that end above the threshold are identifiers that no base pattern
saw. Tokens without an ASCII digit are no instances.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm.common import fresh, saved, text_groups

KINDS = ("email", "ip", "card", "phone")
FOUND = "identifier"
#: Rounds of scoring; least mean score of an accepted pattern's instances, and of an identifier; least sum of a pattern's instances' scores.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.6, 3.0
#: Most identifiers that are sent to every executor.
_BROADCAST = 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPACES = frozenset(" \t\n\x0b\f\r")
_BREAKS = _SPACES | frozenset("=:")
_BREAK = re.compile("[ \t\n\x0b\f\r=:]")
#: Groups of one identifier: account numbers in fours; digits with blanks or dashes; hexadecimal groups with colons.
_RUN = re.compile(r"(?<![\w:+-])(?:[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4})+(?: [0-9A-Z]{1,3})?|[0-9]{1,5}(?:[ -][0-9]{2,8})+|(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,})(?![\w:])")
_WRAP = "\"'`()[]{}<>,;.!?*|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match hangs on its @: the run before it, not into the last match, and the domain behind it."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, kinds as listed; failing matches are dropped, without retries."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _word_before(text: str, at: int) -> tuple[str, int]:
    """The last word before ``at`` in the same line, with its end marks, and where it begins; empty at the line's start. ``=`` and ``:`` end a word."""
    end = at
    while end > 0 and text[end - 1] in " \t":
        end -= 1
    start = end
    while start > 0 and text[start - 1] in "=:":
        start -= 1
    while start > 0 and text[start - 1] not in _BREAKS:
        start -= 1
    return text[start:end], start


def _word_after(text: str, at: int) -> str:
    start = at
    while start < len(text) and (text[start] in _WRAP or text[start] in " \t=:"):
        start += 1
    m = _BREAK.search(text, start)
    return text[start : m.start() if m else len(text)]


def _form(word: str) -> str:
    return _DIGITS.sub("9", word.lower().strip("\"'`()[]{}<>,;.!?*|"))


def _shape(token: str) -> str:
    """Runs of letters, digits and marks, with the lengths of short runs of digits."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", token, re.S):
        s = m.group()
        out.append(f"d{min(len(s), 20)}" if s[0].isdecimal() else "a" if s[0].isalpha() else s)
    return "".join(out)


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def instances(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, bool, list[int]]]:
    """(start, end, instance, is seed, patterns) of seeds and of other identifier-like tokens, by start."""
    spans = sorted({(a, b) for _, a, b in base})
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def free(start: int, end: int) -> bool:
        near = bisect_right(starts, end - 1) - 1
        return near < 0 or merged[near][1] <= start

    found, runs = [(a, b, True) for a, b in merged], []
    if _DIGITS.search(text) is not None:
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text) if free(*m.span())]
        found += [(a, b, False) for a, b in runs]
    done, run = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        while run < len(runs) and runs[run][1] <= m.start():
            run += 1
        if run < len(runs) and runs[run][0] <= m.start():
            done = runs[run][1]
            continue
        start = m.start()
        while start > done and text[start - 1] not in _BREAKS:
            start -= 1
        after = _BREAK.search(text, m.end())
        end = after.start() if after else len(text)
        if run < len(runs):
            end = min(end, runs[run][0])
        done = end
        token = text[start:end]
        start, end = start + len(token) - len(token.lstrip(_WRAP)), end - len(token) + len(token.rstrip(_WRAP))
        if free(start, end):
            found.append((start, end, False))
    out = []
    for start, end, seed in sorted(found):
        at = start
        while at > 0 and text[at - 1] in "\"'`([{<":
            at -= 1
        one, before = _word_before(text, at)
        two, _ = _word_before(text, before)
        token = text[start:end]
        patterns = {_key("left", _form(two), _form(one)), _key("shape", _form(one), _shape(token)), _key("around", _form(one), _form(_word_after(text, end)))}
        if _form(one):
            patterns.add(_key("before", _form(one)))
        out.append((start, end, _key("instance", token), seed, sorted(patterns)))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_INSTANCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))])
_SCANNED = "uid long, doc_id long, base array<struct<kind:string,start:int,end:int>>, instances array<struct<start:int,end:int,instance:bigint,seed:boolean,patterns:array<bigint>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for a, b in text_groups(texts):
            base = [base_spans(t or "") for t in texts[a:b]]
            found = [instances(t or "", s) for t, s in zip(texts[a:b], base)]
            spans = pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in s] for s in base], pa.list_(_SPAN))
            tokens = pa.array([[dict(zip(("start", "end", "instance", "seed", "patterns"), f)) for f in fs] for fs in found], pa.list_(_INSTANCE))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), spans, tokens], names=["uid", "doc_id", "base", "instances"])


def score_instances(edges: DataFrame, seeds: DataFrame, rounds: int, confidence: float, support: float) -> DataFrame:
    """(instance, score) of the bipartite graph (pattern, instance): seeds stay at 1, others take their best accepted pattern's confidence."""
    scored = saved(seeds.select("instance", F.lit(1.0).alias("score")), small=True)
    for _ in range(rounds):
        marked = edges.join(scored, "instance", "left")
        patterns = marked.groupBy("pattern").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("positive"), F.count(F.lit(1)).alias("n"))
        accepted = saved(patterns.where((F.col("positive") >= support) & (F.col("positive") / F.col("n") >= confidence)).select("pattern", (F.col("positive") / F.col("n")).alias("confidence")), small=True)
        reached = edges.join(accepted, "pattern").groupBy("instance").agg(F.max("confidence").alias("score"))
        scored = saved(reached.unionByName(seeds.select("instance", F.lit(1.0).alias("score"))).groupBy("instance").agg(F.max("score").alias("score")), small=True)
    return scored


def _identifiers(scanned: DataFrame, rounds: int, confidence: float, support: float) -> DataFrame:
    """(instance) of the identifiers that contexts found and no base pattern saw."""
    tokens = scanned.select(F.explode("instances").alias("x")).select("x.*")
    edges = saved(tokens.select(F.explode("patterns").alias("pattern"), "instance").distinct(), small=True)
    seeds = saved(tokens.where("seed").select("instance").distinct(), small=True)
    scored = score_instances(edges, seeds, rounds, confidence, support).where(F.col("score") >= confidence).select("instance")
    return saved(scored.join(seeds, "instance", "left_anti"), small=True)


def _found_spans(scanned: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(uid, spans) of the identifiers' places."""
    tokens = scanned.select("uid", F.explode("instances").alias("x")).select("uid", "x.start", "x.end", "x.instance", "x.seed").where("NOT seed").drop("seed")
    return saved(tokens.join(identifiers, "instance").groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), small=True)


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: doc_id, base and found, arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds the base spans by kind (email, ip, card, phone) and start;
    ``found`` the spans the contexts added (kind ``identifier``) by start, none
    of them within a base span. Null and empty texts have none; rows pass
    through with null or repeated ids; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = saved(rows.mapInArrow(_scan, _SCANNED))
    spans = _found_spans(scanned, _identifiers(scanned, rounds, confidence, support))
    out = scanned.select("uid", "doc_id", "base").join(spans, "uid", "left")
    found = F.transform("spans", lambda s: F.struct(F.lit(FOUND).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select("doc_id", "base", F.coalesce(found, F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("found"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of :func:`find_personal_data` masked; ``length_col``, if there, is brought up to date.

    Up to ``_BROADCAST`` identifiers go to all executors and the texts stay
    where they are; beyond that the spans are joined to the rows. Null texts
    stay null. All rows and columns are kept.
    """
    spark = docs.sparkSession
    text = docs[text_col]
    scanned = saved(docs.select(F.xxhash64(text).alias("uid"), F.lit(None).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_scan, _SCANNED))
    identifiers = _identifiers(scanned, rounds, confidence, support)
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at, length = names.index(text_col), names.index(length_col) if length_col in names else None

    def finish(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        columns[at] = pa.array(texts, pa.string())
        if length is not None:
            columns[length] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[length].to_pylist())], columns[length].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    if identifiers.limit(_BROADCAST + 1).count() <= _BROADCAST:
        known = spark.sparkContext.broadcast(frozenset(r["instance"] for r in identifiers.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t in batch.column(at).to_pylist():
                    if t:
                        base = base_spans(t)
                        more = [(FOUND, a, b) for a, b, x, seed, _ in instances(t, base) if not seed and x in known.value]
                        t = masked(t, base + more)
                    out.append(t)
                yield finish(batch, out)

        return docs.mapInArrow(run, fields)

    spans = _found_spans(scanned, identifiers)
    uid, place = fresh(docs, "__uid"), fresh(docs, "__spans")
    joined = docs.withColumn(uid, F.xxhash64(text)).join(spans.withColumnRenamed("uid", uid).withColumnRenamed("spans", place), uid, "left").select(*names, place)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if t:
                    base = base_spans(t)
                    places = {(s["start"], s["end"]) for s in more or ()}  # of the texts with this hash
                    t = masked(t, base + [(FOUND, a, b) for a, b, _, seed, _ in instances(t, base) if not seed and (a, b) in places])
                out.append(t)
            yield finish(batch, out)

    return joined.mapInArrow(run_joined, fields)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
