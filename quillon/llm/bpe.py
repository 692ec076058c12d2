"""Word-level BPE encoding by traversal of a prefix trie, and decoding.

The encoding of a prefix is fixed by its last token and the encoding of what
stands before that token. So the distinct new words are put in order, which is
a depth-first walk of their trie; each node (prefix) gets its last token once,
from its ancestors' states, and words that share the prefix share the state.
A token can follow another exactly if no merge across their border would have
come first; answers are kept for pairs of tokens.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quillon.llm.common import text_groups
from quillon.llm.tokens import _PLAIN, byte_symbols

#: Distinct words, and pairs of tokens, that a worker keeps before it starts afresh.
KEPT = 400_000
_PLAIN_LIMIT = 0x180


def _class(kind: str) -> str:
    """Characters below ``_PLAIN_LIMIT`` of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_LIMIT) if unicodedata.category(chr(c))[0] == kind)


_LETTER, _NUMBER = _class("L"), _class("N")
#: The word pattern, for texts that hold plain Latin characters only.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


class TrieBpe:
    """Ids and decoded text of whole texts, as the ``tokenizers`` library gives them for a vocabulary with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.full = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.symbols = byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b: i for i, (a, b) in enumerate(merges)}
        # places: base symbols first, then tokens in the order of their merges
        base = [t for t in vocab if t not in made and t not in self.special]
        place = {t: i for i, t in enumerate(base)} | {t: len(base) + i for t, i in made.items()}
        self.vocab_id = {place[t]: vocab[t] for t in place if t in vocab}
        self.token_text = {place[t]: t for t in place}
        self.parts = [(i, i) for i in range(len(base))] + [(place[a], place[b]) for a, b in merges]
        self.pair = {(place[a], place[b]): place[a + b] for a, b in merges}
        self.fits: dict[tuple[int, int], bool] = {}
        inner, final = {}, {}
        for token, at in place.items():
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            raw = token[: -len(self.suffix)] if ends else token
            if all(c in self.symbols for c in raw) and self._whole(at):
                (final if ends else inner)[bytes(self.symbols[c] for c in raw)] = at
        self.inner, self.final = inner, final
        self.longest_inner, self.longest_final = max(map(len, inner)), max(map(len, final))
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    def _whole(self, token: int) -> bool:
        """Whether the token's own symbols are merged to it."""
        a, b = self.parts[token]
        return a == token or (self._whole(a) and self._whole(b) and self._follows(a, b, token))

    def _follows(self, a: int, b: int, but: int = -1) -> bool:
        """Whether ``b`` can stand behind ``a``: no merge across the border comes before the merges inside (``but`` may).

        The check walks the two tokens' splits from their last merges down, as
        the token-pair test of GitHub's open-source ``bpe`` crate does.
        """
        limit = sys.maxsize
        while True:
            joined = self.pair.get((a, b))
            if joined is not None and joined < limit and joined != but:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def _last(self, word: bytes, end: int, tokens: dict[bytes, int], longest: int, last: list[int]) -> int:
        """The last token of ``word[:end]``, given the last tokens of all shorter prefixes."""
        fits = self.fits
        for start in range(max(0, end - longest), end):
            token = tokens.get(word[start:end])
            if token is None:
                continue
            if start == 0:
                return token
            key = (last[start], token)
            ok = fits.get(key)
            if ok is None:
                ok = fits[key] = self._follows(*key)
            if ok:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words: a depth-first walk of their trie, in sorted order."""
        if len(self.ids_of) > KEPT:
            self.ids_of.clear()
            self.text_of.clear()
        if len(self.fits) > 4 * KEPT:
            self.fits.clear()
        before, last, size = b"", [-1], {}
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            shared, most = 0, min(len(before), len(last), len(raw) - 1)
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(len(last), len(raw)):
                last.append(self._last(raw, end, self.inner, self.longest_inner, last))
            token, at, out = self._last(raw, len(raw), self.final, self.longest_final, last), len(raw), []
            while True:
                out.append(token)
                length = size.get(token)
                if length is None:
                    text = self.token_text[token]
                    length = size[token] = len(text) - (len(self.suffix) if at == len(raw) and text.endswith(self.suffix) else 0)
                at -= length
                if at == 0:
                    break
                token = last[at]
            out.reverse()
            self.ids_of[word] = b"".join(self.vocab_id[t].to_bytes(4, "little") for t in out)
            self.text_of[word] = " ".join(self.token_text[t] for t in out)
            before = raw

    def words(self, text: str) -> list[str]:
        if _PLAIN.search(text) is None:
            return _WORD.findall(text.lower())
        normal = self.full.normalizer.normalize_str(text)
        return [bytes(map(self.symbols.__getitem__, w)).decode("utf-8") for w, _ in self.full.pre_tokenizer.pre_tokenize_str(normal)]

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        cut = []
        for text in texts:
            parts = self.split.split(text) if self.split and "<" in text else [text]
            cut.append([self.words(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        new = set(chain.from_iterable(w for parts in cut for w in parts if isinstance(w, list)))
        if len(self.ids_of) > KEPT:
            self.learn(new)
        else:
            self.learn(new - self.ids_of.keys())
        out = []
        ids_of, text_of = self.ids_of.__getitem__, self.text_of.__getitem__
        for parts in cut:
            ids, decoded = [], []
            for part in parts:
                if isinstance(part, list):
                    ids.append(b"".join(map(ids_of, part)))
                    if part:
                        decoded.append(" ".join(map(text_of, part)))
                else:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    decoded.append(part)
            out.append((b"".join(ids), " ".join(decoded)))
        return out


@functools.lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: doc_id, n_tokens, ids, decoded.

    ``ids`` are packed as little-endian unsigned 32-bit integers, without
    special tokens but for those whose strings stand in the text; ``decoded``
    is the tokens joined by spaces, as the library decodes a vocabulary without
    a decoder. Null, empty and blank texts have no tokens and decode to an
    empty string; ids of rows pass through, null and repeated ones too; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = trie_bpe(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                done = bpe.encode_all([t or "" for t in texts[a:b]])
                columns = [batch.column(0).slice(a, b - a), pa.array([len(i) // 4 for i, _ in done], pa.int64()), pa.array([i for i, _ in done], pa.binary()), pa.array([t for _, t in done], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
