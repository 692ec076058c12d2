"""Byte-level BPE ids as the tokenizers library gives them, cached per Python worker."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class all Unicode versions and regular expression engines agree.
_PLAIN = re.compile("[^\t\n\r -~\xa1-ſ]")


def byte_symbols() -> dict[str, int]:
    """Printable stand-in -> byte, as byte-level vocabularies write them: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of whole texts. Plain Latin texts take the faster of two libraries that agree on them; all others take ``tokenizers``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path = path
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @functools.cached_property
    def full(self) -> Tokenizer:
        """The slower library, loaded by the first text that needs it."""
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) is None:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
