"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text's words, each closed by a space, are spelled byte by byte, and a byte
bit by bit. Hashed tables hold how often the next bit was 0 or 1 behind several
contexts, over the bytes of all training texts: the last 1..4 bytes of the word,
the word so far, twice, and the word so far with the word before, if that is one
that foretells the next (a successor seen ``REPEATED`` times or more makes up a
``SHARE``-th of all). Three of them (``BY_CLASS``) are kept apart by the class of
the text before the word: the signs of four directions, the leading principal
components of byte-pair frequencies over all training texts, summed from the
text's beginning to the word's, and whether there is a word before. The tables'
log odds are mixed with weights of a gate (bit place, kind of the last byte, how
much was counted), learned online, and refined by an adaptive map from the mixed
odds to observed rates; both are learned with one occurrence of each word taken
out. The end of a text has a rate that depends on the number of words so far. So
every text has a probability, whose bits per byte are returned too, and no word
is scored without what stands before it.

A word's probability depends on nothing but the word, its class and the word
before it, where that counts. So each distinct combination (a *token*) is
counted, learned from and spelled once for the whole corpus, weighted by its
occurrences, and a text's score is the sum over its tokens: the same as running
over all bytes of all texts, at a fraction of the work. Texts are packed in
blocks. A block sends its distinct words with their followers, and then its
distinct tokens, to buckets by the words' hash; buckets send back which words
foretell the next, and what each token costs and how often its word was seen:
what moves is a row for each block and bucket that it has words in, so never
more than a row for each distinct token of a block.
Nothing that is learned depends on how rows are laid out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillon.llm.common import Words, mix64, partitions, saved

#: Contexts without class of the word so far or word before, and all; least and most slots of a context's table.
INNER, CONTEXTS = 5, 7
TABLE, LARGEST = 1 << 18, 1 << 22
PARTS = 8
BLOCK_CHARS, BLOCK_DOCS = 5_000_000, 16384
GATES, LEVELS, STEPS = 8 * 5 * 16, 33, 15
STRIP, LEARNED = 1 << 15, 1 << 13
#: Characters for each mixer that learns by itself, as a square; most mixers.
ALONE, MIXERS = 1_000_000, 256
#: Bytes spelled at once.
PIECE = 1 << 20
LAGS = 48
#: Byte-pair features, leading components, and the contexts that are kept apart by class.
PAIRS, AXES, BY_CLASS = 128, 4, (2, 4, 5)
CLASSES = 2 << AXES
#: A word foretells the next if one successor was seen so often, and makes up one in so many.
REPEATED, SHARE = 2, 4
_SPACE = np.uint8(32)


def _zip(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32- or 64-bit numbers, byte by byte over all of them (equal bytes lie together), compressed."""
    wide = bool(x.max(initial=0) >> np.uint64(32)) if x.dtype.itemsize == 8 else False
    x = np.ascontiguousarray(x, "<u8" if wide else "<u4")
    return struct.pack("<q", x.itemsize) + _zip(np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    (width,) = struct.unpack_from("<q", data)
    raw = np.frombuffer(_unzip(data[8:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{width}")


# --- blocks of texts -----------------------------------------------------------


def pack_block(ids: list[int | None], flags: list[int], texts: list[str | None]) -> bytes:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    head = struct.pack("<q", len(ids)) + np.array([i is None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(flags) + np.array([len(r) for r in raw], "<i8").tobytes()
    return _zip(head + b"".join(raw), 3)


def unpack_block(blob: bytes) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    data = _unzip(blob)
    (n,) = struct.unpack_from("<q", data)
    at = 8
    null = np.frombuffer(data, np.uint8, n, at)
    ids = np.frombuffer(data, "<i8", n, at + n)
    flags = np.frombuffer(data, np.uint8, n, at + 9 * n)
    sizes = np.frombuffer(data, "<i8", n, at + 10 * n)
    ends = at + 18 * n + np.cumsum(sizes)
    return [None if z else int(i) for z, i in zip(null, ids)], flags, [data[e - s : e] for e, s in zip(ends, sizes)]


def pair_features(text: bytes) -> np.ndarray:
    """Square roots of the frequencies of hashed byte pairs, ASCII letters lower-cased, in steps of 1/256: sums of whole numbers have no order."""
    data = np.frombuffer(text.lower(), np.uint8)
    if len(data) < 2:
        return np.zeros(PAIRS)
    return np.rint(256 * np.sqrt(np.bincount(_pair(data[:-1], data[1:]), minlength=PAIRS) / (len(data) - 1)))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((first.astype(np.uint32) * np.uint32(251) + second) * np.uint32(0x9E3779B1)) >> np.uint32(25)


#: Texts and characters learned from, sums and products of their features.
MOMENTS = 2 + PAIRS + PAIRS * PAIRS


def _moments(flags: list[int], texts: list[str | None]) -> np.ndarray:
    own = [(t or "") for f, t in zip(flags, texts) if f & 2]
    rows = np.stack([pair_features(t.encode("utf-8", "surrogatepass")) for t in own] or [np.zeros(PAIRS)])
    return np.concatenate(([len(own), sum(map(len, own))], rows.sum(axis=0), (rows.T @ rows).ravel()))


def directions(moments: np.ndarray) -> np.ndarray:
    """What each byte pair adds to a text's place on the leading principal axes (features x axes), as whole numbers: the axes about the mean, for frequencies instead of their roots; signs are fixed by the largest part."""
    n = max(moments[0], 1.0)
    mean, products = moments[2 : PAIRS + 2] / 256 / n, moments[PAIRS + 2 :].reshape(PAIRS, PAIRS) / 65536 / n
    _, vectors = np.linalg.eigh(products - np.outer(mean, mean))
    lead = vectors[:, ::-1][:, :AXES]
    lead = lead * np.sign(lead[np.abs(lead).argmax(axis=0), np.arange(AXES)])
    pull = lead / (2 * np.maximum(mean, 0.02)[:, None])
    return np.rint((pull - (mean**2 @ pull) / max((mean**2).sum(), 1e-9)) * (1 << 16)).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts, and one row (negative block) of the partition's moments."""
    moments = np.zeros(MOMENTS)
    first, count = TaskContext.get().partitionId() << 32, 0
    held: tuple[list, list, list] = ([], [], [])
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal count, size, moments
        moments = moments + _moments(held[1], held[2])
        row = pa.RecordBatch.from_arrays([pa.array([first + count], pa.int64()), pa.array([pack_block(*held)], pa.binary())], names=["block", "blob"])
        for h in held:
            h.clear()
        count, size = count + 1, 0
        return row

    for batch in batches:
        for values in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            for h, v in zip(held, values):
                h.append(v)
            size += len(values[2] or "")
            if size >= BLOCK_CHARS or len(held[0]) >= BLOCK_DOCS:
                yield flush()
    if held[0]:
        yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([-1 - first], pa.int64()), pa.array([_zip(moments.astype("<f8").tobytes())], pa.binary())], names=["block", "blob"])


def _followers(buckets: int):
    """(bucket, block, payload): a block's distinct words in each bucket, and what follows them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, flags, texts = unpack_block(blob)
                rows = list(BlockWords(texts, buckets).followers((flags & 2) > 0))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], names=["bucket", "block", "payload"])

    return run


class BlockWords:
    """A block's words: the distinct ones by bucket and hash, and which stands where in which text."""

    def __init__(self, texts: list[bytes], buckets: int):
        lists = [t.lower().split() for t in texts]
        self.bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        coded = pa.array(chain.from_iterable(lists), pa.binary(), size=int(self.bounds[-1])).dictionary_encode()
        del lists
        hashes = _hashes(*_buffers(coded.dictionary))
        order = np.lexsort((hashes, hashes % np.uint64(buckets)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at = place[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int64)
        self.distinct, self.hashes = coded.dictionary.take(pa.array(order)), hashes[order]
        self.limits = np.searchsorted((self.hashes % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))

    def spaced(self, lo: int, hi: int) -> np.ndarray:
        """Bytes of the distinct words ``lo``..``hi``, each closed by a space."""
        data, limits = _buffers(self.distinct.slice(lo, hi - lo))
        out = np.full(len(data) + hi - lo, _SPACE)
        out[np.arange(len(data)) + np.repeat(np.arange(hi - lo), np.diff(limits))] = data
        return out

    def begins(self) -> np.ndarray:
        """Whether each word is its text's first."""
        out = np.zeros(len(self.at), bool)
        starts = self.bounds[:-1][np.diff(self.bounds) > 0]
        out[starts] = True
        return out

    def followers(self, learn: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, payload): its distinct words' hashes, and how often which word (by 16 bits of its hash) stands behind them in texts to learn from."""
        behind = np.repeat(learn, np.diff(self.bounds)) & ~self.begins()
        at = np.flatnonzero(behind)
        pairs, counts = np.unique((self.at[at - 1].astype(np.uint64) << np.uint64(16)) | (self.hashes[self.at[at]] >> np.uint64(48)), return_counts=True)
        word = (pairs >> np.uint64(16)).astype(np.int64)
        edges = np.searchsorted(word, self.limits)
        for b in np.flatnonzero(np.diff(self.limits)).tolist():
            lo, hi = int(self.limits[b]), int(self.limits[b + 1])
            p, q = int(edges[b]), int(edges[b + 1])
            yield b, _join(_planes(np.diff(self.hashes[lo:hi] // np.uint64(len(self.limits) - 1), prepend=np.uint64(0))), _planes((word[p:q] - lo).astype("<u4")), pairs[p:q].astype("<u2").tobytes(), _planes(counts[p:q].astype("<u4")))

    def classes(self, pull: np.ndarray) -> np.ndarray:
        """Class of the text before each word: the signs of its byte pairs' sums on the axes, and 2**AXES more where there is a word before."""
        n = len(self.at)
        if not n:
            return np.zeros(0, np.uint8)
        data = np.concatenate(([_SPACE], self.spaced(0, len(self.hashes))))
        pair = _pair(data[:-1], data[1:])
        starts = np.flatnonzero(data == _SPACE)[:-1]
        begin = np.repeat(self.bounds[:-1], np.diff(self.bounds))
        out = np.where(begin < np.arange(n), 1 << AXES, 0).astype(np.uint8)
        for axis in range(AXES):
            of_word = np.add.reduceat(pull[:, axis].take(pair), starts)
            sums = np.concatenate(([0], np.cumsum(of_word[self.at])))[:-1]
            out += (sums > sums[begin]).astype(np.uint8) << np.uint8(axis)
        return out


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each begins and the last ends) of a binary array."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = words.buffers()
    limits = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(values, np.uint8)[limits[0] : limits[-1]], limits - limits[0]


def _hashes(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    words = Words([])
    words.data, words.start, words.end = data, limits[:-1], limits[1:]
    return words.hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _hashes(*_buffers(pa.array(words, pa.binary())))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and the place of each: by hashing, which is faster than sorting them all."""
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[coded.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)


class BlockTokens:
    """A block's distinct tokens (word, class, and the word before where it counts) by bucket, and which stands where."""

    def __init__(self, own: BlockWords, foretells: np.ndarray, pull: np.ndarray):
        self.own = own
        before = np.zeros(len(own.at), np.int64)
        if len(own.at):
            before[1:] = np.where(foretells[own.at[:-1]], own.at[:-1] + 1, 0)
            before[own.begins()] = 0
        tokens, self.inverse = _distinct((own.at * (len(own.hashes) + 1) + before) * CLASSES + own.classes(pull))
        self.kind, rest = (tokens % CLASSES).astype(np.uint8), tokens // CLASSES
        before, self.word = rest % (len(own.hashes) + 1), rest // (len(own.hashes) + 1)
        self.before = np.concatenate((np.zeros(1, np.uint32), (own.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)))[before]
        self.limits = np.searchsorted(self.word, own.limits)

    def __len__(self) -> int:
        return len(self.word)


def foretold(own: BlockWords, answers: dict[int, bytes]) -> np.ndarray:
    """Whether each distinct word of a block foretells the next, from the buckets' answers."""
    out = np.zeros(len(own.hashes), bool)
    for b, mask in answers.items():
        lo, hi = int(own.limits[b]), int(own.limits[b + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
    return out


def _foretell(table: pa.Table) -> pa.Table:
    """For each block's words of a bucket, a bit for each: whether the word foretells the next."""
    blocks, parts = table.column("block").to_pylist(), [_parted(p) for p in table.column("payload").to_pylist()]
    own = [np.cumsum(_unplanes(p[0]), dtype=np.uint64) for p in parts]  # the hashes, divided by the number of buckets
    distinct, place = np.unique(np.concatenate(own), return_inverse=True)
    sizes = np.cumsum([0] + [len(x) for x in own])
    word = np.concatenate([place[s + _unplanes(p[1])] for s, p in zip(sizes, parts)])
    pairs, inverse = np.unique((word.astype(np.uint64) << np.uint64(16)) | np.concatenate([np.frombuffer(p[2], "<u2") for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([_unplanes(p[3]) for p in parts]), minlength=len(pairs))
    word = (pairs >> np.uint64(16)).astype(np.int64)
    total, most = np.bincount(word, weights=counts, minlength=len(distinct)), np.zeros(len(distinct))
    np.maximum.at(most, word, counts)
    sure = (most >= REPEATED) & (most * SHARE >= total)
    masks = [np.packbits(sure[place[a:b]]).tobytes() for a, b in zip(sizes, sizes[1:])]
    return pa.table([pa.array(blocks, pa.int64()), pa.array([table.column("bucket")[0].as_py()] * len(blocks), pa.int32()), pa.array(masks, pa.binary())], names=["block", "bucket", "payload"])


def lag(n: np.ndarray) -> np.ndarray:
    """Class of a count of words so far, finer for small ones."""
    return np.minimum(np.floor(2 * np.log2(n + 1.0)), LAGS - 1).astype(np.int64)


def _join(*parts: bytes) -> bytes:
    return b"".join(struct.pack("<q", len(p)) + p for p in parts)


def _parted(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        (n,) = struct.unpack_from("<q", payload, at)
        out.append(payload[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _ends(n_words: np.ndarray) -> bytes:
    """How many texts ended at each class of length, and how many words stood there to go on."""
    reach = np.bincount(n_words, minlength=int(n_words.max(initial=0)) + 1)
    of = lag(np.arange(len(reach)))
    at_risk = np.bincount(of, weights=reach[::-1].cumsum()[::-1], minlength=LAGS)
    return np.concatenate((np.bincount(of, weights=reach, minlength=LAGS), at_risk)).astype("<f8").tobytes()


def _request(buckets: int, pull: np.ndarray):
    """(bucket, block, payload): the block's distinct tokens and their training counts in each bucket; negative buckets hold the ends of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, answers in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                _, flags, texts = unpack_block(blob)
                own = BlockWords(texts, buckets)
                tokens = BlockTokens(own, foretold(own, {a["bucket"]: a["payload"] for a in answers or ()}), pull)
                n_words, learn = np.diff(own.bounds), (flags & 2) > 0
                weight = np.bincount(tokens.inverse, weights=np.repeat(learn, n_words), minlength=len(tokens)).astype("<u4")
                rows = []
                for b in np.flatnonzero(np.diff(tokens.limits)).tolist():
                    lo, hi = int(tokens.limits[b]), int(tokens.limits[b + 1])
                    w, x = int(own.limits[b]), int(own.limits[b + 1])
                    before = tokens.before[lo:hi]
                    rows.append((b, block, _join(_zip(own.spaced(w, x).tobytes()), _planes((tokens.word[lo:hi] - w).astype("<u4")), _zip(tokens.kind[lo:hi].tobytes()), _zip(np.packbits(before > 0).tobytes()), before[before > 0].astype("<u4").tobytes(), _planes(weight[lo:hi]))))
                rows.append((-1 - block % 16, block, _ends(n_words[learn])))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "block", "payload"])

    return run


def _before(flags: bytes, hashes: bytes, n: int) -> np.ndarray:
    """The hash (32 bits) of the word before each token, 0 where none counts."""
    out = np.zeros(n, np.uint32)
    out[np.unpackbits(np.frombuffer(_unzip(flags), np.uint8), count=n).astype(bool)] = np.frombuffer(hashes, "<u4")
    return out


_MERGED = "kind int, block long, bucket int, n long, v long, payload binary"
#: Kinds of rows: a bucket's distinct tokens, with its numbers of training words and of distinct ones; where a block's tokens stand among them, right behind; ends of texts.
DISTINCT, PLACES, ENDS = 0, 1, 2


def _repeat(words: list[bytes], which: np.ndarray) -> bytes:
    """The chosen words, each closed by a space."""
    return b" ".join([*map(words.__getitem__, which.tolist()), b""])


def _merge(table: pa.Table) -> pa.Table:
    """All requests of one bucket: its distinct tokens with their counts, and for each block the places of its own."""
    blocks, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    rows = []
    if bucket < 0:
        rows.append((ENDS, 0, bucket, 0, 0, sum(np.frombuffer(p, "<f8") for p in payloads).astype("<f8").tobytes()))
    else:
        order = sorted(range(len(blocks)), key=lambda i: blocks[i])
        parts = [_parted(payloads[i]) for i in order]
        lists = [_unzip(p[0]).split() for p in parts]
        words = list(chain.from_iterable(lists))
        distinct, first, inverse = np.unique(word_hashes(words), return_index=True, return_inverse=True)
        sizes = np.cumsum([0] + [len(x) for x in lists])
        texts = [words[i] for i in first.tolist()]
        del words, lists
        kinds = [np.frombuffer(_unzip(p[2]), np.uint8) for p in parts]
        limits = np.cumsum([0] + [len(k) for k in kinds])
        key = np.concatenate([inverse[s + _unplanes(p[1])] * CLASSES + k for s, p, k in zip(sizes, parts, kinds)])
        before = np.concatenate([_before(p[3], p[4], len(k)) for p, k in zip(parts, kinds)])
        by = np.lexsort((before, key))
        fresh = np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (before[by][1:] != before[by][:-1])))
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(fresh) - 1
        key, before = key[by][fresh], before[by][fresh]
        counts = np.bincount(place, weights=np.concatenate([_unplanes(p[5]) for p in parts])).astype("<u8")
        word, kind = key // CLASSES, (key % CLASSES).astype(np.uint8)
        total = np.bincount(word, weights=counts, minlength=len(distinct)).astype("<u8")

        tokens = _zip(_repeat(texts, word)), _zip(kind.tobytes()), _zip(before.astype("<u4").tobytes())
        rows.append((DISTINCT, 0, bucket, int(total.sum()), int((total > 0).sum()), _join(*tokens, _planes(total[word]), _planes(counts))))
        for i, a, b in zip(order, limits, limits[1:]):
            rows.append((PLACES, blocks[i], bucket, 0, 0, _planes(place[a:b].astype("<u4"))))
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["kind", "block", "bucket", "n", "v", "payload"])


# --- bit predictors ------------------------------------------------------------


def contexts(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the last 0..4 bytes of the same word before each byte, and the kind of the last byte."""
    padded = np.concatenate((np.full(INNER, _SPACE), data))
    n, last, out = len(data), None, [np.full(len(data), 0x9E3779B1, np.uint32)]
    kind = None
    for k in range(1, INNER):
        prev = padded[INNER - k : INNER - k + n]
        last = prev if last is None else np.where(last == _SPACE, _SPACE, prev)
        if kind is None:
            kind = np.where(prev == 32, 0, np.where(prev >= 128, 1, np.where((prev >= 48) & (prev <= 57), 2, np.where((prev >= 97) & (prev <= 122), 3, 4)))).astype(np.int64)
        with np.errstate(over="ignore"):
            out.append((out[-1] ^ (last.astype(np.uint32) + np.uint32(1))) * np.uint32(0x85EBCA6B) + np.uint32(k))
    return out, kind


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
        return x ^ (x >> np.uint32(16))


def predictors(data: np.ndarray, classes: np.ndarray, before: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Context hashes of every byte of words closed by spaces, and the kind of the last byte; ``classes`` and ``before`` (hash of the word before, or 0) have one number for each word."""
    of, kind = contexts(data)
    number, n = _per_word(data), len(data)
    starts = np.concatenate(([0], np.flatnonzero(data == _SPACE) + 1))
    with np.errstate(over="ignore"):
        place = (np.arange(n, dtype=np.int64) - starts[number]).astype(np.uint32) if n else np.zeros(0, np.uint32)
        sums = np.zeros(n + 1, np.uint32)
        np.cumsum(_scramble(data.astype(np.uint32) * np.uint32(0x9E3779B1) + place * np.uint32(0x85EBCA6B) + np.uint32(1)), dtype=np.uint32, out=sums[1:])
        so_far = sums[:-1] - sums[starts[number]] if n else sums[:0]
        of[0] = _scramble(so_far + np.uint32(11))
        of.append(_scramble(so_far + np.uint32(5)))
        of.append(_scramble(so_far * np.uint32(3) + _scramble(before.astype(np.uint32) + np.uint32(6))[number]) if n else so_far)
        if n:
            salt = classes.astype(np.uint32)[number] * np.uint32(0x3779B1) + np.uint32(9)
            for k in BY_CLASS:
                of[k] = _scramble(of[k] ^ salt)
    return of, kind


def slots(context: np.ndarray, nibble: np.ndarray, size: int) -> np.ndarray:
    """First of the 16 cells of a half byte behind a context and the half byte before it (0 for none, else 16 + its value)."""
    with np.errstate(over="ignore"):
        h = _scramble(context + nibble * np.uint32(0x9E3779B1))
    return (h >> np.uint32(36 - size.bit_length() + 1)).astype(np.int64) << 4


def bits(data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
    """(bit place, node, bit, half byte before where a half begins, cell in the half) of every byte, high bit first; a node is the bits so far behind a leading 1."""
    wide = data.astype(np.uint32)
    for place in range(8):
        within = place & 3
        before = None if within else (wide >> np.uint32(4)) + np.uint32(16) if place else np.zeros(len(data), np.uint32)
        half = wide >> np.uint32(4) if place < 4 else wide & np.uint32(15)
        cell = ((np.uint32(1) << np.uint32(within)) | (half >> np.uint32(4 - within))).astype(np.int64)
        yield place, (np.uint32(1) << np.uint32(place)) | (wide >> np.uint32(8 - place)), (wide >> np.uint32(7 - place)) & np.uint32(1), before, cell


def count_halves(context: np.ndarray, data: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Count both half bytes of the bytes, as often as they weigh, in one context's ``counts``: 16 values behind each context and half byte before."""
    wide = data.astype(np.uint32)
    high = wide >> np.uint32(4)
    for before, half in ((np.zeros(len(data), np.uint32), high), (high + np.uint32(16), wide & np.uint32(15))):
        np.add.at(counts, slots(context, before, len(counts)) + half, weight)


def cells(halves: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 of every node of the half bytes, from the counts of their 16 values."""
    values = halves.reshape(-1, 16)
    out = np.zeros((len(values), 16, 2), values.dtype)
    for depth in range(4):
        out[:, 1 << depth : 2 << depth] = values.reshape(len(values), 1 << depth, 2, -1).sum(axis=3)
    return out.reshape(-1, 2)


def bounded(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts as 16-bit numbers; larger pairs are scaled down, their odds kept."""
    most = np.maximum(counts.max(axis=-1, keepdims=True), 65535.0)
    return np.maximum(np.rint(counts * (65535.0 / most)), counts > 0).astype(np.uint16)


_LOG = np.log(np.arange(65536) + 0.4).astype(np.float32)


#: One occurrence of a 0, of a 1, in a pair seen as one number (zeros first, little-endian).
_ONE = np.array([1, 1 << 16], np.uint32)


def _trust(total: np.ndarray) -> np.ndarray:
    """0 to 3: how much was counted: nothing, once, up to 6 times, more."""
    return (total > 0).astype(np.int16) + (total > 1) + (total > 6)


def codes(pairs: np.ndarray) -> np.ndarray:
    """Log odds of bounded pairs in steps of 1/STEPS, and above them how much was counted."""
    odds = np.rint(np.clip(_LOG[pairs[..., 1]] - _LOG[pairs[..., 0]], -8, 8) * STEPS).astype(np.int16)
    return odds + 128 + 256 * _trust(pairs[..., 0].astype(np.int64) + pairs[..., 1])


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _level(mixed: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((mixed + 8) * 2), 0, LEVELS - 1).astype(np.int64)


def _gate(kind: np.ndarray, place: int, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Weight set: kind of the last byte, bit place, and how much was counted behind the word so far, and behind it and the word before."""
    return (kind * 8 + place) * 16 + word * 4 + pair


class Spelling:
    """Mixer and adaptive map over the merged tables."""

    def __init__(self, counts: np.ndarray | None, weights: np.ndarray | None = None, rates: np.ndarray | None = None, odds: np.ndarray | None = None):
        self.counts = counts if counts is None or counts.dtype == np.uint16 else bounded(counts)
        self.odds, self.steps = odds, 0
        self.weights = np.full((GATES, CONTEXTS + 1), 0.2) if weights is None else weights
        if weights is None:
            self.weights[:, -1] = 0
        self.average = self.weights.copy()
        self.rates = np.zeros((256 * LEVELS, 2)) if rates is None else rates
        centre = _squash((np.arange(LEVELS) / 2 - 8))
        prior = 20 * np.tile(centre, 256)
        self.refined = ((self.rates[:, 1] + prior) / (self.rates.sum(axis=1) + 20)).astype(np.float32)

    def learn(self, data: np.ndarray, classes: np.ndarray, before: np.ndarray, weight: np.ndarray, step: float = 0.03) -> None:
        """Online steps over strips of words' bytes, one for each bit place of a strip; one occurrence of each byte is taken out of the counts. ``weight`` is how often each token occurs."""
        of, kind = predictors(data, classes, before)
        each = weight.astype(np.float64)[_per_word(data)]
        for lo in range(0, len(data), LEARNED):
            at = slice(lo, lo + LEARNED)
            self._strip(data[at], [c[at] for c in of], kind[at], each[at], step)
            self.steps += 1
            self.average += (self.weights - self.average) * (2 / (self.steps + 1))  # later weights count more

    def _strip(self, data: np.ndarray, of: list[np.ndarray], kind: np.ndarray, each: np.ndarray, step: float) -> None:
        size, first, trust = self.counts.shape[1], [None] * CONTEXTS, [None] * (CONTEXTS - INNER)
        damped = np.sqrt(each).astype(np.float32)
        packed, x = self.counts.view(np.uint32)[:, :, 0], np.ones((CONTEXTS + 1, len(data)), np.float32)
        for place, node, bit, before, cell in bits(data):
            one = _ONE.take(bit)
            for k in range(CONTEXTS):
                if before is not None:
                    first[k] = slots(of[k], before, size)
                pair = packed[k].take(first[k] + cell) - one
                ones, zeros = pair >> np.uint32(16), pair & np.uint32(0xFFFF)
                x[k] = _LOG.take(ones) - _LOG.take(zeros)
                if k >= INNER:
                    trust[k - INNER] = _trust(ones + zeros)
            np.clip(x[:CONTEXTS], -8, 8, out=x[:CONTEXTS])
            gate = _gate(kind, place, *trust[:2])
            weights = self.weights.T.astype(np.float32)
            mixed = sum(x[j] * weights[j].take(gate) for j in range(CONTEXTS + 1))
            p = _squash(np.clip(mixed, -12, 12))
            np.add.at(self.rates.reshape(-1), (node.astype(np.int64) * LEVELS + _level(mixed)) * 2 + bit, each)
            pull, seen = (bit.astype(np.float32) - p) * damped, np.bincount(gate, weights=damped, minlength=GATES)
            for j in range(CONTEXTS + 1):
                self.weights[:, j] += step * 4 * np.bincount(gate, weights=pull * x[j], minlength=GATES) / (seen + 50.0)

    def cost(self, data: np.ndarray, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log of each byte's probability, given all bytes of its word before it, the word's class and the word before."""
        if self.odds is None:
            self.odds = np.stack([codes(c) for c in self.counts])
        out = np.zeros(len(data))
        weights, refined, size = self.weights.T.astype(np.float32), self.refined, self.odds.shape[1]
        of_all, kinds = predictors(data, classes, before)
        for lo in range(0, len(data), STRIP):
            part, of, kind = data[lo : lo + STRIP], [c[lo : lo + STRIP] for c in of_all], kinds[lo : lo + STRIP]
            first, trust, total = [None] * CONTEXTS, [None] * (CONTEXTS - INNER), np.zeros(len(part), dtype=np.float64)
            for place, node, bit, before, cell in bits(part):
                x = np.empty((CONTEXTS, len(part)), np.float32)
                for k in range(CONTEXTS):
                    if before is not None:
                        first[k] = slots(of[k], before, size)
                    code = self.odds[k].take(first[k] + cell)
                    x[k] = (code & 255) - 128
                    if k >= INNER:
                        trust[k - INNER] = code >> 8
                x *= np.float32(1 / STEPS)
                gate = _gate(kind, place, *trust[:2])
                mixed = weights[CONTEXTS].take(gate) + sum(x[j] * weights[j].take(gate) for j in range(CONTEXTS))
                p = 0.5 * (_squash(np.clip(mixed, -12, 12)) + refined[node.astype(np.int64) * LEVELS + _level(mixed)])
                total += np.log(np.where(bit == 1, p, 1 - p))
            out[lo : lo + STRIP] = total
        return out


def _per_word(data: np.ndarray) -> np.ndarray:
    """Which word each byte belongs to; a closing space belongs to its word."""
    return np.concatenate(([0], np.cumsum(data == _SPACE)[:-1])) if len(data) else np.zeros(0, np.int64)


def _pieces(words: bytes, *of_words: np.ndarray) -> Iterator[tuple]:
    """Words closed by spaces, some at a time, whole words only, with the parts of ``of_words`` that are theirs."""
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == _SPACE) + 1
    lo = first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, lo + PIECE, side="right")))
        yield data[lo : ends[last - 1]], *[x[first:last] for x in of_words]
        lo, first = int(ends[last - 1]), last


def _tokens(payload: bytes) -> tuple[bytes, np.ndarray, np.ndarray, list[bytes]]:
    """(words closed by spaces, classes, hashes of the words before, what follows) of tokens."""
    spelled, kinds, before, *more = _parted(payload)
    return _unzip(spelled), np.frombuffer(_unzip(kinds), np.uint8), np.frombuffer(_unzip(before), "<u4"), more


def _learned(payload: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words closed by spaces, classes, hashes of the words before, training counts) of a bucket's tokens that training texts hold."""
    words, kind, before, (_, counts) = _tokens(payload)
    counts = _unplanes(counts)
    some = np.flatnonzero(counts)
    return _repeat(words.split(b" "), some), kind[some], before[some], counts[some]


def _sliced(slices: int):
    """(slice, payload): a bucket's training tokens, by their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                words, kind, before, counts = _learned(payload)
                words = words.split()
                own = mix64(word_hashes(words)) % np.uint64(slices)
                rows = [(s, some) for s in range(slices) if len(some := np.flatnonzero(own == s))]
                payloads = [_join(_zip(_repeat(words, some)), _zip(kind[some].tobytes()), _zip(before[some].astype("<u4").tobytes()), _planes(counts[some])) for _, some in rows]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array(payloads, pa.binary())], names=["slice", "payload"])

    return run


def _stacked(blobs: list[bytes], kind, width: int) -> np.ndarray:
    """Tables of one size, one after the other: contexts x slots x width."""
    out = None
    for i, blob in enumerate(blobs):
        one = np.frombuffer(_unzip(blob), kind).reshape(-1, width)
        out = np.empty((len(blobs), *one.shape), kind) if out is None else out
        out[i] = one
    return out


def table_size(distinct: int) -> int:
    """Slots of each context's table: 16 or more for each distinct training word, up to ``LARGEST``."""
    return min(max(TABLE, 1 << (16 * max(distinct, 1) - 1).bit_length()), LARGEST)


def mixers(characters: float) -> int:
    """Mixers that learn by themselves: as the square root of the training texts' characters."""
    return int(min(max(1, 2 ** round(np.log2(max(characters / ALONE, 1)) / 2)), MIXERS))


def _tables(size: int):
    """Each context's counts over the training tokens of a partition, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_learned(p) for batch in batches for p in batch.column(0).to_pylist()]
        if not held:
            return
        width = size // PARTS
        pieces = []
        for words, kind, before, counts in held:
            for data, *of_words, weight in _pieces(words, kind, before, counts):
                pieces.append((predictors(data, *of_words)[0], data, weight.astype(np.uint64)[_per_word(data)]))
        for k in range(CONTEXTS):
            counts = np.zeros(size, np.uint64)
            for of, data, weight in pieces:
                count_halves(of[k], data, weight, counts)
                of[k] = None
            rows = [_planes(counts[p * width : (p + 1) * width]) for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * PARTS, pa.int32()), pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["context", "part", "payload"])

    return run


def _add_moments(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(_unzip(p), "<f8") for p in table.column("payload").to_pylist())
    return pa.table([table.column("context").slice(0, 1), table.column("part").slice(0, 1), pa.array([_zip(total.astype("<f8").tobytes())], pa.binary())], names=["context", "part", "payload"])


def _add_tables(table: pa.Table) -> pa.Table:
    total = 0.0
    for p in table.column("payload"):
        total = total + _unplanes(p.as_py()).astype(np.float64)
    return pa.table([table.column("context").slice(0, 1), table.column("part").slice(0, 1), pa.array([_zip(bounded(cells(total)).tobytes())], pa.binary())], names=["context", "part", "payload"])


def _fit(counts_value):
    """One mixer for a slice: its training tokens in the order of their words' hashes and classes, whatever buckets they come from."""

    def run(table: pa.Table) -> pa.Table:
        model = Spelling(_stacked(counts_value.value, np.uint16, 2))
        held = [_tokens(p) for p in table.column("payload").to_pylist()]
        kind, before = (np.concatenate([h[i] for h in held]) for i in (1, 2))
        counts, words = np.concatenate([_unplanes(h[3][0]) for h in held]), list(chain.from_iterable(h[0].split() for h in held))
        held.clear()
        order = np.lexsort((before, kind, word_hashes(words)))
        words = _repeat(words, order)
        for data, *of_words in _pieces(words, kind[order], before[order], counts[order]):
            model.learn(data, *of_words)
        return pa.table([table.column("slice").slice(0, 1), pa.array([float(counts.sum())]), pa.array([model.average.astype("<f8").tobytes()], pa.binary()), pa.array([_zip(model.rates.astype("<f8").tobytes())], pa.binary())], names=["slice", "seen", "weights", "rates"])

    return run


# --- scoring -------------------------------------------------------------------


_ANSWER = "block long, bucket int, payload binary"


def spell_buckets(model_value):
    """(block, bucket, costs and training counts of the block's tokens): each distinct token of a bucket is spelled once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, cost, total = None, None, None
        for batch in batches:
            for kind, block, bucket, payload in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if kind == DISTINCT:
                    m = model_value.value
                    spelling = spelling or Spelling(None, m["weights"], m["rates"], _stacked(m["odds"], np.int16, 1)[:, :, 0])
                    words, kinds, before, (totals, _) = _tokens(payload)
                    cost = np.concatenate([np.add.reduceat(spelling.cost(data, *of_words), np.concatenate(([0], np.flatnonzero(data == _SPACE)[:-1] + 1))) for data, *of_words in _pieces(words, kinds, before)])
                    total = _unplanes(totals)
                else:
                    at = _unplanes(payload)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_join(cost[at].astype("<f4").tobytes(), _planes(total[at]))], pa.binary())], names=["block", "bucket", "payload"])

    return run


class Scorer:
    """Scores blocks from what their tokens cost."""

    def __init__(self, model: dict, buckets: int):
        self.model, self.buckets = model, buckets

    def block(self, blob: bytes, masks: dict[int, bytes], answers: dict[int, bytes]) -> list[list]:
        m = self.model
        ids, flags, texts = unpack_block(blob)
        own = BlockWords(texts, self.buckets)
        tokens = BlockTokens(own, foretold(own, masks), m["pull"])
        cost, count = np.zeros(len(tokens)), np.zeros(len(tokens))
        for b, payload in answers.items():
            at = slice(int(tokens.limits[b]), int(tokens.limits[b + 1]))
            costs, counts = _parted(payload)
            cost[at], count[at] = np.frombuffer(costs, "<f4"), _unplanes(counts)
        n_words, bounds, inverse = np.diff(own.bounds), own.bounds, tokens.inverse
        below = np.log10(m["tokens"] + 0.5 * (m["distinct"] + 1))
        base = np.log10(count + 0.5) - below
        total = lambda each: np.add.reduceat(np.append(each[inverse], 0.0), np.append(bounds[:-1], len(inverse)))[: len(n_words)] * (n_words > 0)
        ends = m["ends"]
        stay = np.concatenate(([0.0], np.cumsum(np.log1p(-ends[lag(np.arange(int(n_words.max(initial=0)) + 1))]))))
        end_log = stay[n_words] + np.log(ends[lag(n_words)])
        score = (total(cost) + end_log) / np.log(10)
        size = np.array([len(t) for t in texts])
        return [
            ids, [bool(f & 1) for f in flags], (n_words + 1).tolist(), (total((count > 0).astype(np.float64)).astype(np.int64) + int(m["end_count"] > 0)).tolist(),
            (total(base) + np.log10(m["end_count"] + 0.5) - below).tolist(), score.tolist(), (-score * np.log2(10) / np.maximum(size, 1)).tolist(),
        ]


class Fitted:
    """What a corpus teaches, and the distributed pieces that scoring needs."""

    def __init__(self, docs: DataFrame, modulus: int, remainder: int, id_col: str, text_col: str):
        spark = docs.sparkSession
        rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus
        held, learn = F.coalesce(rest == remainder, F.lit(False)), F.coalesce(rest != remainder, F.lit(False))
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (held.cast("int") + 2 * learn.cast("int")).alias("flags"), F.col(text_col).alias("text"))
        self.buckets = partitions(spark)
        # dealt by number once: the joins below find the blocks where they are
        packed = saved(rows.mapInArrow(_pack, "block long, blob binary").repartition(self.buckets, "block"))
        self.blocks = packed.where("block >= 0")
        moments = packed.where("block < 0").select(F.lit(0).alias("context"), F.pmod(F.shiftright(-1 - F.col("block"), 32), F.lit(16)).cast("int").alias("part"), F.col("blob").alias("payload"))
        moments = moments.groupBy("context", "part").applyInArrow(_add_moments, "context int, part int, payload binary").collect()
        moments = sum((np.frombuffer(_unzip(r["payload"]), "<f8") for r in moments), np.zeros(MOMENTS))
        pull, slices = directions(moments), mixers(moments[1])
        masks = self.blocks.mapInArrow(_followers(self.buckets), "bucket int, block long, payload binary").groupBy("bucket").applyInArrow(_foretell, _ANSWER)
        self.masks = saved(masks.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("masks")))  # a bit for each word
        requests = self.blocks.join(self.masks, "block", "left").select("block", "blob", "masks").mapInArrow(_request(self.buckets, pull), "bucket int, block long, payload binary")
        merged = saved(requests.groupBy("bucket").applyInArrow(_merge, _MERGED))
        n, v = merged.where(F.col("kind") == DISTINCT).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
        ends = sum((np.frombuffer(r["payload"], "<f8") for r in merged.where(F.col("kind") == ENDS).select("payload").collect()), np.zeros(2 * LAGS))
        texts = int(ends[:LAGS].sum())

        learn, size = merged.where(F.col("kind") == DISTINCT).select("payload"), table_size(v)
        counts, width = np.zeros((CONTEXTS, size, 2), dtype=np.uint16), size // PARTS
        few = learn.coalesce(max(16, self.buckets // 4))
        for r in few.mapInArrow(_tables(size), "context int, part int, payload binary").groupBy("context", "part").applyInArrow(_add_tables, "context int, part int, payload binary").toLocalIterator():
            counts[r["context"], r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(_unzip(r["payload"]), np.uint16).reshape(width, 2)
        shared = spark.sparkContext.broadcast([_zip(c.tobytes()) for c in counts])  # CONTEXTS x LARGEST pairs at most
        weights, rates, seen = np.zeros((GATES, CONTEXTS + 1)), np.zeros((256 * LEVELS, 2)), 0.0
        fitted = learn.mapInArrow(_sliced(slices), "slice int, payload binary").groupBy("slice").applyInArrow(_fit(shared), "slice int, seen double, weights binary, rates binary")
        for r in sorted(fitted.collect(), key=lambda r: r["slice"]):  # MIXERS rows at most
            weights += r["seen"] * np.frombuffer(r["weights"], "<f8").reshape(weights.shape)
            rates += np.frombuffer(_unzip(r["rates"]), "<f8").reshape(rates.shape)
            seen += r["seen"]
        shared.destroy()
        self.counts, self.weights, self.rates = counts, weights / seen if seen else Spelling(counts).weights, rates
        self.train_tokens = int(n + texts)
        self.small = {"pull": pull, "tokens": n + texts, "distinct": v + (texts > 0), "end_count": texts, "ends": np.clip((ends[:LAGS] + 0.05) / (ends[LAGS:] + 0.1), 1e-9, 1 - 1e-9)}
        spelling = spark.sparkContext.broadcast({"odds": [_zip(codes(c).tobytes()) for c in counts], "weights": self.weights, "rates": rates})
        # a bucket's rows lie together in the checkpoint, its distinct tokens first
        costs = merged.where(F.col("kind").isin(DISTINCT, PLACES)).select("kind", "block", "bucket", "payload").mapInArrow(spell_buckets(spelling), _ANSWER)
        self.costs = costs.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("costs"))  # a row for each bucket at most


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, modulus: int = 5, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probability of every whole text under a model learned from the texts that are not held out.

    Held out are rows whose CRC-32 of the id as text has the remainder; rows
    without an id are scored but not learned from. Tokens are words (runs of
    bytes other than white space, ASCII letters lower-cased) and one end.
    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (add-half unigrams), score and bits_per_byte (per
    byte of the text, of one byte for an empty one). Null and empty texts are
    the end alone; repeated rows count each; with nothing to learn from, words
    are spelled with even odds; an empty table gives no rows.
    """
    fitted = Fitted(docs, modulus, remainder, id_col, text_col)
    buckets, model_value = fitted.buckets, docs.sparkSession.sparkContext.broadcast(fitted.small)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model_value.value, buckets)
        for batch in batches:
            for blob, masks, costs in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                columns = scorer.block(blob, {a["bucket"]: a["payload"] for a in masks or ()}, {a["bucket"]: a["payload"] for a in costs or ()})
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    scored = fitted.blocks.join(fitted.masks, "block", "left").join(fitted.costs, "block", "left").select("blob", "masks", "costs").mapInArrow(score, _SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
