"""Packing token pieces into sequences by minimum bin slack.

A document's ids are cut into pieces of at most the capacity. Only the count of
pieces of each length reaches the driver: at most ``capacity`` numbers, whatever
the corpus. There each bin takes the longest piece left and the combination of
the others that fills it most, by a subset-sum over a bitset; that combination
is repeated as often as the counts allow, so every step uses up a length and
there are at most ``capacity`` of them. Ranks among pieces of equal length then
map each piece to its sequence and offset.
"""

from __future__ import annotations

import ctypes
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, gapless_rank, map_in_arrow

CAPACITY = 4096
END_ID = 1
#: Words that a Python worker keeps ids of, in each of two generations: some 25 MB each, 40 at most.
CACHE = 150_000
#: Longer words aren't kept.
_KEPT = 64
#: Characters of text that are tokenised at once.
_BLOCK = 1 << 18
_encoders: dict[str, WordCache] = {}


#: The signs that stand for bytes 0x80 to 0xA0 and 0xAD in a byte-level vocabulary; higher bytes stand for themselves.
_BYTE_SIGNS = {b: 256 + 33 + i for i, b in enumerate([0x7F, *range(0x80, 0xA1), 0xAD])}


#: Where a text can be cut without parting a token: at a blank, after a letter before most signs, between a digit and another sign.
_CUT = re.compile(r"[ \t\n\r\f\v]|(?<=[A-Za-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[0-9])(?=[0-9A-Za-z])")


#: Signs of which a run is one pretoken; an apostrophe may belong to the letters after it.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Ids of words, as bytes; one that isn't there is learnt when it is asked for."""

    __slots__ = ("ends", "model", "old", "tokenizer")

    def __init__(self, tokenizer, old: dict[str, bytes]):
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model.tokenize, old
        self.ends = {c: self.encode(c) for c in ".,"}

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self._learn(word)
        if len(word) <= _KEPT:
            self[word] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        stem, end = word, b""
        if not word.isalpha():
            # Signs after letters are a token of their own, and case doesn't count.
            stem, end = word[:-1], self.ends.get(word[-1])
            if end is None or not stem.isalpha():
                stem = word.rstrip(_SIGNS)
                if len(stem) == len(word) or not stem.isalpha():
                    return self.encode(word)
                end = self[word[len(stem) :]]
        if stem.isascii():
            letters = stem = stem.lower()
        elif max(stem) <= "\xff":
            # Letters of Latin-1 have one form and one small letter; the model takes their bytes' signs.
            stem = stem.lower()
            letters = stem.encode().decode("latin-1").translate(_BYTE_SIGNS)
        else:
            return self.encode(word)
        if stem is not word and (known := self.get(stem) or self.old.get(stem)):
            return known + end
        # A word of small letters is one pretoken already: straight to the model.
        return array("I", [t.id for t in self.model(letters)]).tobytes() + end


class WordCache:
    """Ids of whole texts from the ids of their words, which the tokenizer treats one by one.

    The tokenizer splits at white space before all else, so a text's ids are
    those of its blank-separated words in a row. Words' ids are kept as bytes in
    two generations, the older of which is dropped when the younger is full. A
    word has at most _KEPT characters, longer ones are tokenised again each time,
    so a number of words bounds the bytes.
    """

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.young = _Words(self.tokenizer, {})

    def _one(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blank to Python, not to the tokenizer
            return self.young.encode(text)
        ids = b"".join(map(self.young.__getitem__, text.split()))
        if len(self.young) > self.limit:
            self.young.old = {}
            self.young = _Words(self.tokenizer, self.young)
        return ids

    def ids(self, text: str) -> bytes:
        """A text's ids as little-endian 32-bit numbers. About _BLOCK characters are in hand at once, whatever its length."""
        return self._one(text) if len(text) <= _BLOCK else b"".join(map(self._one, _parts(text)))


def _parts(text: str) -> Iterator[str]:
    """A long text in blocks that part no token. A run of letters alone, however long, is one token's matter and stays whole."""
    at = 0
    while len(text) - at > _BLOCK and (m := _CUT.search(text, at + _BLOCK)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(path: str) -> WordCache:
    if path not in _encoders:
        _encoders[path] = WordCache(path)
    return _encoders[path]


def release(path: str) -> None:
    """Let go of a tokenizer and its words, and give the memory back: a worker outlives its task, and may idle beside another stage's."""
    _encoders.pop(path, None)
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps freed memory and has this
    if trim:
        trim(0)


def document_ids(text: str | None, path: str, end_id: int = END_ID) -> np.ndarray:
    """Ids of a text and the end id."""
    return np.frombuffer(encoder(path).ids(text or "") + end_id.to_bytes(4, "little"), "<u4")


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``key, piece, start, length, ids_crc32``: every row's pieces; only longer documents are cut."""
    source = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            keys, piece, start, length, crc = [], [], [], [], []
            all_keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, cell in zip(all_keys, texts, strict=True):
                ids = cache.ids(cell.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    keys.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            cols = [pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "piece", "start", "length", "ids_crc32"])
        del cache
        release(path)

    return map_in_arrow(source, run, f"{key} long, piece int, start long, length long, ids_crc32 long")


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length (longest first) give the greatest sum within ``room``."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for x in lengths:
        if x > room:
            continue
        most, k = min(counts[x], room // x), 1
        while most > 0:
            k = min(k, most)
            more = (reach | reach << (k * x)) & mask
            if more != reach:
                steps.append((x, k, reach))
                reach = more
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for x, k, before in reversed(steps):
        if not before >> left & 1:
            used[x] = used.get(x, 0) + k
            left -= k * x
    return used


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), by minimum bin slack."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = _fullest(sorted((x for x, n in left.items() if n), reverse=True), left, capacity - seed)
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[x] // n for x, n in bin_.items())
        for x, n in bin_.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((bin_, times))
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    Lengths are positive; ``order`` names columns that tell pieces apart (equal
    rows may swap places). ``pieces`` is read several times: pass a checkpointed
    frame. No pieces give no sequences.
    """
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError("a piece's length is outside 1 to the capacity")
    #: first rank of a length's pieces in a pattern, packed with the length; and where they go
    keys, per_bin, first, at = [], [], [], []
    ranks: dict[int, int] = dict.fromkeys(counts, 0)
    base = 0
    for bin_, times in plan_bins(counts, capacity):
        offset = 0
        for x in sorted(bin_, reverse=True):
            keys.append((x << 44) + ranks[x])
            per_bin.append(bin_[x])
            first.append(base)
            at.append(offset)
            ranks[x] += bin_[x] * times
            offset += bin_[x] * x
        base += times
    by = np.argsort(np.array(keys, np.int64))
    keys_, per_bin_, first_, at_ = (np.array(v, np.int64)[by] for v in (keys, per_bin, first, at))
    ranked = gapless_rank(pieces, "length", order, "__rank")
    names = [c for c in ranked.columns if c != "__rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "__rank"))
            i = np.searchsorted(keys_, (length << 44) + rank, side="right") - 1
            local = rank - (keys_[i] & ((1 << 44) - 1)) if len(i) else rank
            copy, place = local // per_bin_[i], local % per_bin_[i]
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first_[i] + copy), pa.array(at_[i] + place * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "__rank") + ", sequence_id long, offset long"
    return map_in_arrow(ranked, run, schema)


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise all documents once, and pack their pieces; null texts count as empty."""
    return pack(checkpoint(token_pieces(docs, path, key, text, capacity)), [key, "piece", "ids_crc32"], capacity)


def fill_sequences(docs: DataFrame, packed: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``sequence_id, offset, ids``: the packed pieces' ids (keys must be unique), ready to be written sorted by both."""
    own = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).join(
        packed.groupBy(key).agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("parts")), key
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = document_ids(text_, path)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in parts]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["sequence_id", "offset", "ids"])

    return map_in_arrow(own.select("text", "parts"), run, "sequence_id long, offset long, ids array<int>")
