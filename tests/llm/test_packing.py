"""Ids against the tokenizer, bins against exhaustive search, and places of pieces."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strandmill.llm import packing
from strandmill.llm.queries import word_tokenizer

PATH = word_tokenizer()
ODD = [None, "", " \n", "a\x1cb c", "Hello <|endoftext|> x’s I'm  é é É ÀÉ µ ª ß ẞ", "don't stop　now ÿ Ÿ İ Σας naïve,. x.y. 123 4,5", "THE the The, the. ,. ...", "emoji 😀 text"]


def reference(text):
    cache = packing.encoder(PATH)
    return [*cache.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ODD)
def test_ids_are_the_tokenizers(text):
    assert packing.document_ids(text, PATH).tolist() == reference(text)


def test_small_cache_gives_the_same_ids():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcéü.,'") for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(30)]
    cache = packing.WordCache(PATH, 5)
    for t in texts:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == reference(t)[:-1]


def test_words_with_signs_give_the_tokenizers_ids():
    rng = random.Random(11)
    cache = packing.WordCache(PATH, 200)
    for _ in range(400):
        t = " ".join("".join(rng.choice(["ab", "É", "x", "'", "s", "...", "&", "%", "!", "-", "_", "3", "é", "ü", "<|", "|>", "’", ","]) for _ in range(rng.randrange(1, 6))) for _ in range(20))
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == reference(t)[:-1]


def test_long_texts_are_cut_between_tokens(monkeypatch):
    """Blocks of 50 characters: at blanks, and in runs without any."""
    monkeypatch.setattr(packing, "_BLOCK", 50)
    rng = random.Random(8)
    texts = ["".join(rng.choice(signs) for _ in range(600)) for signs in ("abc d", "aB9-_/=", "a1b'sé.,", "0123456789ab", "abcdefgh", "é ñ😀x.'t") for _ in range(20)]
    cache = packing.WordCache(PATH)
    for t in texts:
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == reference(t)[:-1]
    assert max(map(len, cache.young)) <= packing._KEPT


def test_fullest_by_exhaustion():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(60)
        got = packing._fullest(sorted(counts, reverse=True), counts, room)
        best = max(s for n in itertools.product(*(range(c + 1) for c in counts.values())) if (s := sum(a * b for a, b in zip(n, counts, strict=True))) <= room)
        assert sum(k * v for k, v in got.items()) == best
        assert all(v <= counts[k] for k, v in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    counts = Counter(min(4096, int(rng.expovariate(1 / 700)) + 1) for _ in range(20_000))
    bins = packing.plan_bins(counts)
    used = Counter()
    for b, times in bins:
        assert sum(k * v for k, v in b.items()) <= 4096
        for k, v in b.items():
            used[k] += v * times
    total = sum(k * v for k, v in counts.items())
    assert used == counts and len(bins) <= 4096
    assert sum(t for _, t in bins) <= 1.002 * -(-total // 4096) + 1
    assert packing.plan_bins({}) == [] and packing.plan_bins({10: 10**12}, 100) == [({10: 10}, 10**11)]


def test_pack_documents(spark):
    rng = random.Random(7)
    texts = [*ODD, *(" ".join(rng.choice(["one", "Two,", "three.", "vier"]) for _ in range(rng.randrange(1, 90))) for _ in range(150)), "long word " * 9000, "same", "same"]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(df, PATH).collect()
    docs = Counter()
    for r in out:
        ids = reference(dict((k, t) for k, t, _ in rows)[r["doc_id"]])
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        docs[r["doc_id"]] += r["length"]
    assert sum(docs.values()) == sum(len(reference(t)) for _, t, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(docs.values()) // 4096) + 1
    one = df.dropDuplicates(["doc_id"])
    filled = packing.fill_sequences(one, packing.pack_documents(one, PATH), PATH).collect()
    assert sum(len(r["ids"]) for r in filled) == sum(len(reference(r["text"])) for r in one.where("doc_id is not null").collect())
    assert packing.pack_documents(df.limit(0), PATH).collect() == []
