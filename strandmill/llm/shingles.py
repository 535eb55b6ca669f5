"""Word shingles as sorted arrays of 64-bit hashes, by numpy over a text's bytes."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _K = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)


#: An odd factor and a mask for each hash function of the bands; more are made as they are asked for.
_FUNCTIONS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_POW, _INVERSE = _powers(_P, 4096), _powers(_INV, 4096)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INVERSE
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INVERSE = _powers(_P, size), _powers(_INV, size)
    return _POW, _INVERSE


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def _block_words(raw: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(((True,), _BLANK[raw], (True,)))))
    if not len(edge):
        return np.zeros(0, np.uint64)
    start, end = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw) + 1)
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=upto[1:])
    return _mix((upto[end] - upto[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words (runs without blanks, A-Z lower-cased), in order. Long texts are read in blocks that end at blanks."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    if len(data) <= _BLOCK:
        return _block_words(np.frombuffer(data, np.uint8))
    raw, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(raw):
        end = min(at + _BLOCK, len(raw))
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        parts.append(_block_words(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words, one for the whole sequence; of none, no hash."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(n, len(words))
    out = words[: len(words) - width + 1]
    for i in range(1, width):
        out = _mix(out * _K + words[i : len(words) - width + 1 + i])
    return np.unique(out if width == n else _mix(out + np.uint64(width)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _FUNCTIONS:
        rng = np.random.default_rng(20240301)
        odd, mask = (rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None] for _ in range(2))
        _FUNCTIONS[n] = odd | np.uint32(1), mask
    return _FUNCTIONS[n]


def band_keys(shingles: np.ndarray, bands: int, values: int) -> np.ndarray:
    """A hash for each band: of the least values that ``values`` hash functions take over the set, which is not empty."""
    odd, mask = _functions(bands * values)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * values, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 1024):
        block = high[None, at : at + 1024] ^ mask
        block *= odd
        np.minimum(least, block.min(1), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, values).T:
        out = _mix(out * _K + column)
    return out
