"""Functions that SQL can't express well: overlap merging and edit-distance alignment, over Arrow batches."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NO_MATCH_DISTANCE

CONSENSUS = ("max", "mean", "r1", "r2")
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
_N = np.frombuffer(b"Nn", np.uint8)


def _rows(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), width)


def longest_overlaps(first: list[bytes], second: list[bytes], min_overlap: int, max_rate: float, n_mismatches: bool) -> tuple[np.ndarray, np.ndarray]:
    """(overlap, mismatches) of each pair: the longest L, down to ``min_overlap``, whose
    mismatches are at most ceil(rate * L); 0 if there is none. Pairs of equal lengths are
    compared together, one L at a time, until all have theirs."""
    overlap, wrong = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    by_size: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (a, b) in enumerate(zip(first, second, strict=True)):
        by_size[len(a), len(b)].append(i)
    for (la, lb), own in by_size.items():
        if min(la, lb) < min_overlap:
            continue
        at = np.array(own)
        a, b = _rows([first[i] for i in own], la), _rows([second[i] for i in own], lb)
        na, nb = (np.isin(a, _N), np.isin(b, _N)) if n_mismatches else (None, None)
        for n in range(min(la, lb), max(min_overlap, 1) - 1, -1):
            bad = a[:, la - n :] != b[:, :n]
            if n_mismatches:
                bad = bad | na[:, la - n :] | nb[:, :n]
            count = bad.sum(1)
            ok = count <= np.ceil(max_rate * n)
            if ok.any():
                overlap[at[ok]], wrong[at[ok]] = n, count[ok]
                if ok.all():
                    break
                rest = ~ok
                at, a, b = at[rest], a[rest], b[rest]
                if n_mismatches:
                    na, nb = na[rest], nb[rest]
    return overlap, wrong


def consensus(s1: bytes, q1: bytes, s2: bytes, q2: bytes, n: int, mode: str, overhang: bool) -> tuple[bytes, bytes]:
    """Sequence and quality of a merged pair whose last and first ``n`` bases overlap."""
    a, qa = np.frombuffer(s1, np.uint8)[len(s1) - n :], np.frombuffer(q1, np.uint8)[len(s1) - n :]
    b, qb = np.frombuffer(s2, np.uint8)[:n], np.frombuffer(q2, np.uint8)[:n]
    if mode == "r1":
        seq, qual = a, qa
    elif mode == "r2":
        seq, qual = b, qb
    else:
        second = qb > qa
        seq = np.where(second, b, a)
        qual = np.where(second, qb, qa) if mode == "max" else ((qa.astype(np.int64) + qb + 1) // 2).astype(np.uint8)
    head, tail = (slice(0, len(s1) - n), slice(n, None)) if overhang else (slice(0, 0), slice(len(s2), None))
    return s1[head] + seq.tobytes() + s2[tail], q1[head] + qual.tobytes() + q2[tail]


def _latin(c: pd.Series) -> list[bytes]:
    """Bytes of each text; a null is an empty one."""
    return [b"" if x is None else x.encode("latin-1") for x in c]


def _within(texts: list[bytes], pattern: bytes, max_distance: int) -> np.ndarray:
    """Whether the pattern occurs anywhere in each text, with at most so many mismatches."""
    out = np.zeros(len(texts), bool)
    by_size: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        by_size[len(t)].append(i)
    p = np.frombuffer(pattern, np.uint8)
    for size, own in by_size.items():
        if size < len(p):
            continue
        a = _rows([texts[i] for i in own], size)
        wrong = np.zeros((len(own), size - len(p) + 1), np.int32)
        for k, c in enumerate(p):
            wrong += a[:, k : k + wrong.shape[1]] != c
        out[own] = (wrong <= max_distance).any(1)
    return out


def patterns_within(seqs: list[Column], forms: dict[str, list[str]], max_distance: int) -> Column:
    """Array of the names in ``forms`` of which a form occurs anywhere in any of the sequences, in their order."""
    coded = {name: [f.encode("latin-1") for f in own] for name, own in forms.items()}

    @F.pandas_udf("array<string>")
    def run(*columns: pd.Series) -> pd.Series:
        texts = [_latin(c) for c in columns]
        hits = [np.logical_or.reduce([_within(t, f, max_distance) for t in texts for f in own]) for own in coded.values()]
        found = [[] for _ in range(len(columns[0]))]
        for name, hit in zip(coded, hits, strict=True):
            for i in np.flatnonzero(hit):
                found[i].append(name)
        return pd.Series(found)

    return run(*seqs)


def merge(read1: Column | str, read2: Column | str, min_overlap: int, max_rate: float, mode: str, overhang: bool, revcomp: bool) -> Column:
    """Struct of overlap, mismatches, insert, seq, qual; seq and qual are null without an overlap.

    An error if a read's sequence and quality differ in length.
    """

    @F.pandas_udf("overlap int, mismatches int, insert_size int, seq string, qual string")
    def run(r1: pd.DataFrame, r2: pd.DataFrame) -> pd.DataFrame:
        s1, q1, s2, q2 = _latin(r1["seq"]), _latin(r1["qual"]), _latin(r2["seq"]), _latin(r2["qual"])
        if any(len(s) != len(q) for s, q in (*zip(s1, q1, strict=True), *zip(s2, q2, strict=True))):
            raise ValueError("read sequence and quality lengths differ")
        if revcomp:
            s2, q2 = [s[::-1].translate(_COMPLEMENT) for s in s2], [q[::-1] for q in q2]
        n, wrong = longest_overlaps(s1, s2, min_overlap, max_rate, True)
        seq: list[str | None] = [None] * len(n)
        qual: list[str | None] = [None] * len(n)
        for i in np.flatnonzero(n):
            s, q = consensus(s1[i], q1[i], s2[i], q2[i], int(n[i]), mode, overhang)
            seq[i], qual[i] = s.decode("latin-1"), q.decode("latin-1")
        insert = np.array([len(a) + len(b) for a, b in zip(s1, s2, strict=True)], np.int64) - n
        return pd.DataFrame({"overlap": n.astype(np.int32), "mismatches": wrong.astype(np.int32), "insert_size": insert.astype(np.int32), "seq": seq, "qual": qual})

    return run(read1, read2)


def overlap(seq1: Column | str, seq2: Column | str, min_overlap: int, max_rate: float, n_mismatches: bool) -> Column:
    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(longest_overlaps(_latin(a), _latin(b), min_overlap, max_rate, n_mismatches)[0].astype(np.int32))

    return run(seq1, seq2)


def _equal_masks(query: str, ambiguity: str) -> tuple[dict[str, int], int, int]:
    masks: dict[str, int] = defaultdict(int)
    free = 0
    for i, c in enumerate(query):
        masks[c] |= 1 << i
        if ambiguity and c == ambiguity:
            free |= 1 << i
    every = (1 << len(query)) - 1
    if free:
        for c in masks:
            masks[c] |= free
    if ambiguity:
        masks[ambiguity] = every
    return masks, free, every


def _bottom_row(query: str, target: str, ambiguity: str, anywhere: bool) -> list[int]:
    """Distances of the whole query from target[.., j], by Myers' bit vectors; ``anywhere`` lets a match start at any place."""
    masks, free, every = _equal_masks(query, ambiguity)
    last = 1 << (len(query) - 1)
    plus, minus, d, out = every, 0, len(query), []
    for c in target:
        eq = masks.get(c, free)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & every
        mh = plus & xh
        d += bool(ph & last) - bool(mh & last)
        ph = (ph << 1) & every if anywhere else (ph << 1 | 1) & every
        mh = (mh << 1) & every
        plus = (mh | ~(xv | ph)) & every
        minus = ph & xv
        out.append(d)
    return out


def edit_align(query: str, target: str, max_distance: int, ambiguity: str, boundary: str) -> tuple[int, int, int]:
    """(start, end, distance), ends inclusive. The smallest end of the best; infix matches start where the span is longest.

    An empty string matches nothing, but globally an empty query is as far from a target as that is long.
    """
    none = (0, 0, NO_MATCH_DISTANCE)
    if not target or (not query and boundary != "global"):
        return none
    if not query:
        return (0, len(target) - 1, len(target)) if len(target) <= max_distance else none
    row = _bottom_row(query, target, ambiguity, boundary == "contains")
    d = row[-1] if boundary == "global" else min(row)
    if d > max_distance:
        return none
    end = len(target) - 1 if boundary == "global" else row.index(d)
    if boundary != "contains":
        return 0, end, d
    back = _bottom_row(query[::-1], target[end::-1], ambiguity, False)
    longest = len(back) - 1 - back[::-1].index(d) if d in back else 0
    return end - longest, end, d


def edit_distance(query: Column | str, target: Column | str, max_distance: int, ambiguity: str, boundary: str) -> Column:
    @F.pandas_udf("start int, end int, distance int")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = [edit_align(a or "", b or "", max_distance, ambiguity, boundary) for a, b in zip(q, t, strict=True)]
        return pd.DataFrame(found, columns=["start", "end", "distance"]).astype("int32")

    return run(query, target)
