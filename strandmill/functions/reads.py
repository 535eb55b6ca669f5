"""Column builders on sequences and qualities; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NO_MATCH_DISTANCE

READ = "struct<name:string,seq:string,qual:string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Reversed, A with T and C with G exchanged in either case; other characters stay."""
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


def trim_read(read: Column | str, start: int | Column, end: int | Column) -> Column:
    """Bases and qualities from ``start`` to before ``end``; an error if the span doesn't lie in the read."""
    read, start, end = _col(read), F.lit(start) if isinstance(start, int) else start, F.lit(end) if isinstance(end, int) else end
    seq, qual = read["seq"], read["qual"]
    bad = (end > F.length(seq)) | (start > end) | (start < 0)
    cut = lambda c: F.substring(c, start + 1, end - start)
    return F.when(bad, F.raise_error(F.lit("trim is outside the read")).cast(READ)).otherwise(F.struct(read["name"].alias("name"), cut(seq).alias("seq"), cut(qual).alias("qual")))


def zip_pairs(a: Column | str, b: Column | str) -> Column:
    """Pairs of two arrays up to the end of the shorter."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def ends_with(text: Column | str, suffix: str) -> Column:
    return F.endswith(_col(text), F.lit(suffix))


def same_length(read: Column | str) -> Column:
    read = _col(read)
    return F.length(read["seq"]) == F.length(read["qual"])


def checked(read: Column | str) -> Column:
    """The read, or an error if sequence and quality differ in length."""
    read = _col(read)
    return F.when(same_length(read), read).otherwise(F.raise_error(F.lit("read sequence and quality lengths differ")).cast(READ))


def phred(qual: Column | str, offset: int = 33) -> Column:
    """Array of qualities, none below 0; empty for an empty string."""
    qual = _col(qual)
    return F.when(F.length(qual) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(qual, ""), lambda c: F.greatest(F.ascii(c) - offset, F.lit(0))))


def quality_sum(qual: Column | str, offset: int = 33) -> Column:
    return F.aggregate(phred(qual, offset), F.lit(0), lambda acc, q: acc + q)


def mean_quality(qual: Column | str, offset: int = 33) -> Column:
    """Mean quality; null for an empty string."""
    qual = _col(qual)
    return F.when(F.length(qual) > 0, quality_sum(qual, offset) / F.length(qual))


def low_quality_bases(qual: Column | str, threshold: int, offset: int = 33) -> Column:
    """How many bases have a quality below ``threshold``."""
    qual = _col(qual)
    low = "".join(map(chr, range(max(threshold, 0) + offset)))
    return F.lit(0) if threshold <= 0 else F.length(qual) - F.length(F.translate(qual, low, ""))


def passes_quality(read: Column | str, min_mean: float, max_low: int, low_threshold: int) -> Column:
    read = _col(read)
    qual = read["qual"]
    return (F.length(qual) > 0) & (low_quality_bases(qual, low_threshold) <= max_low) & (F.coalesce(mean_quality(qual), F.lit(-1.0)) >= F.lit(float(min_mean)))


def in_downsample(index: Column | str, amount: float) -> Column:
    """Whether the running total of ``amount`` reaches a new whole number at this record."""
    if not 0 <= amount <= 1:
        raise ValueError("amount must between 0 and 1")
    index, a = _col(index), F.lit(float(amount))
    return F.floor(a * (index + 1)) > F.floor(a * index)


def _differs(a: Column, b: Column, ambiguity: str) -> Column:
    if not ambiguity:
        return (a != b).cast("int")
    free = F.lit(ambiguity[0])
    return ((a != b) & (a != free) & (b != free)).cast("int")


def mismatches_with(pattern: str, text: Column | str, at: int | Column = 0, ambiguity: str = "") -> Column:
    """Mismatches of a literal with the text from ``at``; the text must reach far enough."""
    text = _col(text)
    base = F.lit(at) if isinstance(at, int) else at
    out = F.lit(0)
    for i, c in enumerate(pattern):
        out = out + _differs(F.lit(c), F.substring(text, base + (i + 1), F.lit(1)), ambiguity)
    return out


def matches_prefix(pattern: str, text: Column | str, max_distance: int) -> Column:
    """Whether the text starts with the literal, with at most so many mismatches."""
    text = _col(text)
    if max_distance <= 0:
        return F.startswith(text, F.lit(pattern))
    return (F.length(text) >= len(pattern)) & (mismatches_with(pattern, text) <= max_distance)


def matches_within(pattern: str, text: Column | str, max_distance: int) -> Column:
    """Whether the literal occurs anywhere in the text, with at most so many mismatches."""
    text = _col(text)
    if max_distance <= 0:
        return F.contains(text, F.lit(pattern))
    places = F.sequence(F.lit(0), F.length(text) - len(pattern))
    return F.when(F.length(text) >= len(pattern), F.exists(places, lambda i: mismatches_with(pattern, text, i) <= max_distance)).otherwise(F.lit(False))


def align_result(start: Column, end: Column, distance: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), distance.cast("int").alias("distance"))


def _none() -> Column:
    return align_result(F.lit(0), F.lit(0), F.lit(NO_MATCH_DISTANCE))


def _mismatches(query: Column, target: Column, at: Column, ambiguity: str) -> Column:
    places = F.sequence(F.lit(1), F.length(query))
    return F.aggregate(places, F.lit(0), lambda n, i: n + _differs(F.substring(query, i, F.lit(1)), F.substring(target, at + i, F.lit(1)), ambiguity))


def hamming_starts(query: Column | str, target: Column | str, max_distance: int = NO_MATCH_DISTANCE, ambiguity: str = "") -> Column:
    """Struct of start, end (inclusive) and distance of the query against the target's start."""
    q, t = _col(query), _col(target)
    d = _mismatches(q, t, F.lit(0), ambiguity)
    return F.when(F.length(q) > F.length(t), _none()).when(F.length(q) == 0, align_result(F.lit(0), F.lit(0), F.lit(0))).when(d <= max_distance, align_result(F.lit(0), F.length(q) - 1, d)).otherwise(_none())


def hamming_global(query: Column | str, target: Column | str, max_distance: int = NO_MATCH_DISTANCE, ambiguity: str = "") -> Column:
    q, t = _col(query), _col(target)
    return F.when(F.length(q) != F.length(t), _none()).otherwise(hamming_starts(q, t, max_distance, ambiguity))


def hamming_contains(query: Column | str, target: Column | str, max_distance: int = NO_MATCH_DISTANCE, ambiguity: str = "") -> Column:
    """The best window of the target, the leftmost of equals."""
    q, t = _col(query), _col(target)
    windows = F.transform(F.sequence(F.lit(0), F.length(t) - F.length(q)), lambda i: F.struct(_mismatches(q, t, i, ambiguity).alias("d"), i.alias("i")))
    best = F.array_min(windows)
    fits = F.when(best["d"] <= max_distance, align_result(best["i"], best["i"] + F.length(q) - 1, best["d"])).otherwise(_none())
    return F.when(F.length(q) > F.length(t), _none()).when(F.length(q) == 0, align_result(F.lit(0), F.lit(0), F.lit(0))).otherwise(fits)


def levenshtein_global(query: Column | str, target: Column | str, max_distance: int = NO_MATCH_DISTANCE) -> Column:
    """The edit distance of the whole strings, by the built-in function; an empty target matches nothing, and a null counts as empty."""
    q, t = (F.coalesce(_col(c), F.lit("")) for c in (query, target))
    d = F.levenshtein(q, t)
    return F.when((F.length(t) > 0) & (d <= max_distance), align_result(F.lit(0), F.length(t) - 1, d)).otherwise(_none())


def overlap_native(seq1: Column | str, seq2: Column | str, min_overlap: int, max_rate: float, n_mismatches: bool) -> Column:
    """Longest L for which the last L bases of one agree with the first L of the other, else 0.

    Interpreted and quadratic: the vectorised form is for production, this one checks it.
    """
    a, b = _col(seq1), _col(seq2)
    least = F.least(F.length(a), F.length(b))

    def bad(x: Column, y: Column) -> Column:
        differs = x != y
        return (differs | x.isin("N", "n") | y.isin("N", "n")).cast("int") if n_mismatches else differs.cast("int")

    def count(n: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + bad(F.substring(a, F.length(a) - n + i, F.lit(1)), F.substring(b, i, F.lit(1))))

    found = F.filter(F.sequence(least, F.lit(min_overlap), F.lit(-1)), lambda n: count(n) <= F.ceil(F.lit(float(max_rate)) * n))
    return F.when(least >= min_overlap, F.coalesce(F.get(found, F.lit(0)), F.lit(0))).otherwise(F.lit(0))
