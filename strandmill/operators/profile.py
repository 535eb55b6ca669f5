"""All tables of a summary from one pass over the reads.

Each Arrow batch becomes a histogram with numpy; one aggregation adds the
histograms up. What is left has a few rows a position, so the tables of a summary
are small queries over it. Sums are integers: the tables equal those of
``aggregates`` for each table alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import vectorised
from .aggregates import _upper, with_fraction
from .records import mates, slice_reads

QUALITY, CONTENT, LENGTH, MEAN, GC, INSERT = "quality", "content", "length", "mean", "gc", "insert"
SCHEMA = "mate int, kind string, x long, base string, n long, total long"
_GC = np.array([ord("G"), ord("C")], np.uint32)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, none negative, and how often each occurs; a table of all values only where that isn't far longer than the input."""
    if len(values) and int(values.max()) <= 8 * len(values):
        n = np.bincount(values)
        at = np.flatnonzero(n)
        return at, n[at]
    return np.unique(values, return_counts=True)


def _of_mate(seqs: list[str], quals: list[str], offset: int) -> Iterator[tuple[str, np.ndarray, list[str] | None, np.ndarray, np.ndarray | None]]:
    """(kind, x, base, n, total) of the reads that a summary counts."""
    own = [(s, q) for s, q in zip(seqs, quals, strict=True) if s and q and len(s) == len(q)]
    if not own:
        return
    lengths = np.fromiter((len(s) for s, _ in own), np.int64, len(own))
    starts = np.cumsum(lengths) - lengths
    bases, q = _codes([s for s, _ in own]), _codes([x for _, x in own]).astype(np.int64)
    q = np.maximum(q - offset, 0)
    place = np.arange(len(bases), dtype=np.int64) - np.repeat(starts, lengths)
    n = np.bincount(place)
    yield QUALITY, np.arange(1, len(n) + 1), None, n, np.bincount(place, weights=q).astype(np.int64)
    letters, code = np.unique(bases, return_inverse=True)
    key, n = _counted(place * len(letters) + code)
    yield CONTENT, key // len(letters) + 1, [chr(letters[c]) for c in key % len(letters)], n, None
    yield LENGTH, *_split(lengths)
    # Halves are rounded up, as by Spark's round.
    yield MEAN, *_split((2 * np.add.reduceat(q, starts) + lengths) // (2 * lengths))
    yield GC, np.zeros(1, np.int64), None, np.array([np.isin(bases, _GC).sum()]), None


def _split(values: np.ndarray) -> tuple[np.ndarray, None, np.ndarray, None]:
    x, n = _counted(values)
    return x, None, n, None


def profile(df: DataFrame, phred33: bool = True, min_overlap: int = 12, max_mismatch_rate: float = 0.10) -> DataFrame:
    """``mate, kind, x, base, n, total``: counts by kind and value of one or two mates, in one scan.

    ``quality``: x a position from 1, total the sum of its qualities; ``content``: a base at
    a position; ``length``; ``mean``: rounded mean quality of a read; ``gc``: its bases in n;
    ``insert`` (mate 0): insert sizes of pairs that overlap. Null and empty reads, and those whose
    quality has another length, count for insert sizes alone, empty ones for nothing.
    """
    if min_overlap < 1:
        raise ValueError("min_overlap must be >= 1")
    own, offset = mates(df), 33 if phred33 else 64
    paired = len(own) == 2
    cols = [c for i, m in enumerate(own) for c in (_upper(F.col(m)["seq"]).alias(f"s{i}"), F.col(m)["qual"].alias(f"q{i}"))]
    if paired:
        cols.append(R.reverse_complement(_upper(F.col(own[1])["seq"])).alias("back"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [c.to_pylist() for c in batch.columns]
            found = [(i + 1, *t) for i in range(len(own)) for t in _of_mate(texts[2 * i], texts[2 * i + 1], offset)]
            if paired:
                both = [(a.encode("latin-1"), b.encode("latin-1")) for a, b in zip(texts[0], texts[-1], strict=True) if a and b]
                over, _ = vectorised.longest_overlaps([a for a, _ in both], [b for _, b in both], min_overlap, max_mismatch_rate, False)
                sizes = np.fromiter((len(a) + len(b) for a, b in both), np.int64, len(both)) - over
                found.append((0, INSERT, *_split(sizes[over > 0])))
            for mate, kind, x, base, n, total in found:
                rows = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([mate] * rows, pa.int32()), pa.array([kind] * rows, pa.string()), pa.array(x, pa.int64()), pa.nulls(rows, pa.string()) if base is None else pa.array(base, pa.string()),
                        pa.array(n, pa.int64()), pa.array(np.zeros(rows, np.int64) if total is None else total, pa.int64()),
                    ],
                    names=["mate", "kind", "x", "base", "n", "total"],
                )

    counts = df.select(*cols).mapInArrow(run, SCHEMA)
    return counts.groupBy("mate", "kind", "x", "base").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def tables(counts: DataFrame, n_mates: int) -> dict[str, DataFrame]:
    """The tables of ``aggregates.summary`` from a profile, which each of them reads: pass one that is kept."""
    x, n = F.col("x"), F.col("n")
    out = {}
    for i in range(1, n_mates + 1):
        of = lambda kind: counts.where((F.col("mate") == i) & (F.col("kind") == kind))  # noqa: B023, E731
        length = F.col("kind") == LENGTH
        reads, bases = F.coalesce(F.sum(F.when(length, n)), F.lit(0)), F.coalesce(F.sum(F.when(length, x * n)), F.lit(0))
        out |= {
            f"basic_stats_R{i}": counts.where((F.col("mate") == i) & F.col("kind").isin(LENGTH, GC)).agg(
                reads.alias("total_sequences"), bases.alias("total_bases"), F.coalesce(F.min(F.when(length, x)), F.lit(0)).alias("seq_len_min"),
                F.try_divide(bases, reads).alias("seq_len_mean"), F.coalesce(F.max(F.when(length, x)), F.lit(0)).alias("seq_len_max"),
                F.try_divide(F.lit(100.0) * F.sum(F.when(~length, n)), bases).alias("gc_percent"),
            ),
            f"per_base_quality_R{i}": of(QUALITY).select(x.cast("int").alias("position"), (F.col("total") / n).alias("mean_q"), "n"),
            f"per_base_content_R{i}": with_fraction(of(CONTENT).select(x.cast("int").alias("position"), "base", n.alias("count"))),
            f"length_distribution_R{i}": of(LENGTH).select(x.cast("int").alias("length"), n.alias("count")),
            f"avg_read_quality_R{i}": of(MEAN).select(x.cast("int").alias("avg_quality"), n.alias("count")),
        }
    return out | ({"insert_size": counts.where(F.col("kind") == INSERT).select(x.cast("int").alias("insert_size"), n.alias("count"))} if n_mates == 2 else {})


def summary(df: DataFrame, phred33: bool = True, min_overlap: int = 12, max_mismatch_rate: float = 0.10, limit: int = 0) -> dict[str, DataFrame]:
    """The tables of ``aggregates.summary``, all from one scan, which is made now; its counts are kept by the session."""
    own = mates(df)
    if len(own) not in (1, 2):
        raise ValueError("summary takes one or two inputs")
    counts = profile(slice_reads(df, limit=limit) if limit else df, phred33, min_overlap, max_mismatch_rate).persist()
    counts.count()
    return tables(counts, len(own))
