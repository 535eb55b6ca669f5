"""Counts and summaries of reads; each is one partial and final aggregation."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import vectorised
from .records import MULTI_MATCH, NO_MATCH, _patterns, mates, slice_reads

_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def count_barcodes(df: DataFrame, barcodes: list[str], max_distance: int = 1, allow_revcomp: bool = False) -> DataFrame:
    """``barcode, count``: one count a record, for the only barcode found anywhere in any mate, else MULTI_MATCH or NO_MATCH.

    Only what occurs has a row. A barcode found twice, or listed twice, is one.
    """
    own = list(dict.fromkeys(_patterns(barcodes, "barcodes")))
    forms = {b: list(dict.fromkeys((b, b[::-1].translate(_COMPLEMENT)) if allow_revcomp else (b,))) for b in own}
    seqs = [F.col(m)["seq"] for m in mates(df)]
    if max_distance <= 0:
        found = [functools.reduce(operator.or_, (R.matches_within(f, s, 0) for s in seqs for f in forms[b])) for b in own]
        hits = F.filter(F.array(*(F.when(hit, F.lit(b)) for b, hit in zip(own, found, strict=True))), lambda b: b.isNotNull())
    else:
        # Interpreted lambdas over every window would take a hundred times as long.
        hits = vectorised.patterns_within(seqs, forms, max_distance)
    t = df.select(hits.alias("hits"))
    label = F.when(F.size("hits") == 0, NO_MATCH).when(F.size("hits") > 1, MULTI_MATCH).otherwise(F.get("hits", F.lit(0)))
    return t.groupBy(label.alias("barcode")).agg(F.count(F.lit(1)).alias("count"))


def _upper(seq: Column) -> Column:
    """a-z in upper case and nothing else, so that the length stays."""
    return F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def admitted(df: DataFrame, mate: str, phred33: bool = True) -> DataFrame:
    """``seq`` in upper case and ``qual`` of the mate's reads that a summary counts: not empty, and of one length."""
    return df.select(_upper(F.col(mate)["seq"]).alias("seq"), F.col(mate)["qual"].alias("qual")).where("length(seq) > 0 and length(seq) = length(qual)")


def basic_stats(seqs: DataFrame) -> DataFrame:
    n, gc = F.length("seq"), F.length("seq") - F.length(F.translate("seq", "GC", ""))
    return seqs.agg(
        F.count(F.lit(1)).alias("total_sequences"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_bases"), F.coalesce(F.min(n), F.lit(0)).cast("long").alias("seq_len_min"),
        F.avg(n).alias("seq_len_mean"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("seq_len_max"), (F.lit(100.0) * F.sum(gc) / F.sum(n)).alias("gc_percent"),
    )


def per_base_quality(seqs: DataFrame, offset: int = 33) -> DataFrame:
    q = seqs.select(F.posexplode(R.phred("qual", offset)).alias("p", "q"))
    return q.groupBy((F.col("p") + 1).alias("position")).agg(F.avg("q").alias("mean_q"), F.count(F.lit(1)).alias("n"))


def per_base_content(seqs: DataFrame) -> DataFrame:
    b = seqs.select(F.posexplode(F.split("seq", "")).alias("p", "base")).groupBy((F.col("p") + 1).alias("position"), "base").agg(F.count(F.lit(1)).alias("count"))
    return with_fraction(b)


def with_fraction(counts: DataFrame) -> DataFrame:
    """Add each base's share of its position, which has at most as many rows as there are characters."""
    return counts.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy("position")))


def length_distribution(seqs: DataFrame) -> DataFrame:
    return seqs.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("count"))


def avg_read_quality(seqs: DataFrame, offset: int = 33) -> DataFrame:
    return seqs.groupBy(F.round(R.mean_quality("qual", offset)).cast("int").alias("avg_quality")).agg(F.count(F.lit(1)).alias("count"))


def insert_sizes(df: DataFrame, min_overlap: int = 12, max_mismatch_rate: float = 0.10) -> DataFrame:
    """``insert_size, count`` of pairs that overlap; N is a base like others here."""
    if min_overlap < 1:
        raise ValueError("min_overlap must be >= 1")
    a, b = F.col("read1.seq"), F.col("read2.seq")
    pairs = df.where((F.length(a) > 0) & (F.length(b) > 0)).select(_upper(a).alias("a"), R.reverse_complement(_upper(b)).alias("b"))
    found = pairs.select((F.length("a") + F.length("b")).alias("n"), vectorised.overlap("a", "b", min_overlap, max_mismatch_rate, False).alias("overlap"))
    return found.where("overlap > 0").groupBy((F.col("n") - F.col("overlap")).cast("int").alias("insert_size")).agg(F.count(F.lit(1)).alias("count"))


def summary(df: DataFrame, phred33: bool = True, min_overlap: int = 12, max_mismatch_rate: float = 0.10, limit: int = 0) -> dict[str, DataFrame]:
    """Lazy tables by name, ``_R1`` and ``_R2`` for the mates; ``insert_size`` for pairs only. ``limit`` 0 means all.

    Each scans the reads for itself: for one or two of them. ``profile.summary`` makes all in one scan.
    """
    own = mates(df)
    if len(own) not in (1, 2):
        raise ValueError("summary takes one or two inputs")
    df = slice_reads(df, limit=limit) if limit else df
    offset = 33 if phred33 else 64
    out = {}
    for i, m in enumerate(own, 1):
        seqs = admitted(df, m)
        out |= {
            f"basic_stats_R{i}": basic_stats(seqs), f"per_base_quality_R{i}": per_base_quality(seqs, offset), f"per_base_content_R{i}": per_base_content(seqs),
            f"length_distribution_R{i}": length_distribution(seqs), f"avg_read_quality_R{i}": avg_read_quality(seqs, offset),
        }
    return out | ({"insert_size": insert_sizes(df, min_overlap, max_mismatch_rate)} if len(own) == 2 else {})
