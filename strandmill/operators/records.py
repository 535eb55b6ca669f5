"""Filters, routers and joins of records. ``mates`` are the columns read1, read2, ..."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reads as R
from ..functions import vectorised

NO_MATCH, MULTI_MATCH, NO_ADAPTER = "NO_MATCH", "MULTI_MATCH", "NO_ADAPTER"
#: Selections longer than this are joined instead of listed in the filter.
LISTED = 1000
SUFFIXES = {"fastq": ".fastq", "gz": ".fastq.gz", "zst": ".fastq.zst", "mem": ".mem"}


def mates(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("read") and c[4:].isdigit()), key=lambda c: int(c[4:]))


def _patterns(values: list[str], what: str) -> list[str]:
    values = list(values)
    if not values or not all(isinstance(v, str) and v for v in values):
        raise ValueError(f"{what} must be non-empty strings")
    return values


def downsample(df: DataFrame, amount: float) -> DataFrame:
    """Keep that share of the records, spread evenly; the same ones each time."""
    return df.where(R.in_downsample("read_index", amount))


def slice_reads(df: DataFrame, limit: int | None = None, select: list[int] | None = None) -> DataFrame:
    """The first ``limit`` records, or those whose index is selected, in input order."""
    if (limit is None) == (select is None):
        raise ValueError("give one of limit and select")
    if limit is not None:
        if limit < 0 or limit != int(limit):
            raise ValueError("limit must be a whole number of at least 0")
        return df.where(F.col("read_index") < int(limit))
    wanted = sorted({int(i) for i in select if i >= 0})
    if len(wanted) <= LISTED:
        return df.where(F.col("read_index").isin(wanted))
    own = df.sparkSession.createDataFrame([(i,) for i in wanted], "read_index long")
    # A list that long is sized before it is sent to all executors.
    return df.where(F.col("read_index") <= wanted[-1]).join(F.broadcast(own) if len(wanted) <= 1_000_000 else own, "read_index", "left_semi")


def quality_filter(df: DataFrame, min_mean_quality: float = 20, max_low_q_bases: int = 2_147_483_647, low_q_threshold: int = 20) -> DataFrame:
    """Records of which every mate has the mean quality and few enough low bases."""
    return df.where(reduce(Column.__and__, (R.passes_quality(m, min_mean_quality, max_low_q_bases, low_q_threshold) for m in mates(df))))


def chunk_of(chunk_size: float) -> Column:
    if chunk_size < 1:
        raise ValueError("chunk_size must be >= 1")
    return F.floor(F.col("read_index") / int(chunk_size)).cast("long")


def chunk(df: DataFrame, chunk_size: int, output_prefix: list[str], output_suffix: str = "fastq") -> DataFrame:
    """Route record i to ``prefix_chunk<i div size>`` with the suffix of the format."""
    from ..sources.container import SUFFIX

    ending = (SUFFIXES | {"container": SUFFIX})[output_suffix.removeprefix(".") if output_suffix != SUFFIX else "container"]
    return route(df, [F.concat(F.lit(f"{p}_chunk"), chunk_of(chunk_size).cast("string"), F.lit(ending)) for p in output_prefix])


def route(df: DataFrame, outputs: list[Column | str]) -> DataFrame:
    """Routed rows ``output, read_index, ord, name, seq, qual``: mate i of each record to outputs[i]; an empty or null output drops it."""
    own = mates(df)
    if len(outputs) != len(own):
        raise ValueError("there must be as many outputs as inputs")
    rows = F.array(*(F.struct((F.lit(o) if isinstance(o, str) else o).alias("output"), F.lit(i).alias("ord"), F.col(m).alias("r")) for i, (m, o) in enumerate(zip(own, outputs, strict=True))))
    long = df.select("read_index", F.explode(rows).alias("x")).where("x.output <> ''")
    return long.select("x.output", "read_index", "x.ord", "x.r.name", "x.r.seq", "x.r.qual")


def barcode_label(seq: Column, barcodes: list[str], max_distance: int) -> Column:
    """The one barcode that starts the sequence, or MULTI_MATCH or NO_MATCH; one listed twice counts twice."""
    hits = F.filter(F.array(*(F.when(R.matches_prefix(b, seq, max_distance), F.lit(b)) for b in _patterns(barcodes, "barcodes"))), lambda b: b.isNotNull())
    return F.when(F.size(hits) == 0, NO_MATCH).when(F.size(hits) > 1, MULTI_MATCH).otherwise(F.get(hits, F.lit(0)))


def demux(df: DataFrame, output_format: list[str], barcodes: list[str], max_distance: int = 1) -> DataFrame:
    """Route records by the barcode that starts mate 1; ``{barcode}`` in each template stands for it."""
    if not all("{barcode}" in t for t in output_format):
        raise ValueError("each output must contain {barcode}")
    label = barcode_label(F.col("read1.seq"), barcodes, max_distance)
    split = [t.split("{barcode}", 1) for t in output_format]
    labelled = df.withColumn("__label", label)
    return route(labelled, [F.concat(F.lit(a), F.col("__label"), F.lit(b)) for a, b in split])


def trim_adapters(df: DataFrame, adapters: list[str], max_distance: int = 1, filter_untrimmed: bool = True, label: str = "adapter") -> DataFrame:
    """Cut the first listed adapter that starts mate 1; add ``label``. Untrimmed records go, or stay as they are.

    A mate 1 whose quality is shorter than its adapter is an error.
    """
    seq, qual = F.col("read1.seq"), F.col("read1.qual")
    found = F.coalesce(*(F.when(R.matches_prefix(a, seq, max_distance), F.lit(a)) for a in _patterns(adapters, "adapters")), F.lit(NO_ADAPTER))
    t = df.withColumn(label, found)
    n = F.when(F.col(label) == NO_ADAPTER, 0).otherwise(F.length(label))
    cut = F.struct(F.col("read1.name").alias("name"), F.substring(seq, n + 1, F.length(seq)).alias("seq"), F.substring(qual, n + 1, F.length(qual)).alias("qual"))
    short = (n > 0) & (F.length(qual) < n)
    t = t.withColumn("read1", F.when(short, F.raise_error(F.lit("read sequence and quality lengths differ")).cast(R.READ)).otherwise(cut))
    return t.where(F.col(label) != NO_ADAPTER) if filter_untrimmed else t


def adapter_counts(df: DataFrame, adapters: list[str], max_distance: int = 1) -> DataFrame:
    """``adapter, count`` over all records; adapters that nothing starts with are left out."""
    return trim_adapters(df, adapters, max_distance, filter_untrimmed=False).groupBy("adapter").agg(F.count(F.lit(1)).alias("count"))


def merge_pairs(df: DataFrame, min_overlap: int = 12, max_mismatch_rate: float = 0.10, consensus_mode: str = "max", trim_overhang: bool = True, revcomp_r2: bool = True) -> DataFrame:
    """Add ``merge``: overlap, mismatches, insert size, and the merged seq and qual (null without an overlap)."""
    if mates(df) != ["read1", "read2"]:
        raise ValueError("merging needs two mates")
    if min_overlap < 1 or not 0 <= max_mismatch_rate <= 1 or consensus_mode not in vectorised.CONSENSUS:
        raise ValueError("min_overlap must be >= 1, max_mismatch_rate from 0 to 1, consensus_mode max, mean, r1 or r2")
    return df.withColumn("merge", vectorised.merge(F.col("read1"), F.col("read2"), min_overlap, max_mismatch_rate, consensus_mode, trim_overhang, revcomp_r2))


def merged_reads(merged: DataFrame) -> DataFrame:
    """The merged records as single reads under mate 1's name."""
    return merged.where("merge.overlap > 0").select("read_index", F.struct(F.col("read1.name").alias("name"), F.col("merge.seq").alias("seq"), F.col("merge.qual").alias("qual")).alias("read1"))


def unmerged_pairs(merged: DataFrame) -> DataFrame:
    """The other pairs, unchanged."""
    return merged.where("merge.overlap = 0").select("read_index", "read1", "read2")


def merge_stats(merged: DataFrame) -> DataFrame:
    """One row: how many pairs merged and how; null where none did."""
    m = F.when(F.col("merge.overlap") > 0, F.col("merge"))
    insert = m["insert_size"].cast("double")
    n = F.count(m["overlap"])
    return merged.agg(
        n.alias("merged_reads"), F.count_if(F.col("merge.overlap") == 0).alias("unmerged_reads"), F.avg(insert).alias("mean_insert_size"),
        F.when(n > 1, F.stddev_pop(insert)).alias("sd_insert_size"), F.avg(m["overlap"]).alias("mean_overlap"), F.avg(m["mismatches"] / m["overlap"]).alias("mean_mismatch_rate"),
    )


def zip_mates(*inputs: DataFrame) -> DataFrame:
    """Records from single-end inputs by position; what longer inputs have more is dropped."""
    if not inputs:
        raise ValueError("at least one input is required")
    named = [d.select("read_index", F.col("read1").alias(f"read{i}")) for i, d in enumerate(inputs, 1)]
    return reduce(lambda a, b: a.join(b, "read_index"), named)


def excess_inputs(counts: list[int]) -> list[int]:
    """Zero-based inputs with more reads than the shortest, with a warning if there are any."""
    over = [i for i, n in enumerate(counts) if n > min(counts)]
    if over:
        warnings.warn(f"detected excess reads from inputs: {', '.join(map(str, over))}", stacklevel=2)
    return over


def concat(frames: list[DataFrame], counts: list[int] | None = None) -> DataFrame:
    """All reads of the inputs in order, indexed anew; ``counts`` saves counting them."""
    if not frames:
        raise ValueError("concat requires at least one input file")
    counts = counts or [d.agg((F.coalesce(F.max("read_index"), F.lit(-1)) + 1).alias("n")).first()["n"] for d in frames[:-1]]
    parts, base = [], 0
    for d, n in zip(frames, [*counts, 0], strict=False):
        parts.append(d.withColumn("read_index", F.col("read_index") + base))
        base += n
    return reduce(DataFrame.unionByName, parts)
