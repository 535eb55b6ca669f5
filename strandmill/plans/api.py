"""File to file: read, apply an operator, write.

Outputs take the form of their suffix; ``nthreads`` is accepted and ignored,
since Spark decides. Each function keeps the order of the input.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import aggregates, kernels, profile, records
from ..sources import container, datasource, fifo, generate, memory, text


def _list(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def read(spark: SparkSession, paths: str | list[str], wanted: datasource.Wanted | None = None) -> DataFrame:
    """Records of one file a mate, all or those ``wanted``; what longer inputs have more is dropped (``report_excess`` names them)."""
    paths = _list(paths)
    if not paths:
        raise ValueError("at least one input is required")
    return datasource.read_reads(spark, paths, wanted=wanted)


def report_excess(spark: SparkSession, paths: str | list[str]) -> list[int]:
    """Inputs with more reads than the shortest; counts of a container come from its block headers' rows."""
    paths = _list(paths)
    return [] if len(paths) < 2 else records.excess_inputs([_count(spark, p) for p in paths])


def _count(spark: SparkSession, path: str) -> int:
    return read(spark, path).count() if text.kind(path) in ("memory", "fifo") else datasource.count(spark, path)


def write_routed(routed: DataFrame, config: RunConfig | None = None, outputs: list[str] | None = None) -> None:
    """Write routed rows to files, pipes and memory keys by the suffix of their output; ``outputs``, if all are known, saves a scan for the suffixes."""
    is_mem, is_pipe = F.endswith("output", F.lit(".mem")), F.endswith("output", F.lit(".fifo"))
    if outputs is not None:
        kinds = {{"memory": "mem", "fifo": "fifo"}.get(text.kind(o), "file") for o in outputs if o}
    else:
        kinds = {r[0] for r in routed.select(F.when(is_mem, "mem").when(is_pipe, "fifo").otherwise("file")).distinct().collect()}
    if len(kinds) > 1:
        routed = routed.persist()
    try:
        if "file" in kinds:
            datasource.write_routed(routed.where(~is_mem & ~is_pipe), config)
        if "fifo" in kinds:
            fifo.write_routed(routed.where(is_pipe), outputs and [o for o in outputs if text.kind(o) == "fifo"])
        if "mem" in kinds:
            for (key,) in routed.where(is_mem).select("output").distinct().orderBy("output").collect():
                _to_memory(key, routed.where(F.col("output") == key))
    finally:
        if len(kinds) > 1:
            routed.unpersist()


def _to_memory(key: str, rows: DataFrame) -> None:
    """Store rows under consecutive indices, in the order of index and ord."""
    ordered, kept = memory.gapless(rows, ("read_index", "ord"))
    try:
        memory.put(key, ordered.select("read_index", F.struct("name", "seq", "qual").alias("read1")))
    finally:
        kept.unpersist()


def write(df: DataFrame, outputs: str | list[str], config: RunConfig | None = None) -> None:
    """Write each mate to its output; an output without reads isn't made."""
    own = [text.normalised(o) for o in _list(outputs)]
    write_routed(records.route(df, own), config, own)


def _io(spark: SparkSession, inputs: str | list[str], outputs: str | list[str], wanted: datasource.Wanted | None = None) -> DataFrame:
    if len(_list(inputs)) != len(_list(outputs)):
        raise ValueError("input and output must have the same length")
    if len(_list(inputs)) > 1 and not any(text.kind(i) == "fifo" for i in _list(inputs)):
        report_excess(spark, inputs)
    return read(spark, inputs, wanted)


def convert(spark: SparkSession, input, output, nthreads: int = 1) -> None:
    write(_io(spark, input, output), output)


def downsample(spark: SparkSession, input, output, amount: float, nthreads: int = 1) -> None:
    write(records.downsample(_io(spark, input, output), amount), output)


def slice_reads(spark: SparkSession, input, output, limit: int | None = None, select: list[int] | None = None, nthreads: int = 1) -> None:
    listed = sorted({int(i) for i in select if i >= 0}) if select is not None else None
    if listed:
        wanted = datasource.Wanted(listed[0], listed[-1] + 1, listed if len(listed) <= records.LISTED else None)
    else:
        wanted = datasource.Wanted(high=int(limit)) if limit is not None and limit > 0 else None
    write(records.slice_reads(_io(spark, input, output, wanted), limit, select), output)


def quality_filter(spark: SparkSession, input, output, min_mean_quality: float = 20, max_low_q_bases: int = 2_147_483_647, low_q_threshold: int = 20, nthreads: int = 1) -> None:
    write(records.quality_filter(_io(spark, input, output), min_mean_quality, max_low_q_bases, low_q_threshold), output)


def chunk(spark: SparkSession, input, output_prefix, output_suffix: str = "fastq", chunk_size: int = 1_000_000, nthreads: int = 1) -> None:
    prefixes = [text.normalised(p) if output_suffix != "mem" else p for p in _list(output_prefix)]
    write_routed(records.chunk(_io(spark, input, output_prefix), chunk_size, prefixes, output_suffix))


def demux(spark: SparkSession, input, output_format, barcodes: list[str], max_distance: int = 1, nthreads: int = 1) -> None:
    write_routed(records.demux(_io(spark, input, output_format), [text.normalised(o) for o in _list(output_format)], barcodes, max_distance))


def trim_adapters(spark: SparkSession, input, output, adapters: list[str], max_distance: int = 1, filter_untrimmed: bool = True, nthreads: int = 1) -> DataFrame:
    """Writes the trimmed records; returns the counts of adapters."""
    df = _io(spark, input, output)
    write(records.trim_adapters(df, adapters, max_distance, filter_untrimmed).drop("adapter"), output)
    return records.adapter_counts(df, adapters, max_distance)


def merge_pairs(spark: SparkSession, input: list[str], output_merged: str, output_unmerged: list[str] | None = None, nthreads: int = 1, **how) -> DataFrame:
    """Writes merged reads, and the other pairs if outputs are given; returns the statistics."""
    merged = records.merge_pairs(read(spark, input), **how).persist()
    try:
        write(records.merged_reads(merged), output_merged)
        if output_unmerged:
            write(records.unmerged_pairs(merged), output_unmerged)
        stats = records.merge_stats(merged).collect()
        return spark.createDataFrame(stats, records.merge_stats(merged).schema)
    finally:
        merged.unpersist()


def count_barcodes(spark: SparkSession, input, barcodes: list[str], max_distance: int = 1, allow_revcomp: bool = False, nthreads: int = 1) -> DataFrame:
    return aggregates.count_barcodes(read(spark, input), barcodes, max_distance, allow_revcomp)


def summary(spark: SparkSession, input, phred33: bool = True, min_overlap: int = 12, max_mismatch_rate: float = 0.10, limit: int = 0, nthreads: int = 1) -> dict[str, DataFrame]:
    """Tables from one scan of the inputs; ``insert_size`` is there only if some pair overlaps."""
    out = profile.summary(read(spark, input), phred33, min_overlap, max_mismatch_rate, limit)
    if "insert_size" in out and out["insert_size"].isEmpty():
        del out["insert_size"]
    return out


def concat(spark: SparkSession, input: list[str], output: str, nthreads: int = 1, config: RunConfig | None = None) -> None:
    """All inputs, of any forms, in order in one output, which is made even if there are no reads."""
    if not isinstance(output, str):
        raise ValueError("output must be a single file path or .mem key")
    if not _list(input):
        raise ValueError("concat requires at least one input file")
    frames = [read(spark, p) for p in _list(input)]
    counts = [d.count() if text.kind(p) in ("memory", "fifo") else datasource.count(spark, p) for p, d in zip(_list(input), frames[:-1], strict=False)]
    whole = records.concat(frames, counts)
    write(whole, output, config)
    _make_if_missing(spark, output, config or RunConfig.current())


def _make_if_missing(spark: SparkSession, output: str, config: RunConfig) -> None:
    """An output without reads, in the form of its suffix."""
    form = text.kind(output)
    if form == "memory":
        memory.put(output, spark.createDataFrame([], "read_index long, read1 struct<name:string,seq:string,qual:string>"))
    elif form != "fifo" and not os.path.exists(path := text.normalised(output)):
        with open(path, "wb") as f:
            f.write(container.HEADER if form == "container" else b"".join(text.compress(iter(()), form, config.gzip_level, config.zstd_level)))


def _once(routed: DataFrame) -> DataFrame:
    """Rows of a kernel, which is called once for each block: checkpointed if the session has a folder, else kept."""
    if routed.sparkSession.sparkContext.getCheckpointDir():
        return routed.checkpoint()
    kept = routed.persist()
    kept.count()
    return kept


def run_kernel(spark: SparkSession, input, kernel, limit: int | None = None, nthreads: int = 1, mode: str = "blocks", config: RunConfig | None = None) -> None:
    """Run a block kernel and write what it emits; with limit 0 it isn't called. On an error no output is left."""
    config = config or RunConfig.current(limit=limit)
    if config.limit == 0:
        return
    routed = _once(kernels.run_blocks(read(spark, input), kernel, config, mode))
    write_routed(routed.withColumn("output", F.when(F.endswith("output", F.lit(".mem")) | F.startswith("output", F.lit("/")), F.col("output")).otherwise(F.concat(F.lit(os.getcwd() + "/"), "output"))), config)


def run_record_kernel(spark: SparkSession, input, kernel, limit: int | None = None, config: RunConfig | None = None) -> None:
    config = config or RunConfig.current(limit=limit)
    write_routed(_once(kernels.run_records(read(spark, input), kernel, config)), config)


def generate_random(spark: SparkSession, output: str | list[str], n_reads: int = 100_000, read_length: int = 100, name_prefix: str = "read_", seed: int = 1) -> None:
    outputs = _list(output)
    if len(outputs) not in (1, 2):
        raise ValueError("one or two output files")
    if any(o.lower().endswith(".zst") for o in outputs):
        raise ValueError("random reads are written plain or as gzip")
    write(generate.random_reads(spark, n_reads, read_length, len(outputs) == 2, name_prefix, seed), outputs)


def mem_load(spark: SparkSession, input, mem_key, nthreads: int = 1) -> None:
    inputs, keys = _list(input), _list(mem_key)
    if len(inputs) != len(keys) or not all(k.endswith(".mem") for k in keys):
        raise ValueError("input and mem_key must have the same length, and keys end with .mem")
    for i, k in zip(inputs, keys, strict=True):
        memory.put(k, read(spark, i))


mem_remove, mem_list, fifo_supported = memory.remove, memory.listing, fifo.supported
