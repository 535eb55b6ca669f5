"""Files that arrive in a folder, processed as a stream.

Every file is a run of its own, indexed from zero; a micro-batch applies an
operator to the files that came and hands the result on. Outputs of a file are
written by a staged commit, so a replayed batch overwrites what it left.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import datasource


def process_folder(spark: SparkSession, folder: str, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, str], None], checkpoint_dir: str, glob: str = "*", available_now: bool = True) -> StreamingQuery:
    """Apply ``operator`` to each new file and pass the result and the file's path to ``sink``."""
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")

    def batch(paths: DataFrame, _: int) -> None:
        own = paths.sparkSession
        # One name a file, and a batch's files are bounded by maxFilesPerTrigger.
        for (path,) in sorted(paths.distinct().collect()):
            local = path.removeprefix("file://").removeprefix("file:")
            sink(operator(datasource.read_reads(own, [os.path.abspath(local)])), local)

    writer = found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_counts(reads: DataFrame) -> DataFrame:
    """Over a stream of reads (name, seq, qual): how many reads and bases of each length, for complete or update mode."""
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("seq")).alias("bases"))
