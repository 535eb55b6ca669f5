"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 100_000
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandmill-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """From now on batches to Python workers have BATCH_BYTES, unless the session names a size: rows alone, ten thousand
    by default, bound neither the JVM's buffers nor the worker's. A longer row has a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == str((1 << 31) - 1):
        spark.conf.set(name, BATCH_BYTES)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay below the bound, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def gapless_rank(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each ``key``, whatever the size of a key.

    Rows of a key are dealt to buckets by a hash of ``order``; rows are numbered
    in each bucket, and the bucket's offset is the running sum of the bucket
    sizes. A hot key is thus shared by as many tasks as there are buckets. The
    input is scanned twice: pass a checkpointed frame. Rows equal in all of
    ``order`` may swap their numbers.
    """
    n = 4 * shuffle_parts(df.sparkSession)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(n)))
    sizes = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1)
    joined = inside.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(name, (F.col("__start") + F.col("__rn")).cast("long")).drop("__bucket", "__rn", "__key", "__b", "__start")
