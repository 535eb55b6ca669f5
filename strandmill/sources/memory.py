"""The in-memory store: keys that end in .mem, each a persisted frame of reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    frame: DataFrame
    count: int


_store: dict[str, Entry] = {}


def _key(key: str) -> str:
    if not key.endswith(".mem"):
        raise ValueError("memory keys must end with .mem")
    return key


def gapless(reads: DataFrame, order: tuple[str, ...] = ("read_index",)) -> tuple[DataFrame, DataFrame]:
    """The reads with the indices 0, 1, 2, ... in the order of ``order``: a row's place in its sorted partition after the rows of those before.

    Also the frame that is kept meanwhile, to be let go of when the first is stored.
    """
    n, low, high = reads.agg(F.count(F.lit(1)), F.min("read_index"), F.max("read_index")).first()
    if not n or (len(order) == 1 and low == 0 and high == n - 1):
        return reads, reads
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = reads.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).persist()
    part, start, starts = F.shiftright("__id", 33), 0, []
    for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # a row a partition
        starts += [F.lit(r["p"]), F.lit(start)]
        start += r["n"]
    index = F.element_at(F.create_map(*starts), part) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("read_index", index.cast("long")).drop("__id"), ordered


def put(key: str, reads: DataFrame) -> int:
    """Append single-end reads (read_index, read1) to a key, made if missing; how many it then has.

    Indices become gapless in the order of the given ones. On failure the key stays as it was.
    """
    old = _store.get(_key(key))
    base = old.count if old else 0
    numbered, kept = gapless(reads)
    moved = numbered.select((F.col("read_index") + base).alias("read_index"), "read1")
    new = old.frame.unionByName(moved) if old else moved
    new = new.persist()
    try:
        n = new.count()
    except BaseException:
        new.unpersist()
        raise
    finally:
        if kept is not reads:
            kept.unpersist()
    _store[key] = Entry(new, n)
    if old:
        old.frame.unpersist()
    return n


def read(spark: SparkSession, key: str) -> DataFrame:
    if key not in _store:
        raise KeyError(f"memory key not found: {key}")
    return _store[key].frame


def remove(keys: str | list[str]) -> list[bool]:
    """Whether each key was there."""
    out = []
    for k in [keys] if isinstance(keys, str) else keys:
        entry = _store.pop(k, None)
        if entry:
            entry.frame.unpersist()
        out.append(entry is not None)
    return out


def listing(spark: SparkSession) -> DataFrame:
    """``mem_key, n_reads``."""
    return spark.createDataFrame([(k, e.count) for k, e in sorted(_store.items())], "mem_key string, n_reads long")
