"""Seeded random reads: uniform bases, and qualities that fall along the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import reverse_complement


def _bases(n: Column | int, seed: int, salt: str) -> Column:
    """Bases from hashes of row and place, so that any plan gives the same ones."""
    one = lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), F.col("read_index"), i), F.lit(4)).cast("int") + 1, F.lit(1))
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise("")


def _uniform(seed: int, salt: str, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), F.col("read_index"), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, salt: str, *keys: Column) -> Column:
    u, v = _uniform(seed, salt + "u", *keys), _uniform(seed, salt + "v", *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def _quality(n: int, seed: int, salt: str) -> Column:
    """Mean 37 falling to 31, noise of 1.5, one in fifty near 15, kept within 2 and 41."""
    def one(i: Column) -> Column:
        at = (i - 1) / max(n - 1, 1)
        plain = 37 - 6 * F.pow(at, F.lit(1.2)) + 1.5 * _normal(seed, salt + "n", i)
        odd = 15 + 3 * _normal(seed, salt + "o", i)
        q = F.when(_uniform(seed, salt + "s", i) < 0.02, odd).otherwise(plain)
        return F.chr(F.greatest(F.lit(2), F.least(F.lit(41), F.round(q))).cast("long") + 33)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), one), "") if n else F.lit("")


def random_reads(spark: SparkSession, n_reads: int, read_length: int = 100, paired: bool = False, name_prefix: str = "read_", seed: int = 1) -> DataFrame:
    """``read_index, read1`` and, if paired, ``read2``: pairs overlap by about 10 bases (deviation 20), 1 at least."""
    if n_reads < 0 or read_length < 1:
        raise ValueError("n_reads must be at least 0 and read_length at least 1")
    df = spark.range(n_reads).select(F.col("id").alias("read_index"))
    name = F.concat(F.lit(name_prefix), (F.col("read_index") + 1).cast("string"))
    end = lambda k: F.concat(name, F.lit(f"/{k}")) if paired else name
    df = df.withColumn("__s", _bases(read_length, seed, "one"))
    read = lambda k, seq: F.struct(end(k).alias("name"), seq.alias("seq"), _quality(read_length, seed, f"q{k}").alias("qual"))
    if not paired:
        return df.select("read_index", read(1, F.col("__s")).alias("read1"))
    overlap = F.greatest(F.lit(1), F.least(F.lit(read_length), F.round(10 + 20 * _normal(seed, "ov")).cast("int")))
    df = df.withColumn("__o", overlap)
    tail = _bases(F.lit(read_length) - F.col("__o"), seed, "tail")
    second = reverse_complement(F.concat(F.expr("right(__s, __o)"), tail))
    return df.select("read_index", read(1, F.col("__s")).alias("read1"), read(2, second).alias("read2"))
