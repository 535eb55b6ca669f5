"""Registered queries that go through files, memory keys, pipes and tables, and their SQL.

Each call writes the derived reads into a folder of its own, which lies where all
executors see it and is deleted when the process ends, and reads them back.
"""

from __future__ import annotations

import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import reads as R
from ..operators import profile, records
from ..sources import container, datasource, fifo, interop, memory
from ..sources.spool import folder as _folder
from . import api
from .queries import ORACLES, QUERIES, _flat, _overlap_sql, _query, pairs, singles

__all__ = ["ORACLES", "QUERIES"]

_PAIRED = "SELECT read_index, r1.name AS name1, r1.seq AS seq1, r1.qual AS qual1, r2.name AS name2, r2.seq AS seq2, r2.qual AS qual2 FROM r1 JOIN r2 USING (read_index)"


def _both(df: DataFrame) -> DataFrame:
    return df.select("read_index", *(F.col(f"read{m}.{c}").alias(f"{c}{m}") for m in (1, 2) for c in ("name", "seq", "qual")))


def _through(suffix: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        outputs = [f"{folder}/reads_R{m}{suffix}" for m in (1, 2)]
        api.write(pairs(spark, sf_dir), outputs, RunConfig.current(blocksize=1000))
        return _both(api.read(spark, outputs))

    return run


for _name, _suffix in (("plain", ".fastq"), ("gzip", ".fastq.gz"), ("zstd", ".fastq.zst"), ("container", container.SUFFIX)):
    _run = _through(_suffix)
    _run.__name__ = f"file_{_name}"
    _query(_PAIRED)(_run)


@_query(_PAIRED)
def file_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain mates, read by byte ranges that end at different records in each."""
    folder = _folder(spark)
    api.write(pairs(spark, sf_dir), outputs := [f"{folder}/a.fastq", f"{folder}/b.fastq"])
    return _both(datasource.read_reads(spark, outputs, split_bytes=max(os.path.getsize(outputs[0]) // 5, 4096)))


@_query("SELECT * FROM r1 WHERE read_index BETWEEN 700 AND 2099")
def file_container_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks outside the range aren't read."""
    output = f"{_folder(spark)}/reads{container.SUFFIX}"
    api.write(singles(spark, sf_dir), output, RunConfig.current(blocksize=500))
    return _flat(api.read(spark, output, datasource.Wanted(700, 2100)))


@_query("SELECT * FROM r1 UNION ALL SELECT read_index + (SELECT count(*) FROM r1), name, seq, qual FROM r2 UNION ALL SELECT read_index + 2 * (SELECT count(*) FROM r1), name, seq, qual FROM r1")
def file_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of three forms in one of a fourth."""
    folder = _folder(spark)
    inputs = [f"{folder}/a.fastq", f"{folder}/b.fastq.gz", f"{folder}/c{container.SUFFIX}"]
    api.write(pairs(spark, sf_dir), inputs[:2])
    api.convert(spark, inputs[0], inputs[2])
    api.concat(spark, inputs, output := f"{folder}/all.fastq.zst")
    return _flat(api.read(spark, output))


@_query("SELECT (read_index // 400)::BIGINT AS chunk, read_index % 400 AS read_index, name, seq, qual FROM r1 WHERE read_index < 2000")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chunk files, each read again by itself."""
    folder = _folder(spark)
    api.write(records.slice_reads(singles(spark, sf_dir), limit=2000), whole := f"{folder}/reads.fastq.zst")
    api.chunk(spark, whole, f"{folder}/part", "gz", 400)
    made = sorted(f for f in os.listdir(folder) if f.startswith("part"))
    frames = [_flat(api.read(spark, f"{folder}/{f}")).select(F.lit(i).cast("long").alias("chunk"), "*") for i, f in enumerate(sorted(made, key=lambda f: int("".join(filter(str.isdigit, f)))))]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@_query("SELECT read_index, name, seq, qual FROM r1 UNION ALL SELECT read_index + (SELECT count(*) FROM r1), name, seq, qual FROM r2")
def memory_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads into one key of the memory store, the second appended."""
    folder, key = _folder(spark), "registered_query.mem"
    api.write(pairs(spark, sf_dir), inputs := [f"{folder}/a.fastq.zst", f"{folder}/b.fastq.zst"])
    memory.remove(key)
    for i in inputs:
        api.mem_load(spark, i, key)
    return _flat(api.read(spark, key))


@_query("SELECT 'registered_list.mem' AS mem_key, count(*) AS n_reads FROM r1")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    memory.remove("registered_list.mem")
    api.write(singles(spark, sf_dir), "registered_list.mem")
    return memory.listing(spark).where("mem_key = 'registered_list.mem'")


@_query("SELECT * FROM r1")
def pipe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out through a named pipe and in again; a pipe ends at the driver, whatever the engine, which streams between it and files that executors share."""
    path = f"{_folder(spark)}/reads.fifo"
    os.mkfifo(path)
    got: list[DataFrame] = []
    reader = threading.Thread(target=lambda: got.append(fifo.read(spark, path)), daemon=True)
    reader.start()
    api.write(singles(spark, sf_dir), path)
    reader.join()
    return _flat(got[0])


@_query("SELECT * FROM r1 WHERE read_index < 5000")
def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a table in the driver's memory and back; such tables are small by contract."""
    return _flat(interop.from_table(spark, interop.to_tables(records.slice_reads(singles(spark, sf_dir), limit=5000))))


@_query("SELECT read_index, 'r' || (read_index + 1)::VARCHAR || '/1' AS name1, 'r' || (read_index + 1)::VARCHAR || '/2' AS name2, 40 AS length1, 40 AS length2, true AS known_bases FROM r1 WHERE read_index < 3000")
def random_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, lengths and alphabet of generated pairs, written as gzip and read again."""
    folder = _folder(spark)
    outputs = [f"{folder}/g_R{m}.fastq.gz" for m in (1, 2)]
    api.generate_random(spark, outputs, 3000, 40, "r", 7)
    t = api.read(spark, outputs)
    known = F.length(F.translate(F.concat("read1.seq", "read2.seq"), "ACGT", "")) == 0
    return t.select("read_index", F.col("read1.name").alias("name1"), F.col("read2.name").alias("name2"), F.length("read1.qual").alias("length1"), F.length("read2.seq").alias("length2"), known.alias("known_bases"))


@_query("SELECT read_index, r1.seq AS seq1, r2.seq AS seq2 FROM r1 JOIN r2 USING (read_index) WHERE read_index < (SELECT count(*) FROM r1) - 7")
def file_shorter_mate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the longer input has more is dropped."""
    folder = _folder(spark)
    inputs = [f"{folder}/long.fastq.gz", f"{folder}/short{container.SUFFIX}"]
    reads = pairs(spark, sf_dir)
    api.write(singles(spark, sf_dir), inputs[0])
    api.write(reads.select("read_index", F.col("read2").alias("read1")).where(F.col("read_index") < reads.count() - 7), inputs[1], RunConfig.current(blocksize=300))
    return api.read(spark, inputs).select("read_index", F.col("read1.seq").alias("seq1"), F.col("read2.seq").alias("seq2"))


@_query("SELECT read_index, array_to_string(list_transform(range(1, 10), lambda i: substr(r1.seq, i::INT, 1) || substr(r2.seq, i::INT, 1)), '') AS both, ends_with(r1.seq, 'A') AS ends_a, true AS same FROM r1 JOIN r2 USING (read_index)")
def read_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = R.zip_pairs(F.split("read1.seq", ""), F.split(F.substring("read2.seq", 1, 9), ""))
    t = pairs(spark, sf_dir).select("read_index", "read1", zipped.cast("array<struct<a:string,b:string>>").alias("z"))
    joined = F.array_join(F.transform("z", lambda p: F.concat(p["a"], p["b"])), "")
    return t.select("read_index", joined.alias("both"), R.ends_with("read1.seq", "A").alias("ends_a"), R.same_length("read1").alias("same"))


_PROFILE = """, u AS (SELECT 1 AS mate, seq, qual FROM r1 UNION ALL SELECT 2, seq, qual FROM r2),
q AS (SELECT mate, p, substr(seq, p::INT, 1) AS base, greatest(ascii(substr(qual, p::INT, 1)) - 33, 0) AS v FROM u, range(1, 33) t(p)),
a AS (SELECT mate, (2 * list_sum(list_transform(string_split(qual, ''), lambda c: greatest(ascii(c) - 33, 0))) + 32) // 64 AS x FROM u)
SELECT mate::INT AS mate, 'quality' AS kind, p::BIGINT AS x, NULL::VARCHAR AS base, count(*) AS n, sum(v)::BIGINT AS total FROM q GROUP BY mate, p
UNION ALL SELECT mate::INT, 'content', p::BIGINT, base, count(*), 0::BIGINT FROM q GROUP BY mate, p, base
UNION ALL SELECT mate::INT, 'length', length(seq)::BIGINT, NULL, count(*), 0::BIGINT FROM u GROUP BY mate, length(seq)
UNION ALL SELECT mate::INT, 'mean', x::BIGINT, NULL, count(*), 0::BIGINT FROM a GROUP BY mate, x
UNION ALL SELECT mate::INT, 'gc', 0::BIGINT, NULL, sum(length(seq) - length(translate(seq, 'GC', '')))::BIGINT, 0::BIGINT FROM u GROUP BY mate
UNION ALL SELECT 0, 'insert', (64 - overlap)::BIGINT, NULL, count(*), 0::BIGINT FROM m WHERE overlap > 0 GROUP BY overlap"""


@_query(_overlap_sql().rstrip() + _PROFILE)
def summary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts behind all tables of a summary, in one scan."""
    return profile.profile(pairs(spark, sf_dir))
