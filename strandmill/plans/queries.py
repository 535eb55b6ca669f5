"""Registered queries of the read operators, and their SQL.

The test tables hold no reads; both engines derive them from ``orders``, whose
keys are dense from 0, by the same hashes.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment
from ..functions import reads as R
from ..operators import aggregates, kernels, records
from ..sources import container

BARCODES = ["ACG", "TTT", "GATC", "CCA"]
INDEX_BARCODES = ["ACGTA", "TTTCA", "GATCG"]
ADAPTERS = ["ACG", "TTTG", "GA"]
SELECTED = [0, 2, 3, 5, 8, 13, 21, 400, 987, 1_000_000_000]
_HEX = "0123456789abcdef"
_SEQ, _QUAL = "ACGTACGTACGTACGT", "IIIHGFEDCB;740+#"


def _derived(tag: str, to: str) -> Column:
    return F.translate(F.md5(F.concat(F.lit(tag), F.col("o_orderkey").cast("string")).cast("binary")), _HEX, to)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_index, read1, read2: 32 bases each, overlapping by 0 to 24."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    t = t.select("o_orderkey", _derived("s", _SEQ).alias("s1"), _derived("q", _QUAL).alias("q1"), _derived("t", _SEQ).alias("tail"), _derived("r", _QUAL).alias("q2"))
    second = R.reverse_complement(F.expr("left(concat(right(s1, cast(o_orderkey % 25 as int)), tail), 32)"))
    name = lambda k: F.concat(F.lit("read_"), (F.col("o_orderkey") + 1).cast("string"), F.lit(f"/{k}"))
    return t.select(
        F.col("o_orderkey").alias("read_index"), F.struct(name(1).alias("name"), F.col("s1").alias("seq"), F.col("q1").alias("qual")).alias("read1"),
        F.struct(name(2).alias("name"), second.alias("seq"), F.col("q2").alias("qual")).alias("read2"),
    )


def singles(spark: SparkSession, sf_dir: str, mate: int = 1) -> DataFrame:
    return pairs(spark, sf_dir).select("read_index", F.col(f"read{mate}").alias("read1"))


_CTE = f"""WITH r1 AS (SELECT o_orderkey AS read_index, 'read_' || (o_orderkey + 1)::VARCHAR || '/1' AS name,
  translate(md5('s' || o_orderkey::VARCHAR), '{_HEX}', '{_SEQ}') AS seq, translate(md5('q' || o_orderkey::VARCHAR), '{_HEX}', '{_QUAL}') AS qual FROM orders),
t2 AS (SELECT read_index, substr((CASE WHEN read_index % 25 = 0 THEN '' ELSE right(seq, (read_index % 25)::INT) END) || translate(md5('t' || read_index::VARCHAR), '{_HEX}', '{_SEQ}'), 1, 32) AS fwd FROM r1),
r2 AS (SELECT read_index, 'read_' || (read_index + 1)::VARCHAR || '/2' AS name, reverse(translate(fwd, 'ACGTacgt', 'TGCAtgca')) AS seq,
  translate(md5('r' || read_index::VARCHAR), '{_HEX}', '{_QUAL}') AS qual FROM t2)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _CTE + sql
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    return df.select("read_index", "read1.*")


@_query("SELECT * FROM r1")
def reads_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(singles(spark, sf_dir))


@_query("SELECT read_index, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM r1")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return singles(spark, sf_dir).select("read_index", R.reverse_complement("read1.seq").alias("rc"))


@_query("SELECT read_index, substr(seq, 5, 16) AS seq, substr(qual, 5, 16) AS qual FROM r1")
def trim_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return singles(spark, sf_dir).select("read_index", R.trim_read("read1", 4, 20).alias("t")).select("read_index", "t.seq", "t.qual")


@_query("SELECT read_index, r1.name AS name1, r1.seq AS seq1, r2.name AS name2, r2.seq AS seq2 FROM r1 JOIN r2 USING (read_index)")
def paired_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = records.zip_mates(singles(spark, sf_dir, 1), singles(spark, sf_dir, 2))
    return both.select("read_index", F.col("read1.name").alias("name1"), F.col("read1.seq").alias("seq1"), F.col("read2.name").alias("name2"), F.col("read2.seq").alias("seq2"))


@_query("SELECT * FROM r1 UNION ALL SELECT read_index + (SELECT count(*) FROM r1), name, seq, qual FROM r2")
def concat_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records.concat([singles(spark, sf_dir, 1), singles(spark, sf_dir, 2)]))


@_query("SELECT * FROM r1 WHERE floor(0.3::DOUBLE * (read_index + 1)) > floor(0.3::DOUBLE * read_index)")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records.downsample(singles(spark, sf_dir), 0.3))


@_query("SELECT * FROM r1 WHERE read_index < 1000")
def slice_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records.slice_reads(singles(spark, sf_dir), limit=1000))


@_query(f"SELECT * FROM r1 WHERE read_index IN ({', '.join(map(str, SELECTED))})")
def slice_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records.slice_reads(singles(spark, sf_dir), select=SELECTED))


@_query("SELECT 'out_chunk' || (read_index // 200)::VARCHAR || '.fastq' AS output, read_index, 0 AS ord, name, seq, qual FROM r1")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunk(singles(spark, sf_dir), 200, ["out"], "fastq")


_PASSES = "list_sum(list_transform(string_split({q}, ''), lambda c: greatest(ascii(c) - 33, 0))) / length({q})::DOUBLE >= 30 AND len(list_filter(string_split({q}, ''), lambda c: ascii(c) - 33 < 20)) <= 6"


@_query(f"SELECT * FROM r1 WHERE {_PASSES.format(q='qual')}")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(records.quality_filter(singles(spark, sf_dir), 30, 6, 20))


@_query(f"SELECT read_index, r1.name AS name1, r2.name AS name2 FROM r1 JOIN r2 USING (read_index) WHERE {_PASSES.format(q='r1.qual')} AND {_PASSES.format(q='r2.qual')}")
def quality_filter_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.quality_filter(pairs(spark, sf_dir), 30, 6, 20).select("read_index", F.col("read1.name").alias("name1"), F.col("read2.name").alias("name2"))


_BASIC = """SELECT count(*) AS total_sequences, sum(length(seq))::BIGINT AS total_bases, min(length(seq))::BIGINT AS seq_len_min, avg(length(seq)) AS seq_len_mean,
max(length(seq))::BIGINT AS seq_len_max, 100.0::DOUBLE * sum(length(seq) - length(translate(seq, 'GC', ''))) / sum(length(seq)) AS gc_percent FROM {t}"""


@_query(f", kept AS (SELECT * FROM r1 WHERE {_PASSES.format(q='qual')}) " + _BASIC.format(t="kept"))
def quality_filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.basic_stats(aggregates.admitted(records.quality_filter(singles(spark, sf_dir), 30, 6, 20), "read1"))


def _prefix_hit(b: str, d: int, seq: str = "seq") -> str:
    return "(" + " + ".join(f"(substr({seq}, {i + 1}, 1) <> '{c}')::INT" for i, c in enumerate(b)) + f") <= {d}"


def _within_hit(b: str, d: int, seq: str) -> str:
    wrong = " + ".join(f"(substr({seq}, (i + {k})::INT, 1) <> '{c}')::INT" for k, c in enumerate(b))
    return f"(len(list_filter(range(1, length({seq}) - {len(b)} + 2), lambda i: ({wrong}) <= {d})) > 0)"


_DEMUX = ", hits AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {_prefix_hit(b, 1)} THEN '{b}' END" for b in INDEX_BARCODES) + "], lambda b: b IS NOT NULL) AS h FROM r1) "


@_query(_DEMUX + "SELECT 'lib_' || (CASE WHEN len(h) = 0 THEN 'NO_MATCH' WHEN len(h) > 1 THEN 'MULTI_MATCH' ELSE h[1] END) || '.fastq' AS output, read_index, 0 AS ord, name, seq, qual FROM hits")
def demux_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.demux(singles(spark, sf_dir), ["lib_{barcode}.fastq"], INDEX_BARCODES, 1)


def _rc(b: str) -> str:
    return b[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _barcodes_sql(barcodes: list[str], d: int, revcomp: bool) -> str:
    one = lambda b: " OR ".join(_within_hit(f, d, s) for f in ([b, _rc(b)] if revcomp else [b]) for s in ("r1.seq", "r2.seq"))
    hits = ", ".join(f"CASE WHEN {one(b)} THEN '{b}' END" for b in barcodes)
    return f", hits AS (SELECT list_filter([{hits}], lambda b: b IS NOT NULL) AS h FROM r1 JOIN r2 USING (read_index)) SELECT CASE WHEN len(h) = 0 THEN 'NO_MATCH' WHEN len(h) > 1 THEN 'MULTI_MATCH' ELSE h[1] END AS barcode, count(*) AS \"count\" FROM hits GROUP BY 1"


@_query(_barcodes_sql(BARCODES, 0, False))
def count_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_barcodes(pairs(spark, sf_dir), BARCODES, 0)


LONG_BARCODES = ["ACGTACG", "TTTCAGG", "GATCGAT"]


@_query(_barcodes_sql(LONG_BARCODES, 1, True))
def count_barcodes_d1_revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_barcodes(pairs(spark, sf_dir), LONG_BARCODES, 1, True)


_TRIM = ", cut AS (SELECT *, CASE " + " ".join(f"WHEN {_prefix_hit(a, 1)} THEN '{a}'" for a in ADAPTERS) + " ELSE 'NO_ADAPTER' END AS adapter FROM r1) "


@_query(_TRIM + "SELECT read_index, name, substr(seq, length(adapter) + 1) AS seq, substr(qual, length(adapter) + 1) AS qual, adapter FROM cut WHERE adapter <> 'NO_ADAPTER'")
def trim_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.trim_adapters(singles(spark, sf_dir), ADAPTERS, 1).select("read_index", "read1.*", "adapter")


@_query(_TRIM + 'SELECT adapter, count(*) AS "count" FROM cut GROUP BY 1')
def trim_adapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.adapter_counts(singles(spark, sf_dir), ADAPTERS, 1)


def _overlap_sql(least: int = 12, rate: float = 0.1) -> str:
    wrong = "len(list_filter(range(1, l + 1), lambda i: substr(s1, (32 - l + i)::INT, 1) <> substr(s2, i::INT, 1)))"
    return f""", p AS (SELECT read_index, r1.name, r1.seq AS s1, r1.qual AS q1, fwd AS s2, reverse(r2.qual) AS q2 FROM r1 JOIN r2 USING (read_index) JOIN t2 USING (read_index)),
    o AS (SELECT p.*, l, {wrong} AS wrong FROM p, range({least}, 33) t(l)),
    m AS (SELECT p.*, coalesce(b.l, 0) AS overlap, coalesce(b.wrong, 0) AS mismatches FROM p LEFT JOIN
      (SELECT read_index, max(l) AS l, arg_max(wrong, l) AS wrong FROM o WHERE wrong <= ceil({rate}::DOUBLE * l) GROUP BY read_index) b USING (read_index)) """


_BOTH = "list_transform(range(1, overlap + 1), lambda i: {e})"
_A, _QA, _B, _QB = "substr(s1, (32 - overlap + i)::INT, 1)", "substr(q1, (32 - overlap + i)::INT, 1)", "substr(s2, i::INT, 1)", "substr(q2, i::INT, 1)"
_CONSENSUS = {
    "max": (f"CASE WHEN ascii({_QB}) > ascii({_QA}) THEN {_B} ELSE {_A} END", f"CASE WHEN ascii({_QB}) > ascii({_QA}) THEN {_QB} ELSE {_QA} END"),
    "mean": (f"CASE WHEN ascii({_QB}) > ascii({_QA}) THEN {_B} ELSE {_A} END", f"chr(((ascii({_QA}) + ascii({_QB}) + 1) // 2)::INT)"),
    "r1": (_A, _QA),
    "r2": (_B, _QB),
}


def _merged_sql(mode: str) -> str:
    s, q = _CONSENSUS[mode]
    part = lambda e: f"array_to_string({_BOTH.format(e=e)}, '')"
    return _overlap_sql() + f"SELECT read_index, name, substr(s1, 1, (32 - overlap)::INT) || {part(s)} || substr(s2, (overlap + 1)::INT) AS seq, substr(q1, 1, (32 - overlap)::INT) || {part(q)} || substr(q2, (overlap + 1)::INT) AS qual FROM m WHERE overlap > 0"


def _merge_query(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(records.merged_reads(records.merge_pairs(pairs(spark, sf_dir), consensus_mode=mode)))

    run.__name__ = f"merge_pairs_{mode}"
    return run


for _mode in _CONSENSUS:
    _query(_merged_sql(_mode))(_merge_query(_mode))


@_query(_overlap_sql() + "SELECT read_index, name AS name1 FROM m WHERE overlap = 0")
def merge_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unmerged_pairs(records.merge_pairs(pairs(spark, sf_dir))).select("read_index", F.col("read1.name").alias("name1"))


@_query(
    _overlap_sql()
    + """SELECT count(*) FILTER (WHERE overlap > 0) AS merged_reads, count(*) FILTER (WHERE overlap = 0) AS unmerged_reads, round(avg(64 - overlap) FILTER (WHERE overlap > 0), 6) AS mean_insert_size,
round(stddev_pop(64 - overlap) FILTER (WHERE overlap > 0), 6) AS sd_insert_size, round(avg(overlap) FILTER (WHERE overlap > 0), 6) AS mean_overlap, round(avg(mismatches / overlap::DOUBLE) FILTER (WHERE overlap > 0), 6) AS mean_mismatch_rate FROM m"""
)
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.merge_stats(records.merge_pairs(pairs(spark, sf_dir)))
    return out.select("merged_reads", "unmerged_reads", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@_query(_BASIC.format(t="r1"))
def summary_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(singles(spark, sf_dir))["basic_stats_R1"]


@_query("SELECT p::INT AS position, round(avg(greatest(ascii(substr(qual, p::INT, 1)) - 33, 0)), 9) AS mean_q, count(*) AS n FROM r1, range(1, 33) t(p) GROUP BY 1")
def summary_base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(singles(spark, sf_dir))["per_base_quality_R1"].withColumn("mean_q", F.round("mean_q", 9))


@_query("SELECT p::INT AS position, substr(seq, p::INT, 1) AS base, count(*) AS \"count\", round(count(*) / (sum(count(*)) OVER (PARTITION BY p))::DOUBLE, 9) AS fraction FROM r2, range(1, 33) t(p) GROUP BY p, substr(seq, p::INT, 1)")
def summary_base_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(pairs(spark, sf_dir))["per_base_content_R2"].withColumn("fraction", F.round("fraction", 9))


@_query('SELECT length(seq)::INT AS length, count(*) AS "count" FROM r1 GROUP BY 1')
def summary_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(singles(spark, sf_dir))["length_distribution_R1"]


@_query("SELECT round(list_sum(list_transform(string_split(qual, ''), lambda c: greatest(ascii(c) - 33, 0))) / length(qual)::DOUBLE)::INT AS avg_quality, count(*) AS \"count\" FROM r1 GROUP BY 1")
def summary_avg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(singles(spark, sf_dir))["avg_read_quality_R1"]


@_query(_overlap_sql() + 'SELECT (64 - overlap)::INT AS insert_size, count(*) AS "count" FROM m WHERE overlap > 0 GROUP BY 1')
def summary_insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.summary(pairs(spark, sf_dir))["insert_size"]


_WHOLE = ", a AS (SELECT read_index, r1.seq AS query, r2.seq AS target FROM r1 JOIN r2 USING (read_index)) "
_BARCODE = f", a AS (SELECT read_index, CASE read_index % 3 {' '.join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(INDEX_BARCODES))} END AS query, seq AS target FROM r2) "


def _align(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """All 32 bases of read1 with all of read2; for Hamming ``contains``, a whole barcode with all of read2."""
    inside = how["boundary"] == "contains" and how["distance_metric"] == "hm"
    query = F.element_at(F.array(*map(F.lit, INDEX_BARCODES)), (F.col("read_index") % len(INDEX_BARCODES) + 1).cast("int")) if inside else F.col("read1.seq")
    t = pairs(spark, sf_dir).select("read_index", query.alias("query"), F.col("read2.seq").alias("target"))
    return t.select("read_index", alignment.align("query", "target", **how).alias("a")).select("read_index", "a.*")


def _hm_sql(n: int, most: int, windows: int = 1) -> str:
    wrong = f"len(list_filter(range(1, {n + 1}), lambda k: substr(query, k::INT, 1) <> substr(target, (i + k)::INT, 1)))"
    best = f", b AS (SELECT read_index, min({wrong} * 100 + i) AS x FROM a, range(0, {windows}) t(i) GROUP BY 1)"
    return best + f""" SELECT read_index, (CASE WHEN x // 100 <= {most} THEN x % 100 ELSE 0 END)::INT AS start,
    (CASE WHEN x // 100 <= {most} THEN x % 100 + {n - 1} ELSE 0 END)::INT AS "end", (CASE WHEN x // 100 <= {most} THEN x // 100 ELSE 2147483647 END)::INT AS distance FROM b"""


def _lv_sql(spans: str) -> str:
    """The least distance, of its spans the one with the least end, then the least start."""
    return f""", b AS (SELECT read_index, min(levenshtein(query, substr(target, i::INT, (j - i + 1)::INT)) * 10000 + j * 100 + i) AS x FROM a, {spans} GROUP BY 1)
    SELECT read_index, (x % 100 - 1)::INT AS start, (x // 100 % 100 - 1)::INT AS "end", (x // 10000)::INT AS distance FROM b"""


@_query(_WHOLE + _hm_sql(32, 24))
def align_hm_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, max_distance=24, boundary="starts", distance_metric="hm")


@_query(_BARCODE + _hm_sql(5, 1, 28))
def align_hm_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, max_distance=1, boundary="contains", distance_metric="hm")


@_query(_WHOLE + _hm_sql(32, 24))
def align_hm_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, max_distance=24, boundary="global", distance_metric="hm")


@_query(_WHOLE + _lv_sql("range(1, 2) t(i), range(1, 33) u(j)"))
def align_lv_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, boundary="starts", distance_metric="lv")


@_query(_WHOLE + _lv_sql("(SELECT i, j FROM range(1, 33) t(i), range(1, 33) u(j) WHERE i <= j)"))
def align_lv_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, boundary="contains", distance_metric="lv")


@_query(_WHOLE + _lv_sql("range(1, 2) t(i), range(32, 33) u(j)"))
def align_lv_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _align(spark, sf_dir, boundary="global", distance_metric="lv")


@_query("SELECT 'even.fastq' AS output, read_index, 0 AS ord, name, seq, qual FROM r1 WHERE read_index % 2 = 0")
def kernel_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.run_records(singles(spark, sf_dir), kernels.even_reads("even.fastq"))


@_query("SELECT 'gc.fastq' AS output, read_index, 0 AS ord, name, seq, qual FROM r1 WHERE (length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE BETWEEN 0.35 AND 0.65")
def kernel_gc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.run_records(singles(spark, sf_dir), kernels.gc_between("gc.fastq"))


@_query("SELECT 'head.fastq' AS output, read_index // 1000 * 1000 AS read_index, (read_index % 1000)::INT AS ord, name, substr(seq, 1, 10) AS seq, substr(qual, 1, 10) AS qual FROM r1")
def kernel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def head(reads, index):
        r = reads["read1"]
        return {"head.fastq": r.assign(seq=r["seq"].str[:10], qual=r["qual"].str[:10])}

    return kernels.run_blocks(singles(spark, sf_dir), head, kernels.RunConfig.current(blocksize=1000))


@_query("SELECT * FROM r1")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's batches are encoded as blocks and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = zip(*([x.encode("latin-1") for x in b.column(c).to_pylist()] for c in ("name", "seq", "qual")), strict=True)
            blocks = [container.decode_block(f := io.BytesIO(raw), container.read_block_header(f)) for raw in container.encode_blocks(rows, 4096, 3)]
            cols = [pa.array([x for d in blocks for x in d[c]], pa.string()) for c in ("name", "seq", "qual")]
            yield pa.RecordBatch.from_arrays([b.column("read_index"), *cols], names=["read_index", "name", "seq", "qual"])

    return _flat(singles(spark, sf_dir)).mapInArrow(run, "read_index long, name string, seq string, qual string")
