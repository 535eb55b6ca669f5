"""Literal cases of every read operator, in memory."""

import functools
import random
import warnings

import pytest
from pyspark.sql import functions as F

from strandmill import RunConfig, options
from strandmill.functions import alignment, vectorised
from strandmill.functions import reads as R
from strandmill.operators import aggregates, kernels, profile, records
from strandmill.sources import generate, interop, memory


def frame(spark, *mates):
    return interop.from_table(spark, *[[(f"r{i}", s, q) for i, (s, q) in enumerate(m)] for m in mates])


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def seqs(df, mate="read1"):
    return [r[0] for r in df.orderBy("read_index").select(f"{mate}.seq").collect()]


def test_options():
    before = options("blocksize")
    assert options("blocksize", 7) == before and options("blocksize", before) == 7
    for bad in (0, 65536, 1.5):
        with pytest.raises(ValueError, match="blocksize"):
            options("blocksize", bad)
    with pytest.raises(ValueError, match="unknown option"):
        options("nothing")
    with pytest.raises(ValueError, match="limit"):
        RunConfig(limit=-1)


def test_downsample_and_slice(spark):
    df = frame(spark, [("ACGT", "IIII"), ("TGCA", "HHHH"), ("GGGG", "JJJJ")])
    assert seqs(records.downsample(df, 1)) == ["ACGT", "TGCA", "GGGG"]
    assert seqs(records.downsample(df, 0)) == []
    assert seqs(records.downsample(df, 0.5)) == ["TGCA"]
    with pytest.raises(ValueError, match="amount must between 0 and 1"):
        records.downsample(df, 1.1)
    assert seqs(records.slice_reads(df, limit=2)) == ["ACGT", "TGCA"]
    assert seqs(records.slice_reads(df, limit=0)) == []
    assert seqs(records.slice_reads(df, select=[2, 0, 0, 99])) == ["ACGT", "GGGG"]
    assert seqs(records.slice_reads(df, select=[*range(5000)][2:])) == ["GGGG"]


def test_quality_filter(spark):
    df = frame(spark, [("AAAA", "IIII"), ("CCCC", "!!!!"), ("GGGG", "$$$$"), ("", "")])
    assert seqs(records.quality_filter(df, 30, 0, 20)) == ["AAAA"]
    both = frame(spark, [("AAAA", "IIII"), ("AAAA", "IIII")], [("CCCC", "!!!!"), ("CC", "II")])
    assert seqs(records.quality_filter(both)) == ["AAAA"]


def test_chunk_and_route(spark):
    df = frame(spark, [("AAAAAA", "IIIIII")] * 6)
    got = counts(records.chunk(df, 2, ["o"], "gz").groupBy("output").count())
    assert got == {f"o_chunk{i}.fastq.gz": 2 for i in range(3)}
    with pytest.raises(ValueError, match="chunk_size must be >= 1"):
        records.chunk(df, 0, ["o"])
    assert records.route(df, [""]).count() == 0


def test_barcodes(spark):
    def labels(rows, *args, mates=(), **how):
        return counts(aggregates.count_barcodes(frame(spark, rows, *mates), ["ACG", "TTT", "AAC"], 0, *args, **how))

    assert labels([("ACGAAAA", "IIIIIII")]) == {"ACG": 1}
    assert labels([("TTTCCCC", "IIIIIII")]) == {"TTT": 1}
    assert labels([("GTTGGGG", "IIIIIII")], allow_revcomp=True) == {"AAC": 1}
    assert labels([("GTTGGGG", "IIIIIII")]) == {"NO_MATCH": 1}
    assert labels([("ACGTTT", "IIIIII")]) == {"MULTI_MATCH": 1}
    pair = frame(spark, [("ACGTTTT", "I" * 7)], [("GGACGTG", "I" * 7)])
    assert counts(aggregates.count_barcodes(pair, ["ACG", "ACG"], 0)) == {"ACG": 1}
    assert counts(aggregates.count_barcodes(frame(spark, [("CCATGCC", "I" * 7), ("AC", "II")]), ["ACG"], 1)) == {"ACG": 1, "NO_MATCH": 1}
    with pytest.raises(ValueError, match="barcodes"):
        aggregates.count_barcodes(pair, [""])


def test_demux(spark):
    df = frame(spark, [("AATTTT", "IIIIII"), ("CCGGGG", "IIIIII"), ("GGGGGG", "IIIIII"), ("A", "I")])
    assert counts(records.demux(df, ["d_{barcode}.fq"], ["AA", "CC"], 0).groupBy("output").count()) == {"d_AA.fq": 1, "d_CC.fq": 1, "d_NO_MATCH.fq": 2}
    assert counts(records.demux(df, ["{barcode}"], ["AA", "AA"], 0).groupBy("output").count()) == {"MULTI_MATCH": 1, "NO_MATCH": 3}
    with pytest.raises(ValueError, match="barcode"):
        records.demux(df, ["d.fq"], ["AA"])


def test_trim_adapters(spark):
    df = frame(spark, [("AAACCC", "IIIIII"), ("GGGGGG", "IIIIII"), ("AAA", "III")])
    assert seqs(records.trim_adapters(df, ["AAA"], 0)) == ["CCC", ""]
    assert seqs(records.trim_adapters(df, ["AAA"], 0, filter_untrimmed=False)) == ["CCC", "GGGGGG", ""]
    assert counts(records.adapter_counts(df, ["AAA"], 0)) == {"AAA": 2, "NO_ADAPTER": 1}
    assert seqs(records.trim_adapters(frame(spark, [("AAT", "III")]), ["AAAAA", "AAC"], 1)) == [""]
    with pytest.raises(Exception, match="sequence and quality lengths differ"):
        records.trim_adapters(frame(spark, [("AAACCC", "I")]), ["AAA"], 0).collect()


def test_merge_pairs(spark):
    df = frame(spark, [("ACGTAC", "I" * 6), ("AAAAAA", "I" * 6)], [("GTACGT", "I" * 6), ("CCCCCC", "I" * 6)])
    merged = records.merge_pairs(df, 3, 0)
    assert seqs(records.merged_reads(merged)) == ["ACGTAC"]
    assert seqs(records.unmerged_pairs(merged), "read2") == ["CCCCCC"]
    stats = records.merge_stats(merged).first()
    assert (stats["merged_reads"], stats["unmerged_reads"], stats["mean_insert_size"], stats["sd_insert_size"], stats["mean_overlap"], stats["mean_mismatch_rate"]) == (1, 1, 6.0, None, 6.0, 0.0)
    none = records.merge_stats(records.merge_pairs(df.where("read_index = 1"), 3, 0)).first()
    assert none["merged_reads"] == 0 and none["mean_overlap"] is None
    with pytest.raises(Exception, match="sequence and quality lengths differ"):
        records.merge_pairs(frame(spark, [("ACGTAC", "III")], [("GTACGT", "I" * 6)])).collect()


@pytest.mark.parametrize(("mode", "seq", "qual"), [("max", b"AACGG", b"5I5I5"), ("mean", b"AACGG", b"5?5?5"), ("r1", b"AACGG", b"5I555"), ("r2", b"AATGG", b"555I5")])
def test_consensus(mode, seq, qual):
    # ACG of one read overlaps ATG of the other.
    assert vectorised.consensus(b"AACG", b"5I55", b"ATGG", b"55I5", 3, mode, True) == (seq, qual)
    assert vectorised.consensus(b"AACG", b"5I55", b"ATGG", b"55I5", 3, mode, False) == (seq[1:4], qual[1:4])


def test_overlap_native_and_vectorised(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("ACGTN") for _ in range(rng.randrange(16))), "".join(rng.choice("ACGTN") for _ in range(rng.randrange(16)))) for _ in range(150)]
    rows += [(a, a[len(a) // 2 :] + b) for a, b in rows[:60]]
    df = spark.createDataFrame(rows, "a string, b string")
    for n_mismatches in (True, False):
        got = df.select(R.overlap_native("a", "b", 3, 0.2, n_mismatches).alias("n"), vectorised.overlap("a", "b", 3, 0.2, n_mismatches).alias("v")).collect()
        assert all(r["n"] == r["v"] for r in got) and any(r["v"] for r in got)


def test_mean_tie_goes_to_read_one():
    assert vectorised.consensus(b"A", b"I", b"C", b"I", 1, "max", True) == (b"A", b"I")


def test_summary(spark):
    out = aggregates.summary(frame(spark, [("ACGT", "IIII"), ("GGGG", "####"), ("AC", "I"), ("", "")]))
    b = out["basic_stats_R1"].first()
    assert (b["total_sequences"], b["total_bases"], b["seq_len_min"], b["seq_len_max"], b["gc_percent"]) == (2, 8, 4, 4, 75.0)
    assert counts(out["length_distribution_R1"]) == {4: 2}
    assert counts(out["avg_read_quality_R1"]) == {40: 1, 2: 1}
    assert {(r["position"], r["mean_q"], r["n"]) for r in out["per_base_quality_R1"].collect()} == {(i, 21.0, 2) for i in range(1, 5)}
    assert sorted((r["position"], r["base"], r["count"], r["fraction"]) for r in out["per_base_content_R1"].collect())[:2] == [(1, "A", 1, 0.5), (1, "G", 1, 0.5)]
    none = aggregates.basic_stats(aggregates.admitted(frame(spark, [("", "")]), "read1")).first()
    assert (none["total_sequences"], none["total_bases"], none["seq_len_min"], none["seq_len_mean"], none["gc_percent"]) == (0, 0, 0, None, None)
    pairs = frame(spark, [("ACGTAC", "I" * 6), ("AAAAAA", "I" * 6)], [("GTACGT", "I" * 6), ("CCCCCC", "I" * 6)])
    both = aggregates.summary(pairs, min_overlap=3, max_mismatch_rate=0)
    assert counts(both["insert_size"]) == {6: 1}
    assert both["basic_stats_R2"].first()["total_sequences"] == 2
    assert aggregates.summary(pairs, limit=1)["basic_stats_R1"].first()["total_sequences"] == 1
    assert counts(aggregates.summary(frame(spark, [("A", "h")]), phred33=False)["avg_read_quality_R1"]) == {40: 1}


def test_summary_in_one_scan(spark):
    rng = random.Random(5)
    read = lambda: ("".join(rng.choices("ACGTNacgß", k=(n := rng.choice((0, 1, 7, 30))))), "".join(chr(rng.randrange(33, 75)) for _ in range(n + rng.choice((0, 0, 0, 1)))))
    pairs = frame(spark, [*(read() for _ in range(200)), ("ACGTACGTACGTAC", "I" * 14), (None, None)], [*(read() for _ in range(200)), ("GTACGTACGTACGT", "I" * 14), ("AC", "II")])
    cases = [(pairs, {}), (pairs, {"phred33": False}), (pairs.select("read_index", "read1"), {"limit": 9}), (pairs.where("read_index < 0"), {}), (frame(spark, [("", "")]), {})]
    for df, how in cases:
        one, each = profile.summary(df, **how), aggregates.summary(df, **how)
        assert list(one) == list(each)
        for name, t in each.items():
            assert [(f.name, f.dataType) for f in one[name].schema] == [(f.name, f.dataType) for f in t.schema], name
            assert sorted(map(repr, one[name].collect())) == sorted(map(repr, t.collect())), name
    plan = profile.profile(pairs, min_overlap=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_scalars(spark):
    row = spark.range(1).select(
        R.reverse_complement(F.lit("AcgTNRU")).alias("rc"), R.phred(F.lit("I! ")).alias("q"), R.phred(F.lit("")).alias("none"), R.ends_with(F.lit("a.gz"), ".gz").alias("gz"),
        R.zip_pairs(F.array(F.lit(1), F.lit(2)), F.array(F.lit("a"))).alias("z"), R.trim_read(F.struct(F.lit("n").alias("name"), F.lit("ACGT").alias("seq"), F.lit("IHGF").alias("qual")), 1, 3).alias("t"),
    ).first()
    assert (row["rc"], row["q"], row["none"], row["gz"], len(row["z"]), tuple(row["t"])) == ("URNAcgT", [40, 0, 0], [], True, 1, ("n", "CG", "HG"))
    bad = F.struct(F.lit("n").alias("name"), F.lit("ACGT").alias("seq"), F.lit("IHG").alias("qual"))
    for c in (R.trim_read(bad, 1, 5), R.trim_read(bad, 3, 2), R.checked(bad)):
        with pytest.raises(Exception, match="outside the read|lengths differ"):
            spark.range(1).select(c).collect()


MAX = 2147483647


@pytest.mark.parametrize(
    ("query", "target", "how", "want"),
    [
        ("ACGT", "ACGG", {"distance_metric": "hm", "boundary": "global", "max_distance": 1}, (0, 3, 1)),
        ("ACGT", "ACG", {"distance_metric": "hm", "boundary": "global"}, (0, 0, MAX)),
        ("ACG", "TTACCACG", {"distance_metric": "hm", "boundary": "contains"}, (5, 7, 0)),
        ("ACG", "ACCACT", {"distance_metric": "hamming", "boundary": "contains"}, (0, 2, 1)),
        ("", "ACC", {"distance_metric": "hm", "boundary": "starts"}, (0, 0, 0)),
        ("ACGTACGT", "ACC", {"distance_metric": "hm", "boundary": "starts"}, (0, 0, MAX)),
        ("ANG", "ATG", {"distance_metric": "hm", "boundary": "starts", "ambiguity_base": "N"}, (0, 2, 0)),
        ("TTT", "GTTTGG", {}, (1, 3, 0)),
        ("ACGTNT", "ACGTAT", {"ambiguity_base": "NX"}, (0, 5, 0)),
        ("ACGT", "AGT", {"boundary": "global", "distance_metric": "levenshtein"}, (0, 2, 1)),
        ("ACGT", "ACGTTT", {"boundary": "starts"}, (0, 3, 0)),
        ("", "AC", {"boundary": "contains"}, (0, 0, MAX)),
        ("AC", "", {"boundary": "global"}, (0, 0, MAX)),
        ("AAAA", "TTTT", {"max_distance": 2}, (0, 0, MAX)),
    ],
)
def test_align(spark, query, target, how, want):
    row = alignment.align_frame(spark.createDataFrame([(query, target)], "query string, target string"), **how).first()
    assert (row["start"], row["end"], row["distance"]) == want


def test_align_arguments(spark):
    with pytest.raises(ValueError, match="boundary"):
        alignment.align("a", "b", boundary="ends")
    with pytest.raises(ValueError, match="distance_metric"):
        alignment.align("a", "b", distance_metric="x")


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row


def test_edit_distance_by_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        q = "".join(rng.choice("ACG") for _ in range(rng.randrange(1, 8)))
        t = "".join(rng.choice("ACG") for _ in range(rng.randrange(1, 10)))
        assert vectorised.edit_align(q, t, MAX, "", "global")[2] == _edit(q, t)[-1]
        start, end, d = vectorised.edit_align(q, t, MAX, "", "starts")
        assert (start, d) == (0, min(_edit(q, t)[1:])) and _edit(q, t[: end + 1])[-1] == d
        start, end, d = vectorised.edit_align(q, t, MAX, "", "contains")
        assert d == min(_edit(q, t[i:j])[-1] for i in range(len(t)) for j in range(i + 1, len(t) + 1))
        assert _edit(q, t[start : end + 1])[-1] == d


def test_concat_and_zip(spark):
    a, b = frame(spark, [("A", "I"), ("C", "I")]), frame(spark, [("G", "I")])
    assert seqs(records.concat([a, b, a])) == ["A", "C", "G", "A", "C"]
    assert seqs(records.zip_mates(a, b), "read2") == ["G"]
    with pytest.raises(ValueError, match="at least one input"):
        records.concat([])
    with pytest.warns(UserWarning, match="excess reads from inputs: 0"):
        assert records.excess_inputs([6, 3]) == [0]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert records.excess_inputs([3, 3]) == []


def test_block_kernels(spark):
    df = frame(spark, [("ACGT", "IIII")] * 7)

    def even(reads, index):
        return {"e": reads["read1"][[i % 2 == 0 for i in index]]}

    for mode in ("blocks", "batches", "driver"):
        out = kernels.run_blocks(df, even, RunConfig(blocksize=3, limit=5), mode)
        assert sorted(r["name"] for r in out.collect()) == ["r0", "r2", "r4"]
    seen = []
    kernels.run_blocks(df, lambda reads, index: seen.append(index), RunConfig(blocksize=3), "driver")
    assert seen == [[0, 1, 2], [3, 4, 5], [6]]
    assert kernels.run_records(df, kernels.even_reads("e"), RunConfig(limit=5)).count() == 3
    assert kernels.run_records(df, kernels.gc_between("g")).count() == 7


def test_kernel_results():
    import pandas as pd

    good = pd.DataFrame({"name": ["a"], "seq": ["AC"], "qual": ["II"]})
    assert kernels.check_result(None) == {}
    assert len(kernels.check_result([("x", good), ("x", good), ("y", None)])["x"]) == 2
    for bad in ({}, [], good, "x", [good]):
        with pytest.raises(TypeError, match="named list of data frames"):
            kernels.check_result(bad)
    for bad in ({"": good}, {"x": good.drop(columns="qual")}, {"x": good.assign(seq=[None])}, {"x": good.assign(seq=["A"])}):
        with pytest.raises((TypeError, ValueError)):
            kernels.check_result(bad)


def test_memory(spark):
    df = frame(spark, [("ACGT", "IIII")] * 12)
    assert memory.put("k.mem", df) == 12 and memory.put("k.mem", df) == 24
    assert {r["mem_key"]: r["n_reads"] for r in memory.listing(spark).collect()} == {"k.mem": 24}
    assert [r[0] for r in memory.read(spark, "k.mem").select("read_index").orderBy("read_index").collect()] == list(range(24))
    assert memory.remove(["k.mem", "none.mem"]) == [True, False]
    with pytest.raises(KeyError, match="not found"):
        memory.read(spark, "k.mem")
    with pytest.raises(ValueError, match=r"\.mem"):
        memory.put("k", df)


def test_generator(spark):
    df = generate.random_reads(spark, 200, 60, paired=True, seed=3)
    rows = df.collect()
    assert len({r["read1"]["seq"] for r in rows}) == 200
    assert all(len(r[m]["seq"]) == len(r[m]["qual"]) == 60 and set(r[m]["seq"]) <= set("ACGT") for r in rows for m in ("read1", "read2"))
    assert all(35 <= ord(c) <= 74 for r in rows for c in r["read1"]["qual"])
    assert rows == generate.random_reads(spark, 200, 60, paired=True, seed=3).repartition(5).orderBy("read_index").collect()
    found = records.merge_pairs(df, 12, 0).where("merge.overlap > 0").count()
    assert 50 < found < 150
    assert generate.random_reads(spark, 0).count() == 0


def test_patterns_within_agrees_with_the_native_form(spark):
    rows = [("ACGTACGTTGCA", "TTTT"), ("", "ACGTT"), ("GGGGGGG", "CCACGTA"), ("ACG", "NNNNNNNN")]
    df = spark.createDataFrame(rows, "a string, b string")
    forms = {"ACGTA": ["ACGTA", "TACGT"], "TTTT": ["TTTT", "AAAA"], "GGG": ["GGG"]}
    for d in (1, 2):
        native = [F.when(functools.reduce(lambda x, y: x | y, (R.matches_within(f, c, d) for c in ("a", "b") for f in own)), F.lit(n)) for n, own in forms.items()]
        got = df.select(vectorised.patterns_within([F.col("a"), F.col("b")], forms, d).alias("x"), F.filter(F.array(*native), lambda v: v.isNotNull()).alias("y")).collect()
        assert all(r.x == r.y for r in got)
