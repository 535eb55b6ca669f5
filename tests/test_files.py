"""Formats, file-to-file runs, pipes and streams."""

import gzip
import hashlib
import io
import os
import threading

import pytest
import zstandard
from pyspark.sql import functions as F

from strandmill import RunConfig
from strandmill.operators import kernels, records
from strandmill.plans import api
from strandmill.sources import container, datasource, fifo, generate, interop, memory, text
from strandmill.streaming import files

C = container.SUFFIX


def fastq(rows):
    return b"".join(b"@%s\n%s\n+\n%s\n" % r for r in rows)


def sample(n, length=20, first=0):
    return [(b"r%d" % i, bytes(b"ACGT"[(i * 7 + k * k) % 4] for k in range(length)), bytes(33 + (i + k) % 40 for k in range(length))) for i in range(first, first + n)]


def put(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def content(path):
    with text.open_text(str(path)) as f:
        return f.read()


def digest(path):
    return hashlib.md5(content(path)).hexdigest()


def test_round_trip_through_all_forms(spark, tmp_path):
    first = put(tmp_path / "a.fastq", fastq(sample(24)))
    at = first
    for name in ("b.fastq.gz", f"c{C}", "d.fastq.zst", "e.mem", "f.fastq"):
        to = name if name.endswith(".mem") else str(tmp_path / name)
        api.convert(spark, at, to)
        at = to
    assert memory.remove("e.mem") == [True]
    assert digest(at) == digest(first)
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".")]


def test_small_blocks(spark, tmp_path):
    first = put(tmp_path / "a.fastq", fastq(sample(24)))
    config = RunConfig(blocksize=7)
    df = datasource.read_reads(spark, [first])
    api.write(df, str(tmp_path / f"a{C}"), config)
    with open(tmp_path / f"a{C}", "rb") as f:
        blocks = container.index_blocks(f)
    assert sum(b.num_reads for b in blocks) == 24 and max(b.num_reads for b in blocks) <= 7
    back = datasource.read_reads(spark, [str(tmp_path / f"a{C}")])
    assert back.orderBy("read_index").collect() == df.orderBy("read_index").collect()
    few = back.where("read_index >= 8 and read_index < 10")
    assert [r["read1"]["name"] for r in few.orderBy("read_index").collect()] == ["r8", "r9"]
    assert [r[0] for r in back.where(F.col("read_index").isin(3, 23)).select("read_index").orderBy("read_index").collect()] == [3, 23]
    seqs = datasource.read_mate(spark, str(tmp_path / f"a{C}"), columns=("seq",)).where("read_index = 5").first()
    assert seqs["seq"] == sample(24)[5][1].decode() and seqs["name"] is None


def test_blocks_outside_a_filter_are_not_read(tmp_path):
    raw = container.HEADER + b"".join(container.encode_blocks(iter(sample(20)), 4, 3))
    path = put(tmp_path / f"x{C}", raw)
    blocks = lambda **wanted: [(p.first, len(p.blocks)) for p in datasource.ReadsReader({"path": path} | datasource.Wanted(**wanted).options()).partitions()]
    assert blocks(low=8, high=12) == [(8, 1)]
    assert blocks(low=1, high=18, listed=[1, 17]) == [(0, 1), (16, 1)]


@pytest.mark.parametrize("split", [64, 100, 333, 1000])
def test_split_plain_files(spark, tmp_path, split):
    # Names, separators and qualities that look like headers.
    rows = [(b"n%d" % i, b"A" * (i % 9 + 1), b"@" * (i % 9 + 1)) for i in range(60)]
    path = put(tmp_path / "s.fastq", fastq(rows))
    df = datasource.read_reads(spark, [path], split_bytes=split)
    got = df.orderBy("read_index").collect()
    assert [r["read_index"] for r in got] == list(range(60))
    assert [tuple(x.encode() for x in r["read1"]) for r in got] == rows


def test_parser():
    parse = lambda raw: list(text.parse(io.BytesIO(raw)))
    assert parse(b"@a\nAC\nanything\nII") == [("a", "AC", "II")]
    assert parse(b"@a\nAC\n+\nII\n@b\nAC\n") == [("a", "AC", "II")]
    assert parse(b"@a\r\nAC\n+\nI\xe9\n") == [("a\r", "AC", "I\xe9")]
    assert parse(b"") == []
    for bad in (b"a\nAC\n+\nII\n", b"@a\nAC\n+\nII\n\n@b\n"):
        with pytest.raises(ValueError, match="Invalid FASTQ read name"):
            parse(bad)


@pytest.mark.parametrize(("name", "what"), [("x.gz", "valid gzip"), ("x.zst", "valid zstd")])
def test_wrong_magic(tmp_path, name, what):
    for data in (b"@a\nAC\n+\nII\n", b"\x1f", b""):
        with pytest.raises(ValueError, match=what):
            text.open_text(put(tmp_path / name, data))


def test_members_and_frames(tmp_path):
    a, b = fastq(sample(3)), fastq(sample(2, first=3))
    assert content(put(tmp_path / "m.gz", gzip.compress(a) + gzip.compress(b))) == a + b
    z = zstandard.ZstdCompressor().compress
    assert content(put(tmp_path / "m.zst", z(a) + z(b))) == a + b


def corrupt(at, value):
    raw = bytearray(container.HEADER + container.encode_block([b"a"], [b"AC"], [b"II"]))
    raw[at] = value
    return bytes(raw)


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        (bytes(4), "valid"), (corrupt(5, 1), "header flags|valid"), (corrupt(14, 1), "big-endian"), (corrupt(15, 2), "version"), (container.HEADER + b"\0\0\0\x80", "block metadata flags"),
        (container.HEADER + bytes(4) + bytes(9), "block read count"), (container.HEADER + b"\2\0\0\0" + (65536).to_bytes(4, "little") + bytes(8), "block read count"),
        (container.HEADER + b"\3\0\0\0" + b"\xff" * 8 + bytes(8), "block read count"), (corrupt(22, 9), "sequence payload size mismatch"), (container.HEADER + b"\0\0", "truncated"),
    ],
)
def test_corrupt_containers(raw, error):
    def load():
        f = io.BytesIO(raw)
        for b in container.index_blocks(f):
            container.decode_block(f, b)

    with pytest.raises(ValueError, match=error):
        load()


def test_container_contents():
    rows = [(b"pre1", b"ACGTN", b"IIIII"), (b"pre2xx", b"", b""), (b"pre", b"acg", b"\xff!~")]
    for level, own in ((3, rows), (3, rows[:2]), (20, rows[:2])):
        raw = container.encode_block(*map(list, zip(*own, strict=True)), level)
        f = io.BytesIO(raw)
        block = container.read_block_header(f)
        assert block.packed == (level <= 19 and len(own) == 2) and block.prefix_size == 3
        got = container.decode_block(f, block)
        assert [tuple(x.encode("latin-1") for x in r) for r in zip(got["name"], got["seq"], got["qual"], strict=True)] == own
    with pytest.raises(ValueError, match="sequence and quality lengths differ"):
        container.encode_block([b"a"], [b"A"], [b"II"])


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = interop.from_table(spark, [("a", "A", "II")])
    with pytest.raises(Exception, match="sequence and quality lengths differ"):
        api.write(bad, str(tmp_path / f"x{C}"))
    assert not os.path.exists(tmp_path / f"x{C}")
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(C)]


def test_runs_from_file_to_file(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    put(p("1.fastq"), fastq(sample(10)))
    put(p("2.fastq"), fastq(sample(10)))
    api.downsample(spark, [p("1.fastq"), p("2.fastq")], [p("d1.fastq"), p("d2.fastq.gz")], 0.5)
    assert content(p("d1.fastq")) == content(p("d2.fastq.gz")) and content(p("d1.fastq")).count(b"\n") == 20
    api.downsample(spark, p("1.fastq"), p("none.fastq"), 0)
    assert not os.path.exists(p("none.fastq"))
    api.slice_reads(spark, p("1.fastq"), p("s.fastq"), select=[0, 2])
    assert content(p("s.fastq")) == fastq([sample(10)[0], sample(10)[2]])
    api.chunk(spark, p("1.fastq"), p("k"), "fastq", 4)
    assert [content(p(f"k_chunk{i}.fastq")).count(b"@r") for i in range(3)] == [4, 4, 2]
    api.demux(spark, p("1.fastq"), p("x_{barcode}.fastq"), ["A", "C"], 0)
    assert sum(content(p(f)).count(b"\n+\n") for f in os.listdir(tmp_path) if f.startswith("x_")) == 10
    counts = {r[0]: r[1] for r in api.trim_adapters(spark, p("1.fastq"), p("t.fastq"), ["A"], 0).collect()}
    assert sum(counts.values()) == 10 and content(p("t.fastq")).count(b"\n+\n") == counts["A"]
    api.quality_filter(spark, p("1.fastq"), p("q.fastq"), 15, 100, 20)
    assert content(p("q.fastq")) == fastq(sample(10)[6:])
    api.concat(spark, [p("1.fastq"), p("d2.fastq.gz"), p("2.fastq")], p("all.fastq.zst"))
    assert content(p("all.fastq.zst")) == content(p("1.fastq")) + content(p("d2.fastq.gz")) + content(p("2.fastq"))
    put(p("empty.fastq"), b"")
    api.concat(spark, [p("empty.fastq")], p("empty2.fastq"))
    assert content(p("empty2.fastq")) == b""
    assert api.count_barcodes(spark, p("1.fastq"), ["ACGT"], 0).agg(F.sum("count")).first()[0] == 10
    with pytest.raises(ValueError, match="single file"):
        api.concat(spark, [p("1.fastq")], [p("a"), p("b")])
    with pytest.raises(ValueError, match="same length"):
        api.convert(spark, [p("1.fastq")], [p("a"), p("b")])
    with pytest.warns(UserWarning, match="excess reads from inputs: 0"):
        assert api.report_excess(spark, [p("1.fastq"), p("s.fastq")]) == [0]


def test_merge_from_files(spark, tmp_path):
    out = [str(tmp_path / f"{i}.fastq") for i in (1, 2)]
    api.generate_random(spark, out, 60, 50)
    stats = api.merge_pairs(spark, out, str(tmp_path / "m.fastq"), [str(tmp_path / "u1.fastq"), str(tmp_path / "u2.fastq")], min_overlap=12).first()
    assert stats["merged_reads"] + stats["unmerged_reads"] == 60
    assert content(tmp_path / "m.fastq").count(b"\n+\n") == stats["merged_reads"]
    assert content(tmp_path / "u2.fastq").count(b"\n+\n") == stats["unmerged_reads"]
    assert "insert_size" in api.summary(spark, out)
    with pytest.raises(ValueError, match="plain or as gzip"):
        api.generate_random(spark, "x.fastq.zst", 1)


def test_kernels_to_files(spark, tmp_path):
    path = put(tmp_path / "a.fastq", fastq(sample(7)))
    out = str(tmp_path / "e.fastq")

    def even(reads, index):
        return {out: reads["read1"][[i % 2 == 0 for i in index]]}

    api.run_kernel(spark, path, even, limit=5, config=RunConfig(blocksize=3, limit=5))
    assert content(out) == fastq(sample(7)[0:5:2])

    def failing(reads, index):
        if index[0] >= 3:
            raise RuntimeError("kernel gave up")
        return {str(tmp_path / "f.fastq"): reads["read1"]}

    with pytest.raises(Exception, match="kernel gave up"):
        api.run_kernel(spark, path, failing, config=RunConfig(blocksize=3))
    assert not os.path.exists(tmp_path / "f.fastq")
    api.run_record_kernel(spark, path, kernels.even_reads(str(tmp_path / "r.fastq")))
    assert content(tmp_path / "r.fastq").count(b"\n+\n") == 4
    assert "def kernel" in open(kernels.write_kernel_template(str(tmp_path / "k.py"))).read()


@pytest.mark.skipif(not fifo.supported(), reason="no named pipes")
def test_pipes(spark, tmp_path):
    source = put(tmp_path / "a.fastq", fastq(sample(30)))
    pipes = [str(tmp_path / f"{i}.fifo") for i in (1, 2)]
    for p in pipes:
        os.mkfifo(p)
    got = {}

    def drain(p):
        with open(p, "rb") as f:
            got[p] = f.read()

    threads = [threading.Thread(target=drain, args=(p,)) for p in pipes]
    for t in threads:
        t.start()
    api.convert(spark, [source, source], pipes)
    for t in threads:
        t.join(30)
    assert got[pipes[0]] == got[pipes[1]] == fastq(sample(30))
    feed = threading.Thread(target=lambda: put(pipes[0], fastq(sample(5))))
    feed.start()
    df = datasource.read_reads(spark, [pipes[0]])
    feed.join(30)
    assert df.count() == df.count() == 5
    with pytest.raises(OSError, match="not a FIFO"):
        fifo.Pipe(source)


def test_interop(spark):
    pair = interop.from_table(spark, [("a", "AC", "II")], [("b", "GT", "HH")])
    tables = interop.to_tables(pair)
    assert [t.iloc[0].tolist() for t in tables] == [["a", "AC", "II"], ["b", "GT", "HH"]]
    assert interop.to_tables(interop.from_table(spark, tables[0])).equals(tables[0])


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.fastq", fastq(sample(6)))
    put(tmp_path / "in" / "b.fastq.gz", gzip.compress(fastq(sample(4))))
    query = files.process_folder(
        spark, str(tmp_path / "in"), lambda df: records.slice_reads(df, limit=3), lambda df, path: api.write(df, str(tmp_path / (os.path.basename(path).split(".")[0] + ".out"))), str(tmp_path / "check")
    )
    query.awaitTermination(120)
    assert [content(tmp_path / f"{n}.out") for n in "ab"] == [fastq(sample(3))] * 2


def test_running_counts(spark, tmp_path):
    generate.random_reads(spark, 50, 30).select("read1.*").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("name string, seq string, qual string").parquet(str(tmp_path / "t"))
    q = files.running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("running_counts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running_counts").collect()] == [(30, 50, 1500)]


def test_memory_indices_stay_gapless(spark):
    from strandmill.sources import memory

    some = spark.range(40).selectExpr("id as read_index", "named_struct('name', cast(id as string), 'seq', 'A', 'qual', 'I') as read1")
    try:
        for part in (some.where("read_index in (7, 9)"), some.where("read_index < 10"), some.where("read_index > 37")):
            memory.put("gaps.mem", part)
        got = memory.read(spark, "gaps.mem").selectExpr("read_index", "read1.name").orderBy("read_index").collect()
        assert [r[0] for r in got] == list(range(14)) and [r[1] for r in got] == ["7", "9", *map(str, range(10)), "38", "39"]
    finally:
        memory.remove("gaps.mem")


@pytest.mark.parametrize("suffix", ["fastq", "fastq.gz", "fastq.zst", C[1:], "mem"])
def test_concat_of_nothing_makes_an_output(spark, tmp_path, suffix):
    empty = tmp_path / "empty.fastq"
    empty.write_bytes(b"")
    out = f"nothing.{suffix}" if suffix == "mem" else str(tmp_path / f"out.{suffix}")
    api.concat(spark, [str(empty), str(empty)], out)
    assert api.read(spark, out).count() == 0
    api.mem_remove("nothing.mem")


def test_a_kernel_is_called_once_for_a_block(spark, tmp_path):
    reads = "".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(30))
    (tmp_path / "in.fastq").write_text(reads)
    calls = tmp_path / "calls"

    def kernel(reads, index):
        with open(calls, "a") as f:
            f.write(f"{index[0]}\n")
        return {str(tmp_path / "out.fastq"): reads["read1"]}

    from strandmill.config import RunConfig

    api.run_kernel(spark, str(tmp_path / "in.fastq"), kernel, config=RunConfig(blocksize=10))
    assert sorted(calls.read_text().split()) == ["0", "10", "20"]
    assert (tmp_path / "out.fastq").read_text() == reads


def test_a_failed_task_leaves_no_part(spark, tmp_path):
    bad = spark.range(20).selectExpr(f"'{tmp_path}/out.fastq' as output", "id as read_index", "0 as ord", "'n' as name", "if(id = 13, '☃', 'A') as seq", "'I' as qual")
    with pytest.raises(Exception, match="latin"):
        api.write_routed(bad)
    assert list(tmp_path.iterdir()) == []


def test_excess_reads_are_reported(spark, tmp_path):
    for name, n in (("a", 3), ("b", 5)):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(n)))
    with pytest.warns(UserWarning, match="detected excess reads from inputs: 1"):
        api.convert(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq")], [str(tmp_path / "c.fastq"), str(tmp_path / "d.fastq")])


def test_nulls_count_as_empty(spark):
    from strandmill.functions import alignment
    from strandmill.operators import aggregates

    df = spark.createDataFrame([(0, (None, None, None)), (1, ("n", "ACGT", "IIII"))], "read_index long, read1 struct<name:string,seq:string,qual:string>")
    for d in (0, 1):
        assert {r["barcode"]: r["count"] for r in aggregates.count_barcodes(df, ["ACG"], d).collect()} == {"NO_MATCH": 1, "ACG": 1}
    pairs = spark.createDataFrame([("A", None), (None, "A"), ("kitten", "sitting"), ("", "abc"), ("abc", "")], "q string, t string")
    for boundary in ("global", "starts", "contains"):
        got = [tuple(r) for r in pairs.select(alignment.align("q", "t", boundary=boundary).alias("a")).select("a.*").collect()]
        assert got[0] == got[4] == (0, 0, 2147483647)
        assert got[2] == ((0, 6, 3) if boundary == "global" else got[2]) and got[3] == ((0, 2, 3) if boundary == "global" else (0, 0, 2147483647))


@pytest.mark.parametrize("forms", [(".fastq", ".fastq"), (container.SUFFIX, container.SUFFIX, ".fastq"), (".fastq.gz", container.SUFFIX), (container.SUFFIX, ".fastq.zst")])
def test_mates_are_read_in_step(spark, tmp_path, forms):
    """Files of different lengths, block sizes and splits give the records of a join by position, without a shuffle."""
    paths = [str(tmp_path / f"m{i}{form}") for i, form in enumerate(forms)]
    for i, path in enumerate(paths):
        api.write(interop.from_table(spark, [(f"n{i}_{k}", "ACGT" * (i + 1), "I" * 4 * (i + 1)) for k in range(900 - 50 * i)]), path, RunConfig.current(blocksize=70 + 33 * i))
    own = datasource.read_reads(spark, paths, split_bytes=3000)
    joined = records.zip_mates(*(datasource.read_reads(spark, [p]) for p in paths))
    for low, high in ((0, None), (211, 640), (849, 850), (5000, None)):
        some = datasource.read_reads(spark, paths, split_bytes=3000, wanted=datasource.Wanted(low, high))
        assert some.orderBy("read_index").collect() == joined.where((F.col("read_index") >= low) & (F.col("read_index") < (high or 9999))).orderBy("read_index").collect()
    assert own.count() == 900 - 50 * (len(forms) - 1)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()


def test_mates_without_reads(spark, tmp_path):
    for name in ("a.fastq", f"b{container.SUFFIX}"):
        api.concat(spark, [put(tmp_path / "none.fastq", b"")], str(tmp_path / name))
    put(tmp_path / "c.fastq", fastq(sample(3)))
    for names in (("a.fastq", "c.fastq"), ("c.fastq", f"b{container.SUFFIX}")):
        assert api.read(spark, [str(tmp_path / n) for n in names]).count() == 0


@pytest.mark.parametrize("form", [".fastq", container.SUFFIX])
def test_filters_on_one_frame_do_not_meet(spark, tmp_path, form):
    api.write(interop.from_table(spark, [(f"n{k}", "ACGT", "IIII") for k in range(1000)]), path := str(tmp_path / f"m{form}"), RunConfig.current(blocksize=100))
    df = api.read(spark, path)
    assert df.where("read_index >= 900").count() == 100
    assert df.count() == 1000
    assert df.where("read_index < 100").union(df.where("read_index >= 950")).count() == 150
    api.slice_reads(spark, path, some := str(tmp_path / "some.fastq"), select=[999, 3, 500, 70_000])
    assert [r["read1"]["name"] for r in api.read(spark, some).orderBy("read_index").collect()] == ["n3", "n500", "n999"]
