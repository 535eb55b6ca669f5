"""Members and frames that tasks read apart, and text that is cut and made column by column."""

import gzip
import io
import json

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from strandmill.plans import api
from strandmill.sources import container, datasource, text

FORMS = [".fastq.gz", ".fastq.zst"]


def lines(n, first=0):
    return b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ACGT" * (1 + i % 5), b"I@#+" * (1 + i % 5)) for i in range(first, first + n))


def put(path, pieces, monkeypatch):
    """A file with a member or frame for each piece."""
    with monkeypatch.context() as m:
        m.setattr(text, "MEMBER_BYTES", 1)
        form = text.kind(str(path))
        data = b"".join(pieces) if form == "plain" else b"".join(text.compress(iter(pieces), form, 6, 3))
    path.write_bytes(data)
    return str(path)


def names(batches, column="name"):
    return [(i, x) for b in batches for i, x in zip(b.column("read_index").to_pylist(), b.column(column).to_pylist(), strict=True)]


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_columns_are_those_of_the_parser(size):
    for raw in (b"", lines(40), lines(3)[:-1], lines(3)[:-9], lines(2) + b"@x\nAC\n+\n", b"@\r\n\n\xe9\n\xff\n" * 3, lines(2) + b"\n", b"@a\nA\n+\nI\nx"):
        def all_of(read, raw=raw):
            try:
                return list(read(io.BytesIO(raw)))
            except ValueError as e:
                return str(e)

        assert all_of(lambda f: [r for _, c in text.columns(f, size=size) for r in zip(*(x.to_pylist() for x in c.values()), strict=True)]) == all_of(text.parse)


def test_what_is_not_asked_for_is_not_checked():
    found = text.columns(io.BytesIO(lines(2) + b"wrong\nA\n+\nI\n"))
    assert next(found)[0] == 2
    with pytest.raises(ValueError, match="wrong"):
        next(found)


@pytest.mark.parametrize("form", FORMS)
def test_tasks_read_members_apart(tmp_path, monkeypatch, form):
    path = put(tmp_path / f"a{form}", [lines(50), lines(30, 50), lines(20, 80)], monkeypatch)
    monkeypatch.setattr(datasource, "PART_BYTES", 1)
    reader = datasource.ReadsReader({"path": path})
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(0, 50), (50, 80), (80, 100)]
    assert [x for p in parts for x in names(reader.read(p))] == [(i, f"r{i}") for i in range(100)]
    some = datasource.ReadsReader({"path": path} | datasource.Wanted(55, 60).options())
    assert [p.first for p in some.partitions()] == [50] and names(some.read(some.partitions()[0]))[-1] == (59, "r59")


@pytest.mark.parametrize("form", FORMS)
def test_any_reader_reads_them_and_others_are_read_as_one(spark, tmp_path, monkeypatch, form):
    path = put(tmp_path / f"a{form}", [lines(50), lines(50, 50)], monkeypatch)
    raw = open(path, "rb").read()
    plain = gzip.decompress(raw) if form == ".fastq.gz" else zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain == lines(100)
    foreign = (gzip.compress if form == ".fastq.gz" else zstandard.ZstdCompressor().compress)(lines(9, 100))
    for k, (data, n) in enumerate(((raw, 100), (raw + foreign, 109), (foreign + raw, 109), (foreign, 9))):
        (own := tmp_path / f"b{k}{form}").write_bytes(data)
        assert len(text.members(str(own))) == 2 * (n == 100)
        assert datasource.count(spark, str(own)) == api.read(spark, str(own)).count() == n
    # Lines that aren't those of whole records: no index, so that the file is read from its start.
    assert text.members(put(tmp_path / f"c{form}", [b"@a\nb\nA\n+\nI\n"], monkeypatch)) == []


def test_text_of_nulls_and_of_signs_beyond_ascii():
    own = [pa.array(x, pa.string()) for x in (["a", None, "\xe9"], ["AC", None, "N"], [None, "I", "\xff"])]
    assert text.encode(*own) == b"@a\nAC\n+\n\n@\n\n+\nI\n@\xe9\nN\n+\n\xff\n"
    assert text.encode(*(c[1:2] for c in own)) == b"@\n\n+\nI\n"
    assert text.encode(*(c[:0] for c in own)) == b""


def test_outputs_that_are_known_are_not_scanned_for(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fastq").write_bytes(lines(40))
    df = api.read(spark, str(tmp_path / "a.fastq"))
    monkeypatch.setattr(type(df), "distinct", lambda self: pytest.fail("scanned for its outputs"))
    api.write(df.where(F.col("read_index") < 20), str(tmp_path / "b.fastq.gz"))
    api.concat(spark, [str(tmp_path / "b.fastq.gz"), str(tmp_path / "a.fastq")], str(tmp_path / "c.fastq.zst"))
    with text.open_text(str(tmp_path / "c.fastq.zst")) as f:
        assert f.read() == lines(20) + lines(40)


def test_mates_of_members_are_read_span_by_span(tmp_path, monkeypatch):
    a = put(tmp_path / "a.fastq.gz", [lines(30), lines(30, 30), lines(40, 60)], monkeypatch)
    b = put(tmp_path / "b.fastq.zst", [lines(25), lines(25, 25), lines(25, 50), lines(18, 75)], monkeypatch)
    (tmp_path / f"c{container.SUFFIX}").write_bytes(container.HEADER + b"".join(container.encode_blocks(((b"c%d" % i, b"A", b"I") for i in range(97)), 10, 3)))
    monkeypatch.setattr(datasource, "PART_BYTES", 1)
    mates = [{"path": p, "splits": []} for p in (a, b, str(tmp_path / f"c{container.SUFFIX}"))]
    for low, high in ((0, None), (31, 77)):
        reader = datasource.MatesReader({"mates": json.dumps(mates)} | datasource.Wanted(low, high).options())
        spans = reader.partitions()
        got = [[x for s in spans for x in names(reader.read(s), f"name_{i}") if x[0] >= low] for i in range(3)]
        assert len(spans) > 1
        assert got == [[(i, f"{'c' if m == 2 else 'r'}{i}") for i in range(low, high or 93)] for m in range(3)]


def test_two_gzip_mates_make_many_tasks(tmp_path, monkeypatch):
    paths = [put(tmp_path / f"{m}.fastq.gz", [lines(20, 20 * k) for k in range(5)], monkeypatch) for m in "ab"]
    monkeypatch.setattr(datasource, "PART_BYTES", 1)
    reader = datasource.MatesReader({"mates": json.dumps([{"path": p, "splits": []} for p in paths])})
    assert [(s.first, s.last) for s in reader.partitions()] == [(0, 20), (20, 40), (40, 60), (60, 80), (80, None)]
    assert [x for s in reader.partitions() for x in names(reader.read(s), "name_1")] == [(i, f"r{i}") for i in range(100)]
