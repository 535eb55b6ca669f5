"""Pipes that don't go through the driver's memory."""

import os
import threading

import pytest

from strandmill.plans import api
from strandmill.sources import fifo


def lines(n):
    return b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ACGT" * (1 + i % 5), b"I@#+" * (1 + i % 5)) for i in range(n))


@pytest.mark.skipif(not fifo.supported(), reason="no named pipes")
def test_pipes_send_no_reads_to_the_driver(spark, tmp_path, monkeypatch):
    (tmp_path / "a.fastq").write_bytes(lines(5000))
    os.mkfifo(path := str(tmp_path / "p.fifo"))

    def no(*_, **__):
        raise AssertionError("reads were collected or sent from the driver")

    for at, name in ((type(spark.range(1)), "toLocalIterator"), (type(spark.range(1)), "collect"), (type(spark), "createDataFrame")):
        monkeypatch.setattr(at, name, no)
    got = []
    reader = threading.Thread(target=lambda: got.append(fifo.read(spark, path)), daemon=True)
    reader.start()
    api.write(api.read(spark, str(tmp_path / "a.fastq")), path)
    reader.join(60)
    monkeypatch.undo()
    assert [(r[0], r[1]) for r in got[0].select("read_index", "read1.name").orderBy("read_index").collect()] == [(i, f"r{i}") for i in range(5000)]


@pytest.mark.skipif(not fifo.supported(), reason="no named pipes")
def test_a_pipe_without_reads_ends(spark, tmp_path):
    os.mkfifo(path := str(tmp_path / "p.fifo"))
    (tmp_path / "none.fastq").write_bytes(b"")
    got = []
    reader = threading.Thread(target=lambda: got.append(fifo.read(spark, path).count()), daemon=True)
    reader.start()
    api.convert(spark, str(tmp_path / "none.fastq"), path)
    reader.join(60)
    assert got == [0]


@pytest.mark.skipif(not fifo.supported(), reason="no named pipes")
def test_a_wrong_name_in_a_pipe_fails_at_once(spark, tmp_path):
    os.mkfifo(path := str(tmp_path / "p.fifo"))
    feed = threading.Thread(target=lambda: open(path, "wb").write(lines(3) + b"wrong\nA\n+\nI\n"), daemon=True)
    feed.start()
    with pytest.raises(ValueError, match="Invalid FASTQ read name: wrong"):
        fifo.read(spark, path)
