"""Named pipes of plain FASTQ. They end at the driver, which streams between a pipe and zstd files that executors read and write.

Neither way are reads held in the driver's memory or sent to it as results of tasks. A pipe can be
read once, so what is read is kept in a file, until the process ends.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import threading
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from . import datasource, spool, text

#: What is kept for a moment is written fast.
_LEVEL = 1


def supported() -> bool:
    return hasattr(os, "mkfifo")


def _check(path: str | None = None) -> None:
    if not supported():
        raise OSError("named pipes are not supported on this platform")
    if path and os.path.lexists(path) and not stat.S_ISFIFO(os.stat(path).st_mode):
        raise OSError(f"path exists and is not a FIFO: {path}")


def _checked(blocks: Iterable[bytes], path: str) -> Iterator[bytes]:
    """The blocks, unless the name of a record is wrong."""
    for block in blocks:
        text.check_names(block, path)
        yield block


def read(spark: SparkSession, path: str) -> DataFrame:
    """All reads that come through the pipe, as a frame that later actions may scan again, in parallel."""
    _check()
    kept = f"{spool.folder(spark)}/reads.fastq.zst"
    with open(path, "rb") as f, open(kept, "wb") as out:
        for frame in text.compress(_checked(text.blocks(f, path), path), "zstd", 1, _LEVEL):
            out.write(frame)
    return datasource.read_mate(spark, kept).select("read_index", F.struct("name", "seq", "qual").alias("read1"))


class Pipe:
    """A writer with a thread of its own, so that one slow reader doesn't hold up other pipes; what it has not written yet stays where ``chunks`` come from."""

    def __init__(self, path: str, chunks: Iterable[bytes] = ()):
        _check(path)
        if not os.path.lexists(path):
            os.mkfifo(path)
        self.path, self.error, self._chunks, self._abandoned = path, None, chunks, False
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            with open(self.path, "wb") as f:
                for chunk in self._chunks:
                    if self._abandoned:
                        return
                    f.write(chunk)
        except BrokenPipeError:
            self.error = OSError(f"FIFO reader closed unexpectedly while writing: {self.path}")
        except Exception as e:
            self.error = e

    def abandon(self) -> None:
        """Write no more; the reader sees the end. A pipe that nobody has opened stays with its thread."""
        self._abandoned = True

    def close(self) -> None:
        """Wait until all is written."""
        self._thread.join()
        if self.error:
            raise self.error


def _chunks(path: str) -> Iterator[bytes]:
    with text.open_text(path) as f:
        while data := f.read(1 << 20):
            yield data


def write_routed(routed: DataFrame, outputs: list[str] | None = None) -> None:
    """Write routed rows, in order, to the pipes that are their outputs; ``outputs`` saves looking for these."""
    spark = routed.sparkSession
    outputs = outputs if outputs is not None else [r[0] for r in routed.select("output").distinct().collect()]
    for o in outputs:
        _check(o)
    folder, pipes = spool.folder(spark), []
    try:
        own = F.concat(F.lit(f"{folder}/"), F.md5(F.col("output").cast("binary")), F.lit(".fastq.zst"))
        datasource.write_routed(routed.withColumn("output", own), RunConfig.current(zstd_level=_LEVEL))
        for o in sorted(set(outputs)):
            if os.path.exists(kept := f"{folder}/{hashlib.md5(o.encode()).hexdigest()}.fastq.zst"):
                pipes.append(Pipe(o, _chunks(kept)))
            elif os.path.lexists(o):
                Pipe(o)  # whoever reads it sees the end
        for p in pipes:
            p.close()
    finally:
        for p in pipes:
            p.abandon()
        shutil.rmtree(folder, ignore_errors=True)
