"""Spark data source for reads: plain, gzip and zstd FASTQ, and the container.

Reading yields ``read_index, name, seq, qual``; of several mates, these by
mate, read in step. A range of ``read_index`` is an option of the source: container
blocks outside it are skipped and text is left where it ends. It isn't taken from
Spark's filters: Spark keeps what was pushed to a Python source with the frame, so
that another query on the same frame, or its other branch, would lose rows.
Large plain files are split by a distributed
newline count, so that every split knows its first record and its index; gzip and
zstd files of this writer by what their members and frames tell.
"""

from __future__ import annotations

import contextlib
import itertools
import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import container, text

FORMAT = "strandmill_reads"
_COLUMNS = ("name", "seq", "qual")
SCHEMA = "read_index long, name string, seq string, qual string"
_KINDS = {"read_index": pa.int64(), "name": pa.string(), "seq": pa.string(), "qual": pa.string()}
#: Plain files above this are split.
SPLIT_BYTES = 64 << 20
#: Compressed bytes of members, frames or blocks that a task reads.
PART_BYTES = 8 << 20


def _strings(values: list[str] | pa.Array) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, pa.string())


@dataclass
class Part(InputPartition):
    path: str
    first: int = 0
    start: int = 0
    end: int | None = None
    blocks: tuple[container.Block, ...] = ()


class ReadsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.columns = tuple(c for c in options.get("columns", ",".join(_COLUMNS)).split(",") if c in _COLUMNS)
        self.splits = json.loads(options.get("splits", "[]"))
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if "high" in options else None
        self.wanted = set(json.loads(options["wanted"])) if "wanted" in options else None

    def _needed(self, first: int, n: int) -> bool:
        return first + n > self.low and (self.high is None or first < self.high) and (self.wanted is None or len(self.wanted) > 4096 or any(first <= w < first + n for w in self.wanted))

    def partitions(self) -> list[Part]:
        if text.kind(self.path) in ("gzip", "zstd"):
            return [p for p in self._members() if p.end is None or self._needed(p.first, p.end - p.first)] or [Part(self.path, end=0)]
        if text.kind(self.path) != "container":
            return [Part(self.path, s["first"], s["start"], s["end"]) for s in self.splits] or [Part(self.path)]
        with open(self.path, "rb") as f:
            blocks = container.index_blocks(f)
        parts, first, size, group, group_first = [], 0, 0, [], 0
        for b in blocks:
            if self._needed(first, b.num_reads):
                if group and (size >= PART_BYTES or first != group_first + sum(x.num_reads for x in group)):
                    parts.append(Part(self.path, group_first, blocks=tuple(group)))
                    group, size = [], 0
                if not group:
                    group_first = first
                group.append(b)
                size += sum(b.sizes)
            first += b.num_reads
        return [*parts, *([Part(self.path, group_first, blocks=tuple(group))] if group else [])] or [Part(self.path, blocks=())]

    def _members(self) -> list[Part]:
        """Runs of members or frames, as far as they tell where they are; else the file as a whole."""
        own = text.members(self.path) if os.path.exists(self.path) else []
        if not sum(reads for _, reads in own):
            return [Part(self.path)]
        parts, first = [], 0
        for at, reads in own:
            if not parts or at - parts[-1].start >= PART_BYTES:
                parts.append(Part(self.path, first, at))
            first += reads
            parts[-1].end = first
        return parts

    def _texts(self, part: Part) -> Iterator[tuple[int, dict[str, pa.Array]]]:
        """Pieces of the text from a part's start on: how many records, and their columns."""
        with text.open_text(part.path, part.start) as f:
            yield from text.columns(f, part.path, self.columns)

    def _batch(self, first: int, rows: dict[str, list[str] | pa.Array], n: int) -> pa.RecordBatch:
        cols = [pa.array(np.arange(first, first + n)), *(_strings(rows[c]) if c in rows else pa.nulls(n, pa.string()) for c in _COLUMNS)]
        return pa.RecordBatch.from_arrays(cols, names=list(_KINDS))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if text.kind(part.path) == "container":
            with open(part.path, "rb") as f:
                first = part.first
                for b in part.blocks:
                    yield self._batch(first, container.decode_block(f, b, self.columns), b.num_reads)
                    first += b.num_reads
            return
        first, last = part.first, min((x for x in (part.end, self.high) if x is not None), default=None)
        if last is not None and first >= last:
            return
        for n, found in self._texts(part):
            n = n if last is None else min(n, last - first)
            yield self._batch(first, {c: x[:n] for c, x in found.items()}, n)
            first += n
            if first == last:
                return


@dataclass
class Span(InputPartition):
    """Records from ``first`` to before ``last``, and where to find them in each mate: a part that starts at or before the first."""

    first: int
    last: int | None
    mates: tuple[Part, ...] = ()


class MatesReader(ReadsReader):
    """The records of several files by position, each span of them read from all files in step, without a join.

    Spans start where parts of the file with the fewest parts do; a file that can only be read from its
    start (gzip, zstd, a small plain one) makes one span. What longer files have more is dropped.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options | {"path": ""})
        self.mates = json.loads(options["mates"])

    def partitions(self) -> list[Span]:
        parts = []
        for m in self.mates:
            own = ReadsReader({"path": m["path"], "splits": json.dumps(m["splits"])})
            parts.append([p for p in own.partitions() if p.blocks or text.kind(p.path) != "container"])
        if not all(parts):
            return [Span(0, 0)]
        cuts = [p.first for p in min(parts, key=len)]
        spans = []
        for first, last in zip(cuts, [*cuts[1:], None], strict=True):
            if (last is None or last > self.low) and (self.high is None or first < self.high):
                spans.append(Span(first, last, tuple(self._from(own, first, last) for own in parts)))
        return spans or [Span(0, 0)]

    @staticmethod
    def _from(parts: list[Part], first: int, last: int | None) -> Part:
        """The last part that starts at or before ``first``; a container's with the blocks of the parts after it too."""
        i = max(i for i, p in enumerate(parts) if p.first <= first)
        blocks, at = [], parts[i].first
        for b in (b for p in parts[i:] for b in p.blocks):
            if last is not None and at >= last:
                break
            blocks.append(b)
            at += b.num_reads
        return Part(parts[i].path, parts[i].first, parts[i].start, None, tuple(blocks))

    def _pieces(self, part: Part, first: int) -> Iterator[list[pa.Array]]:
        """Columns of a file's records from ``first`` on, piece by piece."""
        at = part.first
        if text.kind(part.path) == "container":
            found = self._blocks(part, first)
        else:
            found = self._texts(part)
        for n, own in found:
            if at + n > first:
                skip = max(first - at, 0)
                yield [_strings(own[c])[skip:] if c in own else pa.nulls(n - skip, pa.string()) for c in _COLUMNS]
            at += n

    def _blocks(self, part: Part, first: int) -> Iterator[tuple[int, dict[str, list[str]]]]:
        at = part.first
        with open(part.path, "rb") as f:
            for b in part.blocks:
                at += b.num_reads
                yield b.num_reads, container.decode_block(f, b, self.columns) if at > first else {}

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.mates:
            return
        last = min((x for x in (span.last, self.high) if x is not None), default=None)
        names = ["read_index", *(f"{c}_{i}" for i in range(len(span.mates)) for c in _COLUMNS)]
        pieces = [self._pieces(p, span.first) for p in span.mates]
        at, now = span.first, [None] * len(pieces)
        while last is None or at < last:
            for i, p in enumerate(pieces):
                now[i] = now[i] or next(p, None)
                if not now[i]:
                    return
            n = min(len(x[0]) for x in now)
            n = n if last is None else min(n, last - at)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(c[:n] for x in now for c in x)], names=names)
            now = [None if len(x[0]) == n else [c[n:] for c in x] for x in now]
            at += n


@dataclass
class Written(WriterCommitMessage):
    #: (output, first read index, first ord, part file)
    parts: list[tuple[str, int, int, str]]


class ReadsWriter(DataSourceArrowWriter):
    """Each task writes a part for each output it has rows of; the commit strings the parts together in order.

    Parts lie beside their output, in a hidden folder, so that they share its
    file system, and outputs appear whole by a rename. An output without reads
    is never made. After a failure nothing is left.
    """

    def __init__(self, options: dict[str, str]):
        self.run = options["run"]
        self.gzip_level, self.zstd_level, self.container_level, self.blocksize = (int(options[k]) for k in ("gzip_level", "zstd_level", "container_level", "blocksize"))

    def _folder(self, output: str) -> str:
        return os.path.join(os.path.dirname(output), f".{self.run}")

    def _encoded(self, output: str, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        form = text.kind(output)
        if form == "container":
            latin = lambda values: [(x or "").encode("latin-1") for x in values.to_pylist()]
            rows = (row for b in batches for row in zip(*(latin(b.column(c)) for c in _COLUMNS), strict=True))
            return container.encode_blocks(rows, self.blocksize, self.container_level)
        return text.compress((text.encode(*(b.column(c) for c in _COLUMNS)) for b in batches), form, self.gzip_level, self.zstd_level)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        made: list[tuple[str, int, int, str]] = []
        try:
            self._write(batches, made)
        except BaseException:
            self._remove(made)
            raise
        return Written(made)

    def _remove(self, parts: list[tuple[str, int, int, str]]) -> None:
        """A failed task's parts, and their folders once these are empty."""
        for output, _, _, path in parts:
            with contextlib.suppress(OSError):
                os.remove(path)
            with contextlib.suppress(OSError):
                os.rmdir(self._folder(output))

    def _write(self, batches: Iterator[pa.RecordBatch], made: list[tuple[str, int, int, str]]) -> None:
        for output, run in itertools.groupby(self._runs(batches), lambda x: x[0]):
            _, own = next(run)
            os.makedirs(folder := self._folder(output), exist_ok=True)
            path = os.path.join(folder, uuid.uuid4().hex)
            made.append((output, own.column("read_index")[0].as_py(), own.column("ord")[0].as_py(), path))
            with open(path, "wb") as f:
                for chunk in self._encoded(output, itertools.chain([own], (b for _, b in run))):
                    f.write(chunk)

    @staticmethod
    def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        """Consecutive rows of one output."""
        for b in batches:
            outputs = b.column("output")
            codes = outputs.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), b.num_rows]
            for x, y in itertools.pairwise(cuts):
                if y > x:
                    yield outputs[x].as_py(), b.slice(x, y - x)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted(p for m in messages if m for p in m.parts)
        outputs: dict[str, list[str]] = {}
        for output, _, _, path in parts:
            outputs.setdefault(output, []).append(path)
        try:
            for output, paths in outputs.items():
                whole = os.path.join(self._folder(output), uuid.uuid4().hex)
                with open(whole, "wb") as out:
                    if text.kind(output) == "container":
                        out.write(container.HEADER)
                    for p in paths:
                        with open(p, "rb") as f:
                            shutil.copyfileobj(f, out, 1 << 20)
                os.replace(whole, output)
        finally:
            for output in outputs:
                shutil.rmtree(self._folder(output), ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                self._remove(m.parts)


class ReadsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        if "mates" not in self.options:
            return SCHEMA
        return ", ".join(["read_index long", *(f"{c}_{i} string" for i in range(len(json.loads(self.options["mates"]))) for c in _COLUMNS)])

    def reader(self, schema: StructType) -> ReadsReader:
        return (MatesReader if "mates" in self.options else ReadsReader)(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ReadsWriter:
        return ReadsWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReadsSource)


@dataclass
class Wanted:
    """Indices from ``low`` to before ``high``; of a list, those blocks alone that hold one of it."""

    low: int = 0
    high: int | None = None
    listed: list[int] | None = None

    def options(self) -> dict[str, str]:
        own = {"low": str(self.low)}
        return own | ({} if self.high is None else {"high": str(self.high)}) | ({} if self.listed is None else {"wanted": json.dumps(self.listed)})

    def of(self, df: DataFrame) -> DataFrame:
        df = df.where(F.col("read_index") >= self.low) if self.low else df
        return df if self.high is None else df.where(F.col("read_index") < self.high)


def plain_splits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> list[dict]:
    """Where splits of a plain file start, and the index of their first record.

    Tasks count the newlines of byte ranges; a record is four lines, so the
    counts before a range tell its first record. A range's second pass then
    skips to that record. Signs in the lines are not relied on.
    """
    size = os.path.getsize(path)
    starts = list(range(0, size, split_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column(0).to_pylist(), []
            for a in at:
                with open(path, "rb") as f:
                    f.seek(a)
                    left, lines = split_bytes, 0
                    while left and (data := f.read(min(left, 1 << 20))):
                        lines += data.count(b"\n")
                        left -= len(data)
                    n.append(lines)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["at", "n"])

    jobs = spark.createDataFrame([(a,) for a in starts], "at long").repartition(len(starts))
    lines = {r["at"]: r["n"] for r in jobs.mapInArrow(count, "at long, n long").collect()}
    before, firsts = 0, []
    for a in starts:
        firsts.append((a, before))
        before += lines[a]
    found = []
    for a, n in firsts:
        start, record = 0, 0
        if a:
            with open(path, "rb") as f:
                f.seek(a - 1)
                under_way = f.read(1) != b"\n"
                line = n + under_way
                for _ in range(under_way + (-line) % 4):
                    f.readline()
                start, record = f.tell(), (line + (-line) % 4) // 4
        if start < size and (not found or start > found[-1]["start"]):
            found.append({"start": start, "first": record, "end": None})
    for x, y in zip(found, found[1:], strict=False):
        x["end"] = y["first"]
    return found


def _splits(spark: SparkSession, path: str, split_bytes: int) -> list[dict]:
    return plain_splits(spark, path, split_bytes) if text.kind(path) == "plain" and os.path.exists(path) and os.path.getsize(path) > split_bytes else []


def read_mate(spark: SparkSession, path: str, columns: tuple[str, ...] = _COLUMNS, split_bytes: int = SPLIT_BYTES, wanted: Wanted | None = None) -> DataFrame:
    """``read_index, name, seq, qual`` of one file; columns left out are null and, in a container, not inflated."""
    register(spark)
    path, wanted = text.normalised(path), wanted or Wanted()
    reader = spark.read.format(FORMAT).option("path", path).option("columns", ",".join(columns)).option("splits", json.dumps(_splits(spark, path, split_bytes)))
    return wanted.of(reader.options(**wanted.options()).load())


def count(spark: SparkSession, path: str) -> int:
    """Reads of a file: what blocks, members or frames tell, else all are counted."""
    path = text.normalised(path)
    if text.kind(path) == "container":
        with open(path, "rb") as f:
            return sum(b.num_reads for b in container.index_blocks(f))
    told = text.members(path) if text.kind(path) in ("gzip", "zstd") else []
    return sum(n for _, n in told) if told else read_mate(spark, path, ()).count()


def read_files(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = _COLUMNS, split_bytes: int = SPLIT_BYTES, wanted: Wanted | None = None) -> DataFrame:
    """``read_index, read1, read2, ...`` of files that are read in step, without a shuffle."""
    register(spark)
    wanted = wanted or Wanted()
    own = [{"path": p, "splits": _splits(spark, p, split_bytes)} for p in map(text.normalised, paths)]
    t = wanted.of(spark.read.format(FORMAT).option("mates", json.dumps(own)).option("columns", ",".join(columns)).options(**wanted.options()).load())
    return t.select("read_index", *(F.struct(*(F.col(f"{c}_{i}").alias(c) for c in _COLUMNS)).alias(f"read{i + 1}") for i in range(len(own))))


def read_reads(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = _COLUMNS, split_bytes: int = SPLIT_BYTES, wanted: Wanted | None = None) -> DataFrame:
    """Records of one file a mate, by position. Keys of the memory store and pipes are read too; with any of these, mates are joined by their index."""
    from ..operators.records import zip_mates
    from . import fifo, memory

    if len(paths) > 1 and not any(text.kind(p) in ("memory", "fifo") for p in paths):
        return read_files(spark, paths, columns, split_bytes, wanted)
    one = []
    for p in paths:
        form = text.kind(p)
        if form == "memory":
            one.append(memory.read(spark, p))
        elif form == "fifo":
            one.append(fifo.read(spark, text.normalised(p)))
        else:
            one.append(read_mate(spark, p, columns, split_bytes, wanted).select("read_index", F.struct(*_COLUMNS).alias("read1")))
    return (wanted or Wanted()).of(one[0] if len(one) == 1 else zip_mates(*one))


def write_routed(routed: DataFrame, config=None, partitions: int | None = None) -> None:
    """Write routed rows to their outputs, each in the order of read_index and ord."""
    from ..config import RunConfig

    config = config or RunConfig.current()
    register(routed.sparkSession)
    n = partitions or int(routed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = routed.select("output", "read_index", F.col("ord").cast("int").alias("ord"), "name", "seq", "qual").repartitionByRange(n, "read_index", "ord").sortWithinPartitions("output", "read_index", "ord")
    run = f"strandmill-{uuid.uuid4().hex}"
    try:
        ranged.write.format(FORMAT).mode("append").option("run", run).option("gzip_level", config.gzip_level).option("zstd_level", config.zstd_level).option("container_level", config.container_level).option("blocksize", config.blocksize).save()
    except Exception:
        # Tasks that were stopped leave their parts.
        with contextlib.suppress(Exception):
            for (folder,) in routed.select(F.regexp_replace("output", "[^/]*$", "")).distinct().collect():
                shutil.rmtree(os.path.join(folder, f".{run}"), ignore_errors=True)
        raise
