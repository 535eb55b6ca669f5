"""User kernels: a function of a block of records, or of one record, that emits routed reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from .records import mates

ROUTED = "output string, read_index long, ord int, name string, seq string, qual string"
_FIELDS = ("name", "seq", "qual")


class Read(NamedTuple):
    name: str
    seq: str
    qual: str


def check_result(result: object) -> dict[str, list[pd.DataFrame]]:
    """A block kernel's result as frames by output. None drops the block, a None frame is skipped.

    A mapping, or pairs of output and frame; the same output may come again in pairs.
    """
    if result is None:
        return {}
    pairs = list(result.items()) if isinstance(result, dict) else result
    if isinstance(pairs, pd.DataFrame) or not isinstance(pairs, (list, tuple)) or not pairs or not all(isinstance(p, tuple) and len(p) == 2 for p in pairs):
        raise TypeError("kernel must return a named list of data frames")
    out: dict[str, list[pd.DataFrame]] = {}
    for name, frame in pairs:
        if not isinstance(name, str) or not name:
            raise ValueError("kernel must return a named list of data frames: an output has no name")
        if frame is None:
            continue
        if not isinstance(frame, pd.DataFrame) or not set(_FIELDS) <= set(frame.columns):
            raise TypeError("kernel output needs the columns name, seq and qual")
        for f in _FIELDS:
            if not all(isinstance(v, str) for v in frame[f]):
                raise TypeError(f"kernel output column {f} must be text without missing values")
        if (frame["seq"].str.len() != frame["qual"].str.len()).any():
            raise ValueError("read sequence and quality lengths differ")
        out.setdefault(name, []).append(frame)
    return out


def _blocks(pdf: pd.DataFrame, own: list[str]) -> tuple[dict[str, pd.DataFrame], list[int]]:
    pdf = pdf.sort_values("read_index")
    return {m: pd.DataFrame({f: pdf[f"{m}_{f}"].to_list() for f in _FIELDS}) for m in own}, pdf["read_index"].to_list()


def _emit(result: object, first: int) -> pd.DataFrame:
    rows = [(name, first, row.name_, row.seq, row.qual) for name, frames in check_result(result).items() for f in frames for row in f[list(_FIELDS)].rename(columns={"name": "name_"}).itertuples(index=False)]
    out = pd.DataFrame(rows, columns=["output", "read_index", "name", "seq", "qual"])
    out.insert(2, "ord", pd.Series(range(len(out)), dtype="int32"))
    return out.astype({"read_index": "int64", "ord": "int32"})


def _flat(df: DataFrame, own: list[str]) -> DataFrame:
    return df.select("read_index", *(F.col(m)[f].alias(f"{m}_{f}") for m in own for f in _FIELDS))


def run_blocks(df: DataFrame, kernel: Callable[[dict[str, pd.DataFrame], list[int]], object], config: RunConfig | None = None, mode: str = "blocks") -> DataFrame:
    """Routed rows from ``kernel(reads, index)`` over blocks of ``config.blocksize`` records.

    ``blocks`` forms exact blocks with one shuffle; ``batches`` feeds it whatever Arrow
    batch a task has, without a shuffle; ``driver`` calls it block by block, in order,
    here, for kernels that keep state.
    """
    config = config or RunConfig.current()
    own = mates(df)
    if config.limit is not None:
        df = df.where(F.col("read_index") < config.limit)
    flat = _flat(df, own)
    size = config.blocksize
    if mode == "driver":
        return _on_driver(flat, own, kernel, size)
    if mode == "batches":

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    reads, index = _blocks(pdf, own)
                    yield _emit(kernel(reads, index), index[0])

        return flat.mapInPandas(each, ROUTED)
    if mode != "blocks":
        raise ValueError("mode must be blocks, batches or driver")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        reads, index = _blocks(pdf, own)
        return _emit(kernel(reads, index), index[0])

    return flat.groupBy(F.floor(F.col("read_index") / size).alias("__block")).applyInPandas(one, ROUTED)


def _on_driver(flat: DataFrame, own: list[str], kernel: Callable, size: int) -> DataFrame:
    frames: list[pd.DataFrame] = []
    rows: list[tuple] = []

    def flush() -> None:
        if rows:
            reads, index = _blocks(pd.DataFrame(rows, columns=flat.columns), own)
            frames.append(_emit(kernel(reads, index), index[0]))
            rows.clear()

    block = None
    for row in flat.orderBy("read_index").toLocalIterator():
        if row["read_index"] // size != block:
            flush()
            block = row["read_index"] // size
        rows.append(tuple(row))
    flush()
    frames = [f for f in frames if len(f)]
    spark = flat.sparkSession
    return spark.createDataFrame(pd.concat(frames), ROUTED) if frames else spark.createDataFrame([], ROUTED)


def run_records(df: DataFrame, kernel: Callable[[list[Read], int], Iterable[tuple[str, Read]]], config: RunConfig | None = None) -> DataFrame:
    """Routed rows from ``kernel(record, index)``, called for one record at a time; an empty output drops a read."""
    config = config or RunConfig.current()
    own = mates(df)
    if config.limit is not None:
        df = df.where(F.col("read_index") < config.limit)
    flat = _flat(df, own)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                record = [Read(*(getattr(row, f"{m}_{f}") for f in _FIELDS)) for m in own]
                out += [(to, row.read_index, i, *read) for i, (to, read) in enumerate(kernel(record, row.read_index)) if to]
            yield pd.DataFrame(out, columns=["output", "read_index", "ord", "name", "seq", "qual"]).astype({"read_index": "int64", "ord": "int32"})

    return flat.mapInPandas(each, ROUTED)


def even_reads(output: str) -> Callable[[list[Read], int], list[tuple[str, Read]]]:
    """Sample kernel: records of even index."""
    return lambda record, index: [(output, record[0])] if index % 2 == 0 else []


def gc_between(output: str, low: float = 0.35, high: float = 0.65) -> Callable[[list[Read], int], list[tuple[str, Read]]]:
    """Sample kernel: records whose mate 1 has a share of G and C within the bounds."""

    def kernel(record: list[Read], index: int) -> list[tuple[str, Read]]:
        seq = record[0].seq.upper()
        share = (seq.count("G") + seq.count("C")) / len(seq) if seq else -1.0
        return [(output, record[0])] if low <= share <= high else []

    return kernel


TEMPLATE = '''"""A kernel for strandmill.operators.kernels.run_blocks."""


def kernel(reads, index):
    # reads["read1"] has the columns name, seq and qual; index the records' places.
    # Return frames by output, or None for nothing.
    return {"output.fastq": reads["read1"]}
'''


def write_kernel_template(path: str) -> str:
    with open(path, "w") as f:
        f.write(TEMPLATE)
    return path
