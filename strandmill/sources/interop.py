"""Reads to and from tables in the driver's memory."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import mates, zip_mates


def from_table(spark: SparkSession, *tables: pd.DataFrame | pa.Table | Iterable[tuple[str, str, str]]) -> DataFrame:
    """Records from one table of name, seq, qual for each mate; rows are indexed in their order."""
    frames = []
    for t in tables:
        if isinstance(t, pa.Table):
            t = t.to_pandas()
        if not isinstance(t, pd.DataFrame):
            t = pd.DataFrame(list(t), columns=["name", "seq", "qual"])
        rows = pa.Table.from_arrays([pa.array(range(len(t)), pa.int64()), *(pa.array(t[c].tolist(), pa.string()) for c in ("name", "seq", "qual"))], names=["read_index", "name", "seq", "qual"])
        frames.append(spark.createDataFrame(rows).select("read_index", F.struct("name", "seq", "qual").alias("read1")))
    return frames[0] if len(frames) == 1 else zip_mates(*frames)


def to_tables(df: DataFrame) -> pd.DataFrame | list[pd.DataFrame]:
    """A table of name, seq, qual in order of the index; a list of them for several mates."""
    out = [df.select("read_index", f"{m}.*").orderBy("read_index").drop("read_index").toPandas() for m in mates(df)]
    return out[0] if len(out) == 1 else out
