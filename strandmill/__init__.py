"""FASTQ analytics on Spark DataFrames.

Reads are rows ``(read_index, read1, read2, ...)`` with each mate a struct of
``name, seq, qual``; every operator maps such a DataFrame to another, so steps
fuse into one pass. ``plans.api`` wraps them file to file.
"""

from .config import RunConfig, options

__all__ = ["RunConfig", "options"]
