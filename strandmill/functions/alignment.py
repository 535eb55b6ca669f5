"""Row-wise alignment of a query with a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..config import NO_MATCH_DISTANCE
from . import reads, vectorised

_HAMMING = {"starts": reads.hamming_starts, "contains": reads.hamming_contains, "global": reads.hamming_global}


def align(query: Column | str, target: Column | str, max_distance: int = NO_MATCH_DISTANCE, ambiguity_base: str = "", boundary: str = "contains", distance_metric: str = "lv") -> Column:
    """Struct of start, end (inclusive) and distance; (0, 0, 2147483647) where nothing is near enough.

    Of ``ambiguity_base`` the first character counts; it equals every character.
    """
    if boundary not in _HAMMING:
        raise ValueError("boundary must be one of contains, starts, global")
    free = ambiguity_base[:1]
    if distance_metric in ("hm", "hamming"):
        return _HAMMING[boundary](query, target, max_distance, free)
    if distance_metric in ("lv", "levenshtein"):
        if boundary == "global" and not free:
            return reads.levenshtein_global(query, target, max_distance)
        return vectorised.edit_distance(query, target, max_distance, free, boundary)
    raise ValueError("distance_metric must be one of lv, levenshtein, hm, hamming")


def align_frame(df: DataFrame, query: str = "query", target: str = "target", **how) -> DataFrame:
    """``query, target, start, end, distance``, one row per input row."""
    return df.select(df[query].alias("query"), df[target].alias("target"), align(df[query], df[target], **how).alias("a")).select("query", "target", "a.*")
