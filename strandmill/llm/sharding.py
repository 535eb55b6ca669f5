"""Sharding by a k-d tree with distributed weighted medians.

A node with several leaves is split along its widest dimension at the weighted
quantile that gives each side its share of the bytes. The quantile is found by
radix selection: every round is one aggregation over the narrow metadata table
for all nodes of the level at once, and only one row per node reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, gapless_rank, small_side, text_or_empty

_BITS = 12
_MASK = (1 << _BITS) - 1
_Q = 24


def _state(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return small_side(spark.createDataFrame(rows, schema), len(rows))


def kd_leaves(
    rows: DataFrame, dims: list[str], weight: str, group: str, tie: str, target: int | None = None, leaves: int | None = None, tolerance: float = 0.002
) -> DataFrame:
    """Add ``leaf`` to the narrow table ``rows``; leaves are numbered from left to right.

    ``dims`` are double columns on comparable scales, ``weight`` a positive long,
    ``group`` a long that orders rows of equal coordinates and ``tie`` the last
    long. Leaves reach ``target`` units of weight, or are ``leaves`` in number. A
    cut falls between groups where that is within ``tolerance`` of the wanted
    weight, else inside one group, by ``tie``; rows alike in all of these stay
    together. Null coordinates count as the least, null ties as 0. An empty
    table gives no rows.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.sum(weight).alias("w"), *(f(F.col(d)).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("a", F.min), ("b", F.max)))).first()
    total = ends["w"] or 0
    k = leaves or max(1, math.ceil(total / target))
    low = [ends[f"a{i}"] or 0.0 for i in range(len(dims))]
    span = [(ends[f"b{i}"] or 0.0) - low[i] for i in range(len(dims))]
    hashed = F.pmod(F.col(group), F.lit(1 << _Q))

    def key(i: int) -> Column:
        x = F.coalesce((F.col(dims[i]) - F.lit(low[i])) / F.lit(span[i] or 1.0), F.lit(0.0)) * F.lit(float((1 << _Q) - 1))
        return F.shiftleft(F.floor(x).cast("long"), _Q) + hashed

    t = rows.select("*", F.array(*(key(i) for i in range(len(dims)))).alias("__keys"), F.coalesce(F.col(tie), F.lit(0)).cast("long").alias("__tie"), F.lit(0).alias("leaf"))
    t = checkpoint(t)
    size = {0: k}
    while active := [n for n, c in size.items() if c > 1]:
        nodes = _state(spark, [(n,) for n in active], "leaf int")
        wide = t.join(nodes, "leaf").groupBy("leaf").agg(
            F.sum(weight).alias("w"), *((F.max(F.col(d)) - F.min(F.col(d))).alias(f"d{i}") for i, d in enumerate(dims))
        )
        #: node -> [dimension, weight wanted on the left, weight of the node]
        plan = {}
        for r in wide.collect():
            dim = max(range(len(dims)), key=lambda i: (r[f"d{i}"] or 0.0, -i))
            plan[r["leaf"]] = [dim, r["w"] * (size[r["leaf"]] // 2) / size[r["leaf"]], r["w"]]
        cuts = _select(t, plan, weight, tolerance)
        moved = _state(spark, [(n, plan[n][0], c1, c2, size[n] // 2) for n, (c1, c2) in cuts.items()] or [(-1, 0, 0, 0, 0)], "leaf int, __dim int, __c1 long, __c2 long, __by int")
        k1 = F.element_at("__keys", F.col("__dim") + 1)
        left = (k1 < F.col("__c1")) | ((k1 == F.col("__c1")) & (F.col("__tie") < F.col("__c2")))
        t = t.join(moved, "leaf", "left").withColumn("leaf", F.when(F.col("__by").isNull() | left, F.col("leaf")).otherwise(F.col("leaf") + F.col("__by")).cast("int"))
        t = t.drop("__dim", "__c1", "__c2", "__by")
        for n in active:
            c = size[n]
            size[n], size[n + c // 2] = c // 2, c - c // 2
    return t.drop("__keys", "__tie")


_LEAST = -(1 << 63)


def _select(t: DataFrame, plan: dict[int, list], weight: str, tolerance: float) -> dict[int, tuple[int, int]]:
    """node -> (c1, c2): rows whose (key, tie) is less go left."""
    spark = t.sparkSession
    done: dict[int, tuple[int, int]] = {}
    #: node -> (key prefix, key of the tied group, tie prefix, weight still wanted)
    at = {n: (0, 0, 0, p[1]) for n, p in plan.items()}
    rounds = [("key", s) for s in range(2 * _Q - _BITS, -1, -_BITS)] + [("tie", s) for s in (52, 40, 28, 16, 4, 0)]
    for kind, shift in rounds:
        todo = {n: s for n, s in at.items() if n not in done}
        if not todo:
            break
        width = 4 if (kind, shift) == ("tie", 0) else _BITS
        state = _state(spark, [(n, plan[n][0], s[0], s[1], s[2], float(s[3])) for n, s in todo.items()], "leaf int, __dim int, __p long, __k long, __u long, __need double")
        k1 = F.element_at("__keys", F.col("__dim") + 1)
        unsigned = F.col("__tie").bitwiseXOR(F.lit(_LEAST))
        if kind == "key":
            inside, digit = F.shiftrightunsigned(k1, shift + width) == F.col("__p"), F.shiftrightunsigned(k1, shift).bitwiseAND(F.lit(_MASK))
        else:
            above = F.lit(0) if shift + width >= 64 else F.shiftrightunsigned(unsigned, shift + width)
            inside = (k1 == F.col("__k")) & (above == F.col("__u"))
            digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << width) - 1))
        bins = t.join(state, "leaf").where(inside).groupBy("leaf", digit.alias("digit")).agg(F.sum(weight).alias("w"), F.first("__need").alias("need"))
        run = F.sum("w").over(Window.partitionBy("leaf").orderBy("digit"))
        last = F.max("digit").over(Window.partitionBy("leaf"))
        hit = bins.select("leaf", "digit", "w", "need", run.alias("upto"), last.alias("last")).where(
            (F.col("upto") - F.col("w") < F.col("need")) & ((F.col("upto") >= F.col("need")) | (F.col("digit") == F.col("last")))
        )
        seen = {r["leaf"]: r for r in hit.collect()}
        for n, (prefix, tied, tie_prefix, need) in todo.items():
            r = seen.get(n)
            if r is None:  # nothing is wanted on the left
                done[n] = (prefix << (shift + width) if kind == "key" else tied, 0 if kind == "key" else _LEAST)
                continue
            digit, before = r["digit"], r["upto"] - r["w"]
            close = min(need - before, r["upto"] - need)
            final = kind == "tie" and shift == 0
            up = int(r["upto"] - need < need - before)
            if kind == "key":
                edge = (prefix << width) + digit
                # The last digit tells single groups apart: a wider miss is better than parting one.
                if abs(close) <= tolerance * plan[n][2] * (2.5 if shift == 0 else 1):
                    done[n] = ((edge + up) << shift, _LEAST)
                else:
                    at[n] = (edge, edge if shift == 0 else 0, 0, need - before)
            else:
                edge = (tie_prefix << width) + digit
                if final or abs(close) <= tolerance * plan[n][2] / 4:
                    u = (edge + up) << shift
                    done[n] = (tied + 1, _LEAST) if u >= 1 << 64 else (tied, u - (1 << 63))
                else:
                    at[n] = (prefix, tied, edge, need - before)
    return done


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to leaves of a k-d tree over metadata of the text, sizes near equal.

    Dimensions: log2 of the bytes, bytes per character and share of blanks. Equal
    texts have equal coordinates and stay in one shard unless their group is
    wider than the cut's tolerance. Size is the UTF-8 bytes (null text: none)
    plus 1. Returns ``key, size, text_crc32, shard, slot``, one row per input row.
    """
    raw = F.encode(text_or_empty(text), "UTF-8")
    n = F.octet_length(text_or_empty(text))
    chars = F.greatest(F.char_length(text_or_empty(text)), F.lit(1))
    blanks = F.char_length(text_or_empty(text)) - F.char_length(F.translate(text_or_empty(text), " \n\t", ""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (n + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(text_or_empty(text)).alias("__group"),
        (F.log2(n + 1) / 16).alias("__d0"), (n / chars).cast("double").alias("__d1"), (blanks / chars).cast("double").alias("__d2"),
    )
    # Read once: the texts are not needed again.
    rows = checkpoint(rows)
    out = kd_leaves(rows, ["__d0", "__d1", "__d2"], "size", "__group", "doc_id", target=target_bytes, leaves=shards)
    out = out.select("doc_id", "size", "text_crc32", F.col("leaf").alias("shard"))
    return gapless_rank(out, "shard", ["doc_id", "text_crc32"], "slot").withColumnRenamed("doc_id", key)
