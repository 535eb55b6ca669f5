"""Benchmark decontamination: containment search by size-partitioned MinHash.

A short test item inside a long document has a tiny Jaccard similarity with it,
so the search is for containment of the item. An item's sketch is its
``n - ceil(threshold * n) + 1`` least hashes: a document that holds the
threshold's share of the item holds at least one of them, whatever the
document's length. Items are partitioned by the size of their sets, and each
partition has a bound of its own, the greatest hash of its sketches: small sets
have high bounds, large ones low. A partition with few enough sketch rows is
broadcast, so that no document row moves for it, however high its bound;
documents' hashes are shuffled only up to the bounds of the larger partitions.
So a few tiny items don't make every shingle of the corpus travel. Candidates
are confirmed by exact containment.

An item of fewer than five words has one shingle, of as many words as it has;
documents are looked through for shingles of that width too, where such items are.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import common
from .common import checkpoint, small_side, text_or_empty

WORDS = 5
PERCENT = 80


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: str, n: int = WORDS) -> Column:
    """Hashes of the ``n``-word shingles of the array column ``words``; of fewer words, none."""
    each = ", ".join(f"element_at({words}, i + {k})" for k in range(n))
    return F.expr(f"case when size({words}) >= {n} then transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64({n}, {each})) else cast(array() as array<bigint>) end")


def item_sets(items: DataFrame, item_key: str, text: str, words: int) -> DataFrame:
    """``item_id, found, width, n_item``: sorted distinct hashes of shingles of ``width`` words, as many as the item has
    but no more than ``words``. Items without words are left out; of repeated ids, every text counts as an item of that id."""
    split = items.select(F.col(item_key).cast("long").alias("item_id"), tokens(text_or_empty(text)).alias("words")).where("size(words) > 0")
    own = shingles("words", words)
    for width in range(words - 1, 0, -1):
        own = F.when(F.size("words") == width, shingles("words", width)).otherwise(own)
    sets = split.select("item_id", F.sort_array(F.array_distinct(own)).alias("found"), F.least(F.size("words"), F.lit(words)).alias("width"))
    return sets.distinct().withColumn("n_item", F.size("found").cast("long"))


def _broadcast_parts(bounds: list[Row]) -> list[int]:
    """The partitions with the highest bounds whose sketches together stay below the bound on broadcast rows."""
    out, rows = [], 0
    for b in sorted(bounds, key=lambda b: (-b["bound"], b["part"])):
        if rows + b["rows"] <= common.BROADCAST_ROWS:
            out.append(b["part"])
            rows += b["rows"]
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, item_id, n_item, n_shared``: documents that hold at least ``percent`` of an item's distinct shingles.

    One row a pair of ids, the greatest share if ids repeat. Null ids are ids of
    their own; empty texts hold nothing, and items without words are in nothing.
    A text in a script without blanks is one word. Texts are read whole; repeated
    rows count once; other columns are ignored; an empty table gives no rows.
    """
    sets = checkpoint(item_sets(items, item_key, item_text, words))
    keep = F.col("n_item") - F.ceil(F.col("n_item") * percent / 100) + 1
    sketch = sets.select("item_id", F.floor(F.log2("n_item")).cast("int").alias("part"), "width", F.explode(F.slice("found", F.lit(1), keep.cast("int"))).alias("hash"))
    bounds = sketch.groupBy("part").agg(F.max("hash").alias("bound"), F.count(F.lit(1)).alias("rows"), F.collect_set("width").alias("widths")).collect()  # a row a power of two
    widths = sorted({w for b in bounds for w in b["widths"]}) or [words]
    small = _broadcast_parts(bounds)
    large = [b for b in bounds if b["part"] not in small]
    source = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")).withColumn("fp", F.xxhash64("text"))

    def exploded(frame: DataFrame) -> DataFrame:
        """``key, fp, hash``, repeats and all."""
        split = frame.select("key", "fp", tokens(F.col("text")).alias("words"))
        return split.select("key", "fp", F.explode(F.concat(*(shingles("words", w) for w in widths))).alias("hash"))

    def met_in(parts: list[Row], send: bool) -> DataFrame:
        """Documents with a sketch value of these partitions; hashes above all their bounds are not looked up."""
        top = max((b["bound"] for b in parts), default=-(1 << 63))
        own = sketch.where(F.col("part").isin([b["part"] for b in parts])).select("hash", "item_id").distinct()
        looked = exploded(source).where(F.col("hash") <= top)
        return looked.join(F.broadcast(own) if send else own, "hash").select("key", "fp", "item_id").distinct()

    pairs = met_in([b for b in bounds if b["part"] in small], True)
    if large:
        pairs = pairs.unionByName(met_in(large, False)).distinct()
    pairs = checkpoint(pairs)
    few = pairs.select("key", "fp").distinct()
    n = few.count()
    wanted = few.select(F.col("key").alias("__k"), F.col("fp").alias("__f"))
    # Repeated rows are alike, so one of them will do; only candidates' texts are deduplicated.
    again = source.join(small_side(wanted, n), F.col("key").eqNullSafe(F.col("__k")) & (F.col("fp") == F.col("__f")), "left_semi")
    held = exploded(again)
    full = sets.select("item_id", "n_item", "found", F.explode("found").alias("hash"))
    size = sets.agg(F.sum("n_item")).first()[0] or 0
    full = full.select("hash", "item_id", "n_item", F.xxhash64("found").alias("item_fp"))
    met = held.distinct().join(small_side(full, size), "hash").groupBy("key", "fp", "item_id", "item_fp", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    exact = met.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = exact.groupBy("key", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("b"))
    return best.select(F.col("key").alias(key), "item_id", "b.n_item", "b.n_shared")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents, with all their columns and whatever their names, whose id has no leak.

    A null id is an id of its own. Rows that share an id go or stay together; null and empty texts leak nothing.
    """
    bad = checkpoint(leaks(docs, items, key, text, **how).select(F.col(key).alias("__bad")).distinct())
    side = small_side(bad, bad.count())
    return docs.join(side, docs[key].cast("long").eqNullSafe(side["__bad"]), "left_anti")


__all__ = ["clean", "item_sets", "leaks", "shingles", "tokens"]
