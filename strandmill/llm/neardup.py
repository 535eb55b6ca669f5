"""Near duplicates: bottom-k sketches, inverted lists, union-sketch filter, exact check.

1. Texts become sets of word shingles under one hash function. Equal sets form a
   class; from then on only classes are compared.
2. A class keeps the K least hashes of its set (all, if it has no more). Two sets
   of similarity ``s`` share a binomial number of the K least hashes of their
   union; fewer than TAU shared has a probability under 1e-6 at the threshold
   itself and far less above it.
3. Inverted lists hold the classes that share several values at once, as single
   word pairs of unrelated texts meet ever more often in a larger corpus. A set of
   more than K shingles goes to the lists of its bands, groups of its least values
   under hash functions of their own: sets at the threshold have no band in common
   with a probability under MISS (``_bands``). A set that is whole in its sketch,
   or may be similar to one, shares at least ``_guaranteed`` or ``_needed`` values
   with the other's sketch, and so two of each one's rarest ones: it goes to the
   lists of all pairs of those, and none of its links to a whole set is lost.
4. Each list is a star around its most central member, the one whose values are
   most frequent: a group of n copies costs n pairs, not n squared. The sketch
   of the union estimates each pair, and the full sets confirm it. Links form
   components.
5. What a star can't settle, pairs of different components within a list, comes
   next: all such pairs of short lists; and in long lists the members outside the
   leader's component, as a query set against the list, in blocks, less those
   that have too few shingles in common with all others. None is dropped without
   that proof.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, fresh, map_in_arrow
from .shingles import band_keys, shingle_set

K = 48
TAU = 24
#: Probability that two sets of more than K shingles, similar at the threshold itself, share no band.
MISS = 1e-7
#: Lists of up to so many classes may pair their members directly.
SHORT = 16
#: Members of a block, on average, where long lists are compared in blocks; and so many thousands of shingles.
BLOCK = 400
#: Keys of documents that are broadcast at most; more are joined by a shuffle.
KEYS = 400_000


def _digest_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _bands(percent: int) -> tuple[int, int]:
    """How many bands of how many values: a band of similar sets is the same with a probability of about a third."""
    if percent >= 100:
        return 1, 1
    values = max(1, round(math.log(1 / 3) / math.log(percent / 100)))
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** values))), values


def _sets(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``key, n, digest, sketch, bands`` for each row; digest and sketch are null without words, bands up to K shingles."""
    bands, values = _bands(percent)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch, banded = [], [], [], []
            for cell in batch.column(1):
                s = shingle_set(cell.as_py(), words)
                n.append(len(s))
                digest.append(_digest_of(s))
                # Shifted so that signed order is the hashes' order.
                sketch.append((s[:K] ^ np.uint64(1 << 63)).view(np.int64) if len(s) else None)
                banded.append(band_keys(s, bands, values).view(np.int64) if len(s) > K else None)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (sketch, banded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), *lists], names=["key", "n", "digest", "sketch", "bands"])

    return map_in_arrow(source, run, "key long, n long, digest binary, sketch array<long>, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``node, shingles`` of the classes in ``wanted`` (node, min_key, digest), from a document of each."""
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    wanted = checkpoint(wanted.select("node", F.col("min_key").alias("__key"), "digest"))
    # Up to the bound, some 20 MB go to the executors and no text is shuffled.
    side = F.broadcast(wanted) if wanted.count() <= KEYS else wanted
    joined = source.join(side, source["key"].eqNullSafe(F.col("__key"))).select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for node, digest, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(cell.as_py(), words)
                # A key may stand on rows with other texts.
                if len(s) and _digest_of(s) == digest:
                    nodes.append(node)
                    sets.append((s ^ np.uint64(1 << 63)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_in_arrow(joined, run, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, comp``: the least node of each component of the undirected ``edges`` (a, b); nodes without edges are left out.

    Least labels go to neighbours and then jump to their label's label, so that
    the rounds grow with the logarithm of the longest path.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("at")).agg(F.min("comp").alias("least"))
        moved = labels.join(near, labels.node == F.col("at")).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        up = moved.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        moved = checkpoint(moved.join(up, moved.comp == F.col("up"), "left").select("node", "was", F.least("comp", F.coalesce("top", "comp")).alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels


def _guaranteed(n: Column, percent: int) -> Column:
    """How many of a whole set's ``n`` values the sketch of any similar set holds at least.

    Against a set that is whole too, it is the share of ``n``. A larger one's
    sketch may lack values of the common part, as many as it leaves out at most;
    the largest set that can be similar leaves out most.
    """
    most = F.floor(n * 100 / percent)
    common = F.ceil((n + most) * percent / (100 + percent))
    return F.least(F.ceil(n * percent / 100), F.greatest(common - F.greatest(most - K, F.lit(0)), F.lit(1)))


def _needed(n: Column, percent: int) -> Column:
    """As ``_guaranteed``, for a set of ``n`` over K shingles and any similar set that is whole: the smallest one shares least."""
    least = F.ceil(n * percent / 100)
    return F.greatest(F.ceil((n + least) * percent / (100 + percent)) - (n - K), F.lit(1))


def _listed(classes: DataFrame, percent: int) -> DataFrame:
    """``value, node, n, leader, size``: the members of each inverted list of two classes or more."""
    small = classes.where(100 * K >= percent * F.col("n"))
    values = small.select("node", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    # Values that no other class has come first in the order of rarity; of those that others have, so many more belong to the
    # prefix that it holds the first two of all values in common; up to 50 per cent, sets may have but one in common.
    first = 2 if percent > 50 else 1
    need = F.when(F.col("n") <= K, _guaranteed(F.col("n"), percent)).otherwise(_needed(F.col("n"), percent))
    shared = values.join(counts, "value").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("freq", "value"))).alias("found"))
    rarest = shared.withColumn("more", (F.size("found") - need + first).cast("int")).where(f"more >= {first}").select("node", "n", F.slice("found.value", F.lit(1), F.col("more")).alias("p"))
    lists = F.expr("p" if first == 1 else "flatten(transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), y -> xxhash64(x, y))))")
    keys = classes.select("node", "n", F.explode("bands").alias("value")).unionByName(rarest.select("node", "n", F.explode(lists).alias("value")))

    sizes = keys.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    entries = checkpoint(keys.join(sizes, "value").select("value", "node", "n", "size"))
    central = entries.groupBy("node").agg(F.sum("size").alias("central"))
    leaders = entries.join(central, "node").groupBy("value").agg(F.max(F.struct("central", "node"))["node"].alias("leader"))
    return checkpoint(entries.join(leaders, "value").select("value", "node", "n", "leader", "size"))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and whose union's sketch allow the similarity, with their sizes."""
    sa = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    sb = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    sized = pairs.join(sa, "a").join(sb, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    union = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, K)
    seen = sized.select("a", "b", "na", "nb", F.size(F.array_intersect(F.array_intersect("ka", "kb"), union)).alias("common"), F.size(union).alias("of"))
    # Of a whole union the estimate is exact; of K values, TAU must be common.
    return seen.where(f"case when of < {K} then 100 * common >= {percent} * of else common >= {TAU} end").select("a", "b", "na", "nb")


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    fa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("fa"))
    fb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("fb"))
    common = F.size(F.array_intersect("fa", "fb"))
    return likely.join(fb, "b").join(fa, "a").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``key, n_shingles, component_id, kept``.

    Links documents with ``100 * common >= percent * union`` of their distinct
    ``words``-word shingles. ``component_id`` is the least key that links reach,
    ``kept`` whether it is the row's own. A text without words is linked with
    nothing. Rows with a null key take part; they are never kept unless they are
    linked with nothing or only with others of null key, whose component is null.
    Repeated rows form one class and have equal results.
    """
    rows, of_class = _components_of_classes(docs, key, text, words, percent)
    found = rows.where("digest is not null").join(of_class, "digest").select("key", "n", "component_id")
    empty = rows.where("digest is null").select("key", "n", F.col("key").alias("component_id"))
    both = found.unionByName(empty)
    return both.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _components_of_classes(docs: DataFrame, key: str, text: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``key, n, digest`` and more of each row, and ``digest, component_id, lead`` of each class.

    ``lead`` says whether the class is the one of its component that stays: it has
    the least key, and of classes with that key the least digest.
    """
    rows = checkpoint(_sets(docs, key, text, words, percent))
    grouped = rows.where("digest is not null").groupBy("digest").agg(F.min("key").alias("min_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    # The checkpoint fixes the numbers.
    classes = checkpoint(grouped.withColumn("node", F.monotonically_increasing_id()))

    listed = _listed(classes, percent)
    stars = listed.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Read again from the texts, so that only the sets that are needed are kept."""
        return _full_sets(docs, classes.join(nodes.distinct(), "node", "left_semi"), key, text, words)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node"))

    likely = checkpoint(_likely(stars, classes, percent))
    links = checkpoint(_confirmed(likely, checkpoint(sets_of(ends(likely))), percent))
    labels = components(links)

    def labelled(frame: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
        side = labels.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        return frame.join(side, frame[node] == side["__n"], "left").withColumn(name, F.coalesce("__c", F.col(node))).drop("__n", "__c")

    # Lists whose star left more than one component.
    open_ = checkpoint(labelled(listed))
    split = open_.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value")
    left = checkpoint(open_.join(split, "value", "left_semi"))
    short = left.where(f"size <= {SHORT}").select("value", "node", "n", "comp")
    other = short.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = short.join(other, "value").where(f"node < b and comp <> cb and 100 * least(n, nb) >= {percent} * greatest(n, nb)").select(F.col("node").alias("a"), "b")
    long_ = checkpoint(left.where(f"size > {SHORT}").select("leader", "node", "comp").distinct())
    in_groups = None if long_.isEmpty() else checkpoint(_in_groups(long_, checkpoint(sets_of(long_.select("node"))), percent))
    likely = checkpoint(_likely(pairs.distinct().join(stars, ["a", "b"], "left_anti"), classes, percent))
    late = likely.select("a", "b") if likely.isEmpty() else checkpoint(_confirmed(likely, checkpoint(sets_of(ends(likely))), percent))
    # Components that late links join become one; only they are looked at again.
    joined = labelled(labelled(late, "a", "a"), "b", "b").select("a", "b")
    joined = joined if in_groups is None else joined.unionByName(in_groups)
    tops = components(joined).select(F.col("node").alias("__comp"), F.col("comp").alias("__top"))

    named = labelled(classes.select("node", "min_key", "digest"))
    named = checkpoint(named.join(tops, named["comp"] == tops["__comp"], "left").select("node", "min_key", "digest", F.coalesce("__top", "comp").alias("comp")))
    first = F.min(F.struct(F.col("min_key").isNull().alias("none"), "min_key", "digest"))
    least = named.groupBy("comp").agg(first.alias("f"))
    return rows, named.join(least, "comp").select("digest", F.col("f.min_key").alias("component_id"), (F.col("digest") == F.col("f.digest")).alias("lead"))


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``xs`` has in common with each of ``ys``, by products of 0/1 matrices."""
    nx, ny = [len(x) for x in xs], [len(y) for y in ys]
    _, at = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    ax, ay = at[: sum(nx)], at[sum(nx) :]
    rx, ry = np.repeat(np.arange(len(xs)), nx), np.repeat(np.arange(len(ys)), ny)
    size = int(at.max()) + 1
    place = np.full(size, -1)
    both = np.flatnonzero((np.bincount(ax, minlength=size) > 0) & (np.bincount(ay, minlength=size) > 0))
    place[both] = np.arange(len(both))
    px, py = place[ax], place[ay]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, len(both), 4096):
        width = min(4096, len(both) - low)
        x, y = np.zeros((len(xs), width), np.float32), np.zeros((len(ys), width), np.float32)
        ix, iy = (px >= low) & (px < low + width), (py >= low) & (py < low + width)
        x[rx[ix], px[ix] - low] = 1
        y[ry[iy], py[iy] - low] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the pairs as connect what all of them connect."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    out = []
    for x, y in np.unique(np.stack((a, b), 1), axis=0).tolist():
        rx, ry = find(x), find(y)
        if rx != ry:
            top[rx] = ry
            out.append((x, y))
    return out


def _in_groups(group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of components (a, b) that links join within each leader's group.

    A member of which too few shingles occur in any other class can't be similar
    to one and drops out; so do groups of one component then. A class's shingles
    are laid out once for that, however many groups it is in. Those that occur
    elsewhere also bound the size of a similar set: a member whose group has no
    set of such a size drops out too. What is left outside the leader's component,
    near copies with unusually many edits, is the query set: its blocks meet the
    blocks of the group. A block has members of one band of sizes, a bounded number
    of them and of shingles; only blocks of the same band and of those beside it
    meet, as similar sets differ in size by the threshold at most. No more pairs
    leave a task than its components need to be joined.
    """
    exploded = sets.select("node", F.explode("shingles").alias("value"))
    shared = exploded.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("value")
    s = exploded.join(shared, "value").groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    # What two sets have in common is at most either one's s.
    most = F.expr(f"s * {100 + percent} div {percent} - n").alias("most")
    sized = checkpoint(sets.select("node", F.size("shingles").alias("n")).distinct().join(s, "node").select("node", "n", most))
    members = group.join(sized, "node")
    sizes = members.groupBy("leader").agg(F.collect_set("n").alias("sizes"))
    main = group.where("node = leader").select("leader", F.col("comp").alias("main"))
    left = members.join(sizes.join(main, "leader"), "leader").where(f"exists(sizes, m -> m <= most and 100 * m >= {percent} * n)")
    # A hair wider than the threshold allows, so that rounding parts no pair by two bands.
    band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9)).cast("int")
    left = checkpoint(left.select("leader", "node", "comp", "n", band.alias("band"), (F.col("comp") != F.col("main")).alias("minor")))
    load = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / (BLOCK * 1000))
    size = left.groupBy("leader", "band").agg(F.ceil(load).cast("int").alias("blocks"))
    open_ = left.where("minor").select("leader").distinct()
    dealt = left.join(open_, "leader").join(size, ["leader", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    filled = checkpoint(dealt.join(sets, "node").groupBy("leader", "band", "block", "minor").agg(F.collect_list("comp").alias("comps"), F.collect_list("shingles").alias("sets")))
    near = F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band")
    x = filled.where("minor").select("leader", near, *(F.col(c).alias(f"x{c}") for c in ("comps", "sets")))
    pairs = x.join(filled.select("leader", "band", "comps", "sets"), ["leader", "band"]).drop("leader", "band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                xc, xsets, yc, ysets = (batch.column(c)[i].values for c in range(4))
                xs, ys = ([v.values.to_numpy() for v in side] for side in (xsets, ysets))
                common = _common(xs, ys)
                union = np.array([len(v) for v in xs])[:, None] + np.array([len(v) for v in ys])[None] - common
                near = (100 * common >= percent * union) & (xc.to_numpy()[:, None] != yc.to_numpy()[None])
                a, b = np.nonzero(near)
                links += _forest(xc.to_numpy()[a], yc.to_numpy()[b]) if len(a) else []
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    few = pairs.repartition(max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_in_arrow(few, run, "a long, b long").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, less those that stand for a group with another row.

    Of each component one text stays, the one with the least key (null last; if
    several texts have that key, the one with the least digest of its shingles),
    and one row of it if rows repeat. Keys may repeat or be null: rows are told
    apart by key and text. A text without words stays, on every row.
    """
    rows, of_class = _components_of_classes(docs, key, text, words, percent)
    odd = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or key is null").select(F.col("key").alias("__odd")))
    n_odd = odd.count()
    lead = rows.where("digest is not null").join(of_class, "digest").select("key", "digest", (F.col("lead") & F.col("key").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = checkpoint(lead.where("not stays and key is not null").select(F.col("key").alias("__gone")).distinct())
    own = docs[key].cast("long")
    if not n_odd:
        return docs.join(gone, own == gone["__gone"], "left_anti")
    mark = F.broadcast(odd) if n_odd <= KEYS else odd
    plain = docs.join(mark, own.eqNullSafe(mark["__odd"]), "left_anti").join(gone, own == gone["__gone"], "left_anti")
    # What tells rows of a key apart is worked out again, for these rows only.
    name = fresh(docs, "__digest")
    bound_batches(docs.sparkSession)
    some = docs.join(mark, own.eqNullSafe(mark["__odd"]), "left_semi").select("*", _digest(words)(docs[text].cast("string")).alias(name))
    stay = lead.where("stays").select(F.col("key").alias("__key"), F.col("digest").alias("__d")).distinct()
    kept = some.join(stay, some[key].cast("long").eqNullSafe(stay["__key"]) & (some[name] == stay["__d"]), "left_semi").dropDuplicates([key, name])
    return plain.unionByName(kept.drop(name)).unionByName(some.where(some[name].isNull()).drop(name))


def _digest(words: int):
    """A column function: the digest of a text's shingles, null without words."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest_of(shingle_set(t, words)))

    return run
