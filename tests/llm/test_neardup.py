"""Near duplicates against brute force, at random, with hot groups, and on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandmill.llm import neardup
from strandmill.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, digest string, n string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_set(text, n):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent=80):
    sets = [brute_set(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)), k == least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(spark, rows, n):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    return sorted((tuple(r) for r in neardup.near_duplicates(df, words=n).collect()), key=str)


def edited(rng, base, edits, vocabulary):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        how = rng.random()
        if how < 0.6:
            out[at] = rng.choice(vocabulary)
        elif how < 0.8 and len(out) > 3:
            del out[at]
        else:
            out.insert(at, rng.choice(vocabulary))
    return out


@pytest.mark.parametrize(("n", "copies", "length", "most", "seed"), [(2, 60, 60, 12, 1), (5, 60, 90, 6, 2), (2, 120, 100, 9, 3), (2, 40, 12, 3, 4)])
def test_groups_of_near_copies(spark, n, copies, length, most, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(3):
        base = [rng.choice(vocabulary) for _ in range(length)]
        rows += [" ".join(edited(rng, base, rng.randrange(most + 1), vocabulary)) for _ in range(copies if g else copies // 3)]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(length)) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(50)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    assert result(spark, rows, n) == brute(rows, n)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  B\n"), (8, long), (9, long + " end"), (None, "a b"), (None, "null key only here"), (6, "a b"), (10, "É é"), (11, "é É")]
    assert result(spark, rows, 2) == brute(rows, 2)


def test_texts_are_joined_without_broadcast(spark, monkeypatch):
    """Beyond the bound on broadcast keys, and with lists that are long from three members on."""
    monkeypatch.setattr(neardup, "KEYS", 0)
    monkeypatch.setattr(neardup, "SHORT", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(10), vocabulary)) for _ in range(40)))
    assert result(spark, rows, 2) == brute(rows, 2)


def test_whole_sets_against_cut_sketches(spark):
    """Sets of 40 to 48 shingles and supersets of them of 49 to 60, around the threshold; only the pair itself shares words."""
    rows, sizes = [], [(a, b) for a in range(40, 49) for b in range(49, 62) if 100 * a >= 78 * b]
    for i, (a, b) in enumerate(sizes * 3):
        longer = [f"p{i}x{k}" for k in range(b + 1)]
        rows += [(2 * i, " ".join(longer[: a + 1])), (2 * i + 1, " ".join(longer))]
    got = result(spark, rows, 2)
    assert got == brute(rows, 2)
    assert {r[1] for r in got if r[3] is False} == set(range(49, 61))


def test_guaranteed_common_values(spark):
    """Against every size of a similar set, with the worst choice of the values that its sketch leaves out."""
    n = spark.range(1, neardup.K + 1).select("id", neardup._guaranteed(F.col("id"), 80).alias("g"))
    for a, g in n.collect():
        least = []
        for b in range(1, 2 * a + 1):
            similar = [c for c in range(1, min(a, b) + 1) if 100 * c >= 80 * (a + b - c)]
            least += [min(similar) - max(b - neardup.K, 0)] if similar else []
        assert g == min(least)


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA), words=5).collect() == []


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here in a row"), (3, "other words stand here in a row"), (4, ""), (5, None), (None, "x y z w v u"), (None, "x y z w v u")]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r[0], r[1]) for r in kept.collect() if r[0]) == [(1, rows[0][1]), (3, rows[2][1]), (4, ""), (5, None)]
    assert [r[1] for r in kept.collect() if r[0] is None] == ["x y z w v u"]


def test_keep_one_tells_rows_of_a_key_apart(spark):
    """A key on two texts, and a copy without a key; extra columns have the names that the operator uses inside."""
    a, other = "a b c d e f", "quite another text is this one here"
    rows = [(1, a), (3, a), (3, other), (None, a), (4, other), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(k, t, "x", "y", "z", "q") for k, t in rows], SCHEMA + ", __odd string, __digest string").withColumn("__gone", F.lit(1)).withColumn("__key", F.lit(2))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted([(1, a), (3, other), (9, ""), (9, ""), (None, None)], key=str)


def test_long_lists_in_bands_of_sizes(spark, monkeypatch):
    """Blocks of two members, in groups whose sets differ much in size."""
    monkeypatch.setattr(neardup, "SHORT", 2)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(250)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = [" ".join(edited(rng, base[: rng.choice([60, 66, 72, 78, 84, 90])], rng.randrange(8), vocabulary)) for _ in range(90)]
    rows = list(enumerate(texts))
    assert result(spark, rows, 2) == brute(rows, 2)


@pytest.mark.parametrize("low", [30, 44, 58])
def test_sizes_across_the_sketch(spark, low):
    """Pairs of all sizes from 30 to 70 around 80 to 90 per cent, each pair with words of its own."""
    rng, rows = random.Random(low), []
    for a in range(low, low + 14):
        for b in range(a, 71):
            for share in (0.8, 0.85, 0.9):
                # Of a + b shingles, the share of the union in common, and just less.
                common = -(-share * (a + b) // (1 + share))
                for c in (int(common), int(common) - 1):
                    if 2 <= c <= a:
                        tag = f"k{len(rows)}"
                        same = [f"{tag}s{i}" for i in range(c + 1)]
                        one, two = ([f"{tag}{m}{i}" for i in range(n - c)] for m, n in (("x", a), ("y", b)))
                        rows += [(len(rows), " ".join(same + one)), (len(rows) + 1, " ".join(same + two))]
    rng.shuffle(rows)
    got = {r[0]: r[2] for r in result(spark, rows, 2)}
    sets = {k: brute_set(t, 2) for k, t in rows}
    for k in range(0, len(rows), 2):
        common = len(sets[k] & sets[k + 1])
        near = 100 * common >= 80 * len(sets[k] | sets[k + 1])
        assert (got[k + 1] == k) == near, (len(sets[k]), len(sets[k + 1]), common)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((90, 95, 100), 90)


def test_shingles_in_blocks(monkeypatch):
    from strandmill.llm import shingles

    text = " ".join(f"word{i}" for i in range(5000)) + " " + "x" * 3000
    whole = shingle_set(text, 3)
    monkeypatch.setattr(shingles, "_BLOCK", 512)
    assert (shingle_set(text, 3) == whole).all()
    assert len(whole) == len(brute_set(text, 3))


@pytest.mark.parametrize("length", [40, 300])
def test_unrelated_texts_make_no_lists(spark, monkeypatch, length):
    """Texts of a hundred words, whose pairs of words mostly stand in others too: no frame has more rows than the input."""
    rng = random.Random(length)
    vocabulary = [f"w{i}" for i in range(100)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(length)) for _ in range(500)]
    near = [" ".join(edited(rng, t.split(" "), length // 40, vocabulary)) for t in texts[:5]]
    rows, seen, real = list(enumerate(texts + near)), [], neardup.checkpoint

    def counted(frame):
        out = real(frame)
        seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "checkpoint", counted)
    assert result(spark, rows, 2) == brute(rows, 2)
    assert max(seen) <= len(rows)


def rows_made(spark, done):
    """The most rows that a join or a laid out list has made, of the queries beyond the first ``done``; and how many queries ran."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    total, most = store.executionsCount(), 0
    for execution in (store.executionsList(int(done), int(total - done)).apply(i) for i in range(total - done)):
        values, nodes = store.executionMetrics(execution.executionId()), store.planGraph(execution.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                value = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and ("Join" in node.name() or "Generate" in node.name()) and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, total


def test_shingles_are_laid_out_once(spark):
    """A large group of near copies whose lists have many leaders: no frame has more rows than its classes have shingles."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = list(enumerate(" ".join(edited(rng, base, rng.randrange(11), vocabulary)) for _ in range(500)))
    done = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert result(spark, rows, 5) == brute(rows, 5)
    most, _ = rows_made(spark, done)
    assert 0 < most <= sum(len(s) for s in {brute_set(t, 5) for _, t in rows})
