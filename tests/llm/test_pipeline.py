"""Leakage against brute force, and the pipeline's stages."""

import random
import re

import corpus_pipeline
from strandmill.llm import common, decontaminate

SCHEMA = "doc_id long, text string, item_id string, n_item string"


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(text, width=5):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_leaks_by_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 25, 60, 200])))) for i in range(40)] + [(40, None), (41, ""), (42, "w1 w2"), (None, "w5 w6 w7 w8 w9 w10")]
    docs = []
    for i in range(200):
        body = [word() for _ in range(rng.randrange(400))]
        if rng.random() < 0.5:
            own = tokens(rng.choice(items[:40])[1])
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((i, rng.choice([" ", "&&& ", ", "]).join(w.title() for w in body)))
    docs += [(500, None), (501, ""), (502, "w1 w2"), (None, items[2][1]), (7, items[3][1]), (3, docs[3][1]), (900, " ".join([word() for _ in range(60_000)] + tokens(items[1][1])))]
    want = {}
    for k, t in docs:
        have = {n: shingles(t, n) for n in range(1, 6)}
        for i, u in items:
            width = min(5, len(tokens(u)))
            s = shingles(u, width) if width else set()
            n = len(s & have[width]) if s else 0
            if s and 100 * n >= 80 * len(s):
                want[k, i] = max(want.get((k, i), (0, 0, 0)), (n / len(s), len(s), n))
    d = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    for bound in (100_000, 60, 1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontaminate.leaks(d, b).collect()}
        assert got == {k: v[1:] for k, v in want.items()}
    bad = {k for k, _ in want}
    assert sorted((r[0] for r in decontaminate.clean(d, b).collect()), key=str) == sorted((k for k, _ in docs if k not in bad), key=str)
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = common.checkpoint(out)
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert not decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_on_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "few words", "en", "s", 9), (2, "few words", "en", "s", 9), (3, "long text " * 50_000, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.checkpoint(stage(spark, docs, sf))
        docs.collect()
