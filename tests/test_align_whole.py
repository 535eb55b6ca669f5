"""The alignment queries over whole reads against brute force."""

import pytest

from strandmill.plans import queries

SF = "/root/testdata/sf0.001"
NONE = (0, 0, 2147483647)


def hamming(q, t, most, offsets):
    found = min(((sum(a != b for a, b in zip(q, t[i:], strict=False)), i) for i in offsets), default=(99, 0))
    return (found[1], found[1] + len(q) - 1, found[0]) if found[0] <= most else NONE


def edit(q, t, boundary):
    row = [0 if boundary == "contains" else j for j in range(len(t) + 1)]
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] if boundary == "global" else min(row)


@pytest.mark.parametrize("boundary", ["starts", "contains", "global"])
def test_whole_reads(spark, boundary):
    seqs = {r[0]: (r[1], r[2]) for r in queries.pairs(spark, SF).where("read_index < 300").selectExpr("read_index", "read1.seq", "read2.seq").collect()}
    assert seqs and all(len(s) == 32 for pair in seqs.values() for s in pair)
    got = {m: {r["read_index"]: r for r in queries.QUERIES[f"align_{m}_{boundary}"](spark, SF).where("read_index < 300").collect()} for m in ("hm", "lv")}
    assert set(got["hm"]) == set(got["lv"]) == set(seqs)
    for k, (q, t) in seqs.items():
        r = got["hm"][k]
        inside = boundary == "contains"
        barcode = queries.INDEX_BARCODES[k % len(queries.INDEX_BARCODES)]
        want = hamming(barcode, t, 1, range(28)) if inside else hamming(q, t, 24, [0])
        assert (r["start"], r["end"], r["distance"]) == want
        assert got["lv"][k]["distance"] == edit(q, t, boundary)
    if boundary == "contains":
        assert any(r["start"] > 4 for r in got["hm"].values())
