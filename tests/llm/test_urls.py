"""Rules and the list against plain Python, also with a filter full of false positives."""

import random
import re

import pytest

from strandmill.llm import urls

SCHEMA = "page_id long, url string, host string, verdict string"


def plain(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r, _ in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    rule = max(fits, key=len, default=None)
    canonical = re.sub(r"^(?:www|m)\.", "", host) + re.sub(r"(?:/|\.html)$", "", path)
    return host, path, rule, dict(urls.RULES)[rule] if rule else ("block" if canonical in listed else "allow"), canonical


URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "http://net/x", "HTTP://WWW.A.Example.NET/en/1?x#y", "https://example.net/en", "https://sub.example.com/de/7", "https://example.com/fr/7.html",
    "http://x.org/fr/1", "http://x.org/de/1?ref=2", "http://m.x.org/de/1/", "http://www.x.org/de/1.html#t", "x://y://z.com/a", "http://internet/de", "http://b.com/?a=://c.net/", "http://É.COM/É\n/x", "http://badexample.com/de/", "http://x.com:80/a",
]


@pytest.mark.parametrize("bits", [16, 1])
def test_verdicts(spark, monkeypatch, bits):
    monkeypatch.setattr(urls, "BITS_PER_URL", bits)
    rng = random.Random(8)
    rows = [(i, u, "h", "v") for i, u in enumerate(URLS * 2)] + [(1000 + i, f"http://{rng.choice(['', 'www.', 'm.'])}h{i % 40}.com/p{i % 300}{rng.choice(['', '/', '.html'])}{rng.choice(['', '?ref=1', '#z'])}", "h", "v") for i in range(800)]
    rows.append((None, "http://q.com/?ref=", "h", "v"))
    df = spark.createDataFrame(rows, SCHEMA)
    listed = {plain(u, ())[4] for _, u, *_ in rows if u and re.search("[?&]ref=", u)}
    assert {r[0] for r in urls.referral_list(df).collect()} == listed
    out = urls.judge(df, urls.referral_list(df)).collect()
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["canonical"]) for r in out), key=str)
    assert got == sorted(((k, *plain(u, listed)) for k, u, *_ in rows), key=str)


def test_large_list_is_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 1)
    df = spark.createDataFrame([(i, f"http://h.com/{i}", "", "") for i in range(300)], SCHEMA)
    listed = spark.createDataFrame([(f"h.com/{i}",) for i in range(0, 300, 3)] * 2 + [(None,), ("",)], "canonical string")
    assert {r["page_id"] for r in urls.judge(df, listed).where("verdict = 'block'").collect()} == set(range(0, 300, 3))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert urls.judge(df, urls.referral_list(df)).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/", "", "")], SCHEMA)
    assert urls.judge(some, urls.referral_list(df)).first()["verdict"] == "allow"


def test_pages_are_read_once(spark, tmp_path):
    spark.createDataFrame([(i, f"http://h.com/{i}", "", "") for i in range(50)], SCHEMA).write.parquet(str(tmp_path / "p"))
    listed = spark.createDataFrame([("h.com/3",)], "canonical string")
    out = urls.judge(spark.read.parquet(str(tmp_path / "p")), listed)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert [r["page_id"] for r in out.where("listed").collect()] == [3]
