"""Identifiers against plain regular expressions, and disguises mapped back."""

import hashlib
import random
import time
import re

import pytest

from strandmill.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    pieces = ["a", "b.c", "@", "x-y", ".", "..", "-", " ", "1", "23", "255", "256", "4041894974608795", "4041 8949 7460 8795", "+1", "(555)", "+", "1.2.3.4", "1.2.3.4.5", "é", "@@", "a@b.c", "%", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("write john.smith (at) example (dot) com now", "email", "john.smith (at) example (dot) com"), ("write john at example dot com", "email", "john at example dot com"),
        ("ｊohn＠exаmple.com", "email", "ｊohn＠exаmple.com"), ("john [dot] smith [at] mail2 dot example dot com!", "email", "john [dot] smith [at] mail2 dot example dot com"),
        ("é call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"), ("１9２.168.0.1 here", "ip", "１9２.168.0.1"),
        ("go to 1 dot 2 dot 3 dot 4", "ip", "1 dot 2 dot 3 dot 4"), ("pay 4O41894974608795", "card", "4O41894974608795"), ("pay four zero four one 8949 7460 8795", "card", "four zero four one 8949 7460 8795"),
        ("zwei fünf fünf . 1", None, None), ("ask +49 eins zwei drei vier fünf sechs sieben acht", "phone", "+49 eins zwei drei vier fünf sechs sieben acht"),
    ],
)
def test_disguises(text, kind, value):
    base, added = pii.find(text)
    assert base == plain(text)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in added] == ([(kind, value)] if kind else [])


@pytest.mark.parametrize("text", ["meet me at noon, dot the page", "look at example.com for more", "one two three, un deux trois", "uno dos tres de la mañana", "Der Punkt ist das", "plain john@example.com and 1.2.3.4"])
def test_clean_texts_gain_nothing(text):
    assert pii.find(text)[1] == []


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1 " * 100_000, "a@" * 100_000, "at " * 100_000, "one " * 50_000):
        pii.find(text)


def test_scan_and_identifiers(spark):
    text = "é a@b.cd and a (at) b.cd, 1.2.3.4"
    rows = [(1, None, "k"), (2, "", "k"), (3, text, "k"), (3, text, "k"), (None, "x" * 200_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.scan(df).collect()
    assert len(out) == 5
    row = next(r for r in out if r["doc_id"] == 3)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"], row["n_disguised"]) == (1, 1, 0, 0, 1)
    assert row["spans"] == "email:2:8,email:13:24,ip:26:33"
    assert row["base_sha256"] == hashlib.sha256(b"email:2:8,ip:26:33").hexdigest()
    assert next(r for r in out if r["doc_id"] == 1)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    found = pii.identifiers(df).where("doc_id = 3").distinct().collect()
    assert {(r["kind"], r["value"], r["disguised"]) for r in found} == {("email", "a@b.cd", False), ("email", "a (at) b.cd", True), ("ip", "1.2.3.4", False)}
    assert pii.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize(("text", "want"), [
    ("mail john dot smith at example dot com now", "john dot smith at example dot com"), ("john at mail.example dot com", "john at mail.example dot com"), ("at this point john at example dot com", "john at example dot com"),
    ("j.smith at example punkt de", "j.smith at example punkt de"), ("look at example.com there", None),
])
def test_mixed_disguises(text, want):
    base, added = pii.find(text)
    assert not base and [text[s:e] for s, _, e in added] == ([want] if want else [])


def test_long_dotted_chains_take_linear_time():
    began = time.perf_counter()
    pii.find("x (dot) y " + "a.b1." * 60_000)
    assert time.perf_counter() - began < 10
