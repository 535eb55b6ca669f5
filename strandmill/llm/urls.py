"""URL filter: host and path rules first, then a list of canonical URLs.

The list becomes a blocked Bloom filter, a table with one 512-bit row for each
block. A URL that the filter passes is joined with the list itself, which
removes the false positives. Filter and list are broadcast only if their bytes,
counted first, stay below a bound, and are shuffled for the join beyond it. The
pages are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint

#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bits of the filter for each listed URL.
BITS_PER_URL = 16
_WORDS = 8
#: Bytes of a filter or of a list that are broadcast at most.
BROADCAST_BYTES = 16 << 20
#: Rows that take part in no match are spread over so many keys of their own.
_SPREAD = 1 << 12


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no scheme: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without a closing ``/`` or ``.html``; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host_, r"^(?:www|m)\.", ""), F.regexp_replace(path_, r"(?:/|\.html)$", ""))


def rule(host_: Column, path_: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it, and whose path starts the URL's."""
    out: Column = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(f"/{p}"))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _places(url: Column) -> list[Column]:
    """The bit that a URL sets in each word, from six bits of one hash each."""
    h = F.xxhash64(url)
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(_WORDS)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row a block: ``__block`` and its eight 64-bit words; a URL sets one bit in each word."""
    places = _places(F.col("canonical"))
    keyed = listed.select(F.pmod(F.xxhash64("canonical", F.lit(1)), F.lit(blocks)).alias("__block"), *(_bit(p).alias(f"__w{i}") for i, p in enumerate(places)))
    return keyed.groupBy("__block").agg(*(F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(_WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, host, path, rule, verdict, canonical, listed``, one row per input row.

    ``listed`` has a string column ``canonical``; repeats, nulls and empty ones
    are ignored. A rule's verdict goes before the list's (block if listed, else
    allow). A null URL has empty parts and is allowed. Repeated rows have equal
    results; URLs are read whole; other columns, whatever their names, are ignored.
    """
    known = checkpoint(listed.where("canonical is not null and canonical <> ''").select("canonical").distinct())
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("canonical") + 64), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] * BITS_PER_URL // 512))

    def side(df: DataFrame, bytes_: int) -> DataFrame:
        return F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df

    u = F.col(url).cast("string")
    split = pages.select(F.col(key).alias(key), host(u).alias("host"), path(u).alias("path"))
    split = split.select("*", rule(F.col("host"), F.col("path"), rules).alias("rule"), canonical(F.col("host"), F.col("path")).alias("canonical"))
    # Pages without a host are many and listed never: they go to keys below 0, which no block has.
    own, none = F.pmod(F.xxhash64("canonical", F.lit(1)), F.lit(blocks)), F.pmod(F.xxhash64(key), F.lit(_SPREAD))
    split = split.withColumn("__block", F.when(F.col("canonical") == "", -1 - none).otherwise(own))
    probed = split.join(side(bloom(known, blocks), blocks * (8 * _WORDS + 64)), "__block", "left")
    hit = F.lit(True)
    for i, p in enumerate(_places(F.col("canonical"))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(_bit(p)) != 0)
    probed = probed.select(key, "host", "path", "rule", "canonical", F.coalesce(hit, F.lit(False)).alias("__maybe"))
    # What the filter stops meets nothing, under a key that only spreads it.
    probed = probed.withColumn("__key", F.when(F.col("__maybe"), F.col("canonical")).otherwise(F.concat(F.lit("\0"), none.cast("string"))))
    exact = side(known.select(F.col("canonical").alias("__known")), size["bytes"])
    joined = probed.join(exact, F.col("__maybe") & (F.col("__key") == F.col("__known")), "left")
    out = joined.withColumn("listed", F.col("__known").isNotNull())
    verdict = F.when(F.col("listed"), "block").otherwise("allow")
    for text, v in rules:
        verdict = F.when(F.col("rule") == text, v).otherwise(verdict)
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), "canonical", "listed")


def referral_list(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs of pages that carry a referral mark (a ``ref`` parameter) in any of their spellings.

    ``canonical``, each once; null and empty URLs carry none, and one without a
    host gives the empty string, which judge() ignores.
    """
    u = F.col(url).cast("string")
    return pages.where(F.regexp_like(u, F.lit(r"[?&]ref="))).select(canonical(host(u), path(u)).alias("canonical")).distinct()
