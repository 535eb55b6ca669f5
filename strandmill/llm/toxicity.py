"""Toxicity: a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of its longer words, hashed; a
text counts each bucket once. The machine adds to the linear weights a low-rank
weight for every pair of terms, so that an insult beside a group's name can weigh
more than the two apart. No term is left out for having no effect of its own:
penalties on the weights and on the length of each vector decide.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow

#: Hash buckets of the terms.
BUCKETS = 1 << 18
#: Labelled documents that the machine is fitted on, toxic ones at most half of them.
SAMPLE = 12_000
#: Length of a term's vector.
RANK = 4
_WORD = re.compile(r"[^\W\d_]+")
#: A training term must occur in so many training documents; one of a single document can't be told from chance.
MIN_DOCS = 2
#: Letters of a word's beginning.
STEM = 5
#: Penalties: on a weight's size, and on a vector's length.
SPARSE_W, SPARSE_V = 4e-3, 4e-3


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_terms(word: str) -> tuple[str, ...]:
    """A lower-cased word, and its beginning under a mark of its own if it is longer."""
    return (word, f"^{word[:STEM]}") if len(word) > STEM else (word,)


def terms(text: str) -> list[str]:
    """Distinct terms of the lower-cased words of letters, in order of their spelling."""
    return sorted({t for w in set(_WORD.findall(text.lower())) for t in word_terms(w)})


@dataclass(frozen=True)
class Machine:
    """bias + sum w_i + sum over pairs <v_i, v_j>, over the buckets that training kept."""

    bias: float
    ids: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def index(self) -> dict[int, int]:
        return {int(b): i for i, b in enumerate(self.ids)}

    def score(self, rows: list[int]) -> float:
        """Probability of toxic for the places in ``ids`` of a text's known terms."""
        z = self.bias
        if rows:
            v = self.v[rows]
            s = v.sum(0)
            z += self.w[rows].sum() + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values (or of each column) by their places."""
    if values.ndim == 1:
        return np.bincount(at, values, n)
    return np.stack([np.bincount(at, column, n) for column in values.T], 1)


def fit_machine(docs: list[np.ndarray], y: np.ndarray, rank: int = RANK, rounds: int = 12, rate: float = 0.06, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss, both labels of equal weight in all.

    ``docs`` are the sorted distinct buckets of each text. Buckets in fewer than
    MIN_DOCS texts are left out. After each step a weight shrinks by its penalty,
    to zero at most, and so does a vector as a whole: what the labels don't ask
    for goes. Without both labels the score is the majority's.
    """
    if not len(docs) or y.min() == y.max():
        return Machine(0.0 if not len(docs) else (4.0 if y[0] else -4.0), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    ids = np.flatnonzero(np.bincount(np.concatenate(docs), minlength=BUCKETS) >= MIN_DOCS)
    place = np.full(BUCKETS, -1)
    place[ids] = np.arange(len(ids))
    rows = [r[r >= 0] for r in (place[d] for d in docs)]
    rng = np.random.default_rng(seed)
    b, w, v = 0.0, np.zeros(len(ids)), rng.normal(0, 0.03, (len(ids), rank))
    #: sums of squared gradients
    seen_b, seen_w, seen_v = 1e-8, np.full(len(ids), 1e-8), np.full(len(ids), 1e-8)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            batch = order[at : at + 256]
            flat = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            own = v[flat]
            s = _sums(of, own, len(batch))
            z = b + _sums(of, w[flat], len(batch)) + 0.5 * ((s * s).sum(1) - _sums(of, (own * own).sum(1), len(batch)))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[batch]) * weight[batch] / len(batch)
            used, slot = np.unique(flat, return_inverse=True)
            gw, gv = _sums(slot, err[of], len(used)), _sums(slot, err[of][:, None] * (s[of] - own), len(used))
            seen_b += err.sum() ** 2
            b -= rate * err.sum() / np.sqrt(seen_b)
            seen_w[used] += gw * gw
            step = rate / np.sqrt(seen_w[used])
            moved = w[used] - step * gw
            w[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSE_W, 0)
            seen_v[used] += (gv * gv).mean(1)
            step = 0.4 * rate / np.sqrt(seen_v[used])
            moved = v[used] - step[:, None] * gv
            v[used] = moved * np.maximum(1 - step * SPARSE_V / np.maximum(np.sqrt((moved * moved).sum(1)), 1e-12), 0)[:, None]
    kept = np.flatnonzero((w != 0) | (v != 0).any(1))
    return Machine(float(b), ids[kept].astype(np.int64), w[kept], v[kept])


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id isn't."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents that aren't held out.

    Taken are the rows with the least hashes of their id, up to half of them
    toxic, whatever the partitions; only these texts are tokenised. A document
    with several labels counts as toxic if any says so; null labels don't count.
    Of rows that share an id, the one with the least terms in byte order counts.
    Null and empty texts have no terms; without labelled rows every score is 0.5.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("k")).agg(F.max(label).cast("int").alias("y"))
    order = F.xxhash64("k", F.lit(3))
    ids = [(r["k"], r["y"]) for y in (1, 0) for r in marked.where(F.col("y") == y).orderBy(order).limit(sample // 2).collect()]
    if not ids:
        return fit_machine([], np.zeros(0))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(ids, "k long, y int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [np.array(sorted({bucket(t) for t in terms(c.as_py() or "")}), np.int32).tobytes() for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary())], names=["k", "y", "x"])

    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).join(wanted, "k").select("k", "y", "text")
    # One row of an id, the same whatever the partitions, however many rows have it.
    one = map_in_arrow(source, run, "k long, y int, x binary").groupBy("k", "y").agg(F.min("x").alias("x"))
    got = sorted(one.collect())
    return fit_machine([np.frombuffer(r[2], np.int32) for r in got], np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted``, one row per input row.

    A null text is scored as an empty one, which has the bias alone. Texts are
    read whole, one at a time; repeated rows and equal texts have equal scores.
    """
    source = docs.select(F.col(key).cast("long").alias(key), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = machine.index()
        for batch in batches:
            known: dict[str, tuple[int, ...]] = {}  # a word's places; bounded below
            out = []
            for cell in batch.column(2):
                places: set[int] = set()
                for word in set(_WORD.findall((cell.as_py() or "").lower())):
                    at = known.get(word)
                    if at is None:
                        if len(known) > 200_000:
                            known.clear()
                        at = known[word] = tuple(i for t in word_terms(word) if (i := index.get(bucket(t), -1)) >= 0)
                    places.update(at)
                out.append(machine.score(sorted(places)))
            s = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s, pa.array([int(x >= 0.5) for x in out], pa.int32())], names=[key, "held_out", "score", "predicted"])

    return map_in_arrow(source, run, f"{key} long, held_out boolean, score double, predicted int")
