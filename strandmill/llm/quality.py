"""Quality filter: a weak-label model over heuristic labellers, and a hashed scorer.

Labellers vote bad or abstain. Expectation-maximisation over the counts of
their vote patterns, taken over all documents, estimates each labeller's
accuracies without a gold label. The posterior of a pattern labels documents,
and those labels train a linear scorer over hashed character trigrams and binned
statistics, which decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpoint, map_in_arrow

LABELLERS = ("decoration", "shouting", "bars", "stutter", "exclamation", "loops", "letters")
#: Hash buckets of the scorer.
BUCKETS = 2048
#: Documents, of either label at most half of them, that the scorer is fitted on.
SAMPLE = 4000
_BINS = 12
_SIGNS = ("*", "#", "%", "&", "$", "~", "^")


#: Words that a text is taken to have besides its own, all of them good, so that a few odd words in a short text mean little.
_EXTRA = 12


def statistics(text: str) -> np.ndarray:
    """Shares that the labellers read: decoration, capitals, bars, stutter, exclamation, loops, letters.

    An empty text gives the shares of a good one.
    """
    words = text.split()
    n, k = len(words), len(words) + _EXTRA
    for point in ".,;:?":
        text = text.replace(point, " ")
    plain = sum(map(str.isalpha, text.split()))
    return np.array([
        sum(map(text.count, _SIGNS)) / k,
        sum(map(str.isupper, words)) / k,
        text.count("|") / k,
        sum(map(str.__eq__, words, words[1:])) / k,
        text.count("!") / k,
        (len(set(zip(words, words[1:]))) + _EXTRA + 1) / k if n else 1.0,
        (plain + _EXTRA) / k,
    ])


#: For each labeller the bound from which its statistic speaks for bad, and whether it does so below the bound.
_BOUNDS = ((0.15, False), (0.35, False), (0.1, False), (0.15, False), (0.2, False), (0.6, True), (0.72, True))


def votes(s: np.ndarray) -> str:
    """One character a labeller: b for bad, - for abstain."""
    return "".join("b" if (x <= bound if below else x >= bound) else "-" for x, (bound, below) in zip(s, _BOUNDS, strict=True))


@dataclass(frozen=True)
class LabelModel:
    """Junk is of many kinds, each seen by a few labellers: a vote for bad is
    strong evidence, an abstention weak evidence for good."""

    prior_bad: float
    #: for each labeller (P(votes bad | bad), P(votes bad | good))
    accuracy: tuple[tuple[float, float], ...]

    def posterior_bad(self, pattern: str) -> float:
        odds = np.log(self.prior_bad / (1 - self.prior_bad))
        for v, (hit, false) in zip(pattern, self.accuracy, strict=True):
            odds += np.log(hit / false) if v == "b" else np.log((1 - hit) / (1 - false))
        return float(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


def fit_labels(counts: dict[str, int], rounds: int = 300) -> LabelModel:
    """EM over vote patterns, from labellers that are seldom wrong and miss most junk.

    Smoothing keeps rates inside (0, 1); no labeller's vote for bad may speak for good.
    """
    model = LabelModel(0.1, ((0.3, 0.01),) * len(LABELLERS))
    patterns = sorted(counts)
    if not patterns:
        return model
    n = np.array([counts[p] for p in patterns], float)
    bad = np.array([[c == "b" for c in p] for p in patterns], float)
    for _ in range(rounds):
        q = np.array([model.posterior_bad(p) for p in patterns]) * n
        r = n - q
        hit = (q @ bad + 0.3) / (q.sum() + 1)
        false = np.minimum((r @ bad + 0.01) / (r.sum() + 1), hit * 0.5)
        new = LabelModel(float(np.clip((q.sum() + 0.1) / (n.sum() + 1), 1e-4, 0.9)), tuple(zip(hit.tolist(), false.tolist(), strict=True)))
        done = abs(new.prior_bad - model.prior_bad) < 1e-9
        model = new
        if done:
            break
    return model


def features(text: str, s: np.ndarray) -> np.ndarray:
    """Frequencies of hashed byte trigrams, and the statistics binned and hashed, as float32."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS, np.float32)
    if raw.size >= 3:
        for at in range(0, raw.size - 2, 1 << 16):
            b = raw[at : at + (1 << 16) + 2].astype(np.uint32)
            code = ((b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA77) ^ (b[2:] * 0xC2B2AE3D)) >> np.uint32(21)
            out += np.bincount(code, minlength=BUCKETS)[:BUCKETS].astype(np.float32)
        out *= np.float32(20 / (raw.size - 2))
    binned = np.minimum(np.sqrt(np.clip(s, 0, 1)) * _BINS, _BINS - 1).astype(np.int64)
    for i, b in enumerate(binned):
        out[(i * 131 + b * 29 + 7) * 2654435761 % BUCKETS] += 1
    return out


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels ``p`` (good), both classes of equal weight, by gradient descent with momentum."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return w, 4.0
    good, bad = p.sum(), (1 - p).sum()
    if min(good, bad) < 1:
        return w, 4.0 if good >= bad else -4.0
    weight = p / good / 2 + (1 - p) / bad / 2
    x = x.astype(np.float32, copy=False)
    vw, vb, rate = np.zeros_like(w), 0.0, 1.0
    for _ in range(rounds):
        z = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        err = (z - p) * weight
        gw, gb = x.T @ err.astype(np.float32) + decay * w, err.sum()
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    return w, float(b)


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str, s: np.ndarray) -> float:
        """Probability that the text is good."""
        return float(1 / (1 + np.exp(-np.clip(features(text, s) @ self.weights + self.bias, -60, 60))))


def _narrow(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Label model from all documents' votes; scorer from at most ``sample`` posterior-labelled ones.

    The sample takes the documents with the least hashes of key and pattern, half of
    them from patterns that are more likely bad, and so doesn't depend on partitioning.
    Null and empty texts vote as good ones; rows with a null key vote but aren't
    sampled; of rows that share a key, the one with the least pattern and features
    is. An empty table gives a scorer that keeps all.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(statistics(c.as_py() or "")) for c in batch.column(1)], pa.string())], names=[key, "pattern"])

    voted = checkpoint(map_in_arrow(_narrow(docs, key, text), vote, f"{key} long, pattern string"))
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = fit_labels(counts)
    posterior = {p: labels.posterior_bad(p) for p in counts}
    bad = [p for p, q in posterior.items() if q > 0.5]
    order = F.xxhash64(key, "pattern")
    chosen = [voted.where(c).orderBy(order, key).limit(sample // 2) for c in (F.col("pattern").isin(bad), ~F.col("pattern").isin(bad))]
    ids = [r[0] for part in chosen for r in part.select(key).distinct().collect() if r[0] is not None]
    if not ids:
        return QualityModel(labels, np.zeros(BUCKETS), 4.0)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], f"{key} long"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                t = cell.as_py() or ""
                s = statistics(t)
                rows.append((votes(s), zlib.compress(features(t, s).tobytes(), 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=[key, "pattern", "x"])

    rows = map_in_arrow(_narrow(docs, key, text).join(wanted, key, "left_semi"), featured, f"{key} long, pattern string, x binary")
    # Sorted, and one row of a key, so that the fit is the same whatever the partitions and however many rows have it.
    got = sorted(rows.groupBy(key).agg(F.min(F.struct("pattern", "x")).alias("r")).select(key, "r.pattern", "r.x").collect())
    x = np.empty((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(zlib.decompress(r[2]), np.float32)
    p = np.array([1 - posterior[r[1]] for r in got])
    return QualityModel(labels, *fit_scorer(x, p))


def judge(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, votes, posterior_bad, score, keep``, one row per input row; an empty or null text is scored as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                t = cell.as_py() or ""
                s = statistics(t)
                v = votes(s)
                rows.append((v, model.labels.posterior_bad(v), score := model.score(t, s), score >= 0.5))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[key, "votes", "posterior_bad", "score", "keep"])

    return map_in_arrow(_narrow(docs, key, text), run, f"{key} long, votes string, posterior_bad double, score double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The documents that the scorer keeps, with all their columns and whatever their names.

    A null or empty text is scored as empty. Each row is judged by its text alone,
    read whole, so equal texts stay or go together.
    """

    @F.pandas_udf("boolean")
    def good(texts):
        return texts.map(lambda t: model.score(t or "", statistics(t or "")) >= 0.5)

    bound_batches(docs.sparkSession)
    return docs.where(good(F.col(text).cast("string")))
