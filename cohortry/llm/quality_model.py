"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. Expectation-maximisation over the counts of vote
patterns of the whole corpus estimates how each labeller votes on good and on bad documents; the posterior labels of a bounded
sample train a hashed linear scorer, which scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import hash_share, sampled, words_of
from cohortry.llm.quality import Hasher, base_rules

#: Documents in the bounded sample that the scorer is fitted on, and its hash buckets.
SAMPLE_ROWS, BUCKETS = 6_000, 1 << 15
ROUNDS, STEPS, RATE, SHRINK = 100, 60, 0.3, 1e-4
THRESHOLD = 0.5
#: Votes, bad below the first bound and good above the second (or the other way round where the first is higher).
BOUNDS = {
    "words": (20, 50), "word_length": (2.5, 3.2), "long_words": (14.0, 9.0), "symbols": (0.1, 0.02), "repeats": (0.5, 0.1),
    "duplicate_lines": (0.3, 0.05), "capitals": (0.4, 0.15), "distinct": (0.15, 0.3),
}


def measures(text: str | None) -> tuple[list[str], list[float]]:
    words = words_of(text)
    n, chars, symbols, dup, repeat, _ = base_rules(text, words)
    n = max(n, 1)
    letters = sum(map(str.isalpha, text or "")) or 1
    mean = chars / n
    lines = (text or "").count("\n") + 1
    return words, [len(words), mean, mean, symbols / n, repeat / n, dup / lines, sum(map(str.isupper, text or "")) / letters,
                   len(set(words)) / n ** 0.75]


def votes(values: list[float]) -> list[int]:
    """0 bad, 1 good, 2 abstain for each labeller."""
    out = []
    for x, (bad, good) in zip(values, BOUNDS.values()):
        sign = 1 if good > bad else -1
        out.append(0 if sign * x < sign * bad else 1 if sign * x >= sign * good else 2)
    return out


def pattern_of(cast: list[int]) -> int:
    return sum(v * 3 ** k for k, v in enumerate(cast))


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """Counts of vote patterns over all documents: at most 3 to the number of labellers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3 ** len(BOUNDS), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sums[pattern_of(votes(measures(text)[1]))] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in rows.collect()}


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """EM: (P(vote | class) as [labeller, class, vote], share of good documents). Class 1 is good: the start has every
    labeller right more often than wrong."""
    size = len(BOUNDS)
    table = np.tile(np.array([[0.5, 0.2, 0.3], [0.1, 0.6, 0.3]]), (size, 1, 1))
    good = 0.8
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    cast = patterns[:, None] // 3 ** np.arange(size) % 3
    for _ in range(rounds if len(patterns) else 0):
        p = posterior(cast, table, good) * weight
        q = weight - p
        good = float(np.clip(p.sum() / weight.sum(), 0.01, 0.99))
        for k in range(size):
            for c, mass in ((0, q), (1, p)):
                seen = np.bincount(cast[:, k], mass, 3) + np.array([[2, 1, 1], [1, 2, 1]])[c]
                table[k, c] = seen / seen.sum()
    return table, good


def posterior(cast: np.ndarray, table: np.ndarray, good: float) -> np.ndarray:
    """Probability of being good for each row of votes; an abstention says what it says by its own rate."""
    k = np.arange(table.shape[0])
    log = [np.log(table[k, c, cast]).sum(1) + np.log(p) for c, p in ((0, 1 - good), (1, good))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def train(docs: DataFrame, table: np.ndarray, good: float, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of the hashed linear scorer (the last one is the bias), from about ``sample`` distinct texts chosen by hash."""
    docs = docs.filter("text IS NOT NULL")
    n = docs.select(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
    rows = docs.filter(hash_share(F.col("text"), sample, n)).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BUCKETS)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, values = measures(text)
                p = float(posterior(np.array([votes(values)]), table, good)[0])
                grams = np.unique(hasher.grams(words)).astype(np.int32) if words else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([grams.tolist()], pa.list_(pa.int32()))], names=["p", "x"])

    got = sorted((r.p, r.x) for r in sampled(rows.mapInArrow(run, "p double, x array<int>").collect(), n))
    w, square = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    if not got:
        return w
    y, size = np.array([p for p, _ in got]), np.array([len(x) for _, x in got])
    of, at = np.repeat(np.arange(len(got)), size), np.array([k for _, x in got for k in x], np.int64)
    scale = 1 / np.sqrt(np.maximum(size, 1))
    # both classes weigh the same, so the few bad documents are learned
    balance = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for _ in range(STEPS):
        z = np.bincount(of, w[at], len(got)) * scale + w[-1]
        e = (1 / (1 + np.exp(-z)) - y) * balance
        g = np.append(np.bincount(at, (e * scale)[of], BUCKETS), e.sum()) + SHRINK * w
        square += g * g
        w -= RATE * g / np.sqrt(square)
    return w


def classify(docs: DataFrame, table: np.ndarray, good: float, weights: np.ndarray) -> DataFrame:
    """doc_id, score, weak_label (posterior of the votes), kept for every row.

    A document is dropped only if scorer and votes both call it bad. NULL and empty texts have the bias as their score.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(BUCKETS)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words, values = measures(text)
                x = np.unique(hasher.grams(words)).astype(np.int64) if words else np.zeros(0, np.int64)
                z = weights[x].sum() / np.sqrt(max(len(x), 1)) + weights[-1]
                p = float(posterior(np.array([votes(values)]), table, good)[0])
                s = float(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                out.append((s, p, s >= THRESHOLD or p >= THRESHOLD))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "score", "weak_label", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, weak_label double, kept boolean")
