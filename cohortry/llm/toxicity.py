"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import hash_share, small_side, words_of

#: Bound of the labelled sample that is fitted on, and of the learned lexicon.
SAMPLE_ROWS = 20_000
LEXICON_TERMS = 2_000
BROADCAST_IDS = 2_000_000
#: A term enters the lexicon with at least so many toxic documents, this ratio of rates and this evidence (G).
MIN_DOCS, MIN_RATIO, MIN_G = 5, 5.0, 20.0
PREFIXES = (4, 5, 6)
NEAR = 6
#: Facts of so many distinct words are kept in a task.
WORDS_KEPT = 200_000
INSULTS = frozenset(["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
                     "dumb", "fool", "jerk", "ugly", "hate"])
SECOND_PERSON = frozenset(["you", "your", "yours", "du", "dich", "dir", "dein", "tu", "te", "toi", "vous", "votre",
                           "usted", "ti", "tus", "ihr", "euch"])
_EDGE = ".,!?;:\"'()[]{}-"
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_MIXED = re.compile(r"[^\W\d_]+[\d@$*#!.\-]+[^\W\d_]")
_INNER = re.compile(r"[*#.\-_|]")
FEATURES = ["words", "insult_density", "learned_density", "learned_distinct", "learned_best", "learned_sum", "near_you",
            "you_density", "capitals", "shouted", "exclaim", "question", "punctuation", "obfuscated", "hidden_insults"]


def _terms(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        out.add(w)
        out.update(f"{w[:n]}*" for n in PREFIXES if len(w) > n)
    return out


def _plain(words: list[str]) -> list[str]:
    return [x for w in words if (x := w.strip(_EDGE).lower())]


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of a deterministic sample of about ``sample_rows`` labelled rows (NULL ids and labels left out).

    Repeated labels of an id count once (toxic wins).
    """
    marks = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id"))
             .agg(F.max("toxic").cast("int").alias("toxic")))
    n = marks.count()
    if n > sample_rows:
        marks = marks.filter(hash_share(F.col("_id"), sample_rows, n))
    marks = small_side(marks, min(n, sample_rows), BROADCAST_IDS)
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_id")).select("text", "toxic")


def learn_lexicon(sample: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Words and word beginnings (``abcd*``) that mark toxic documents, with their log ratio of document rates."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(toxic > 0)].update(_terms(_plain(words_of(text))))
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), *(pa.array([seen[k][t] for t in every], pa.int64()) for k in (0, 1))],
            names=["term", "clean", "bad"])

    totals = {r.bad: r.n for r in sample.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, clean = totals.get(True, 0), totals.get(False, 0)
    if not bad or not clean:
        return {}
    counts = sample.mapInArrow(count, "term string, clean long, bad long").groupBy("term").agg(
        F.sum("clean").alias("c"), F.sum("bad").alias("b"))
    ratio = ((F.col("b") + 0.5) / bad) / ((F.col("c") + 0.5) / clean)
    expected = (F.col("b") + F.col("c")) * (bad / (bad + clean))
    found = (counts.filter(F.col("b") >= MIN_DOCS).withColumn("ratio", ratio)
             .withColumn("g", 2 * F.col("b") * F.log(F.col("b") / expected))
             .filter((F.col("ratio") >= MIN_RATIO) & (F.col("g") >= MIN_G))
             .orderBy(F.desc("g"), "term").limit(terms).select("term", F.log("ratio").alias("w")).collect())
    return {r.term: r.w for r in found}


class Featurizer:
    """Dense features of whole texts. What depends on one word alone is worked out once and kept."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.beginnings = lexicon, {t[:4] for t in lexicon}
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 9))

    def _facts(self, word: str) -> tuple:
        """Plain form (-1: none), its weight, insult, second person, letters, capitals, shouted, mixed, hidden insult."""
        plain, weight = word.strip(_EDGE).lower(), 0.0
        if plain[:4] in self.beginnings:
            weight = max(self.lexicon.get(t, 0.0) for t in (plain, *(f"{plain[:k]}*" for k in PREFIXES if len(plain) > k)))
        insult, letters, mixed, hidden = plain in INSULTS, len(word), False, False
        if not word.isalpha():
            letters, mixed = sum(map(str.isalpha, word)), bool(_MIXED.search(word))
        if mixed:
            bare = _INNER.sub("", word.lower()).translate(_LEET).strip(_EDGE)
            hidden = bare in INSULTS or bare in self.lexicon
        return (self.plain.setdefault(plain, len(self.plain)) if plain else -1, max(weight, float(insult)), insult,
                plain in SECOND_PERSON, letters, 0 if word.islower() else sum(map(str.isupper, word)),
                word.isupper() and len(word) > 1, mixed, hidden)

    def __call__(self, text: str | None) -> list[float]:
        """All 0 for NULL and empty texts."""
        raw = words_of(text)
        if not raw:
            return [0.0] * len(FEATURES)
        if len(self.words) > WORDS_KEPT:
            self._clear()
        if new := list(set(raw).difference(self.words)):
            lo, hi = len(self.words), len(self.words) + len(new)
            while hi > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[lo:hi] = [self._facts(w) for w in new]
            self.words.update(zip(new, range(lo, hi)))
        facts = self.table[np.fromiter(map(self.words.__getitem__, raw), np.int64, len(raw))]
        n = len(raw)
        _, _, _, _, letters, capitals, shouted, mixed, hidden = facts.sum(axis=0)
        facts = facts[facts[:, 0] >= 0]
        hits, you = np.flatnonzero(facts[:, 1]), np.flatnonzero(facts[:, 3])
        near = 0
        if len(hits) and len(you):
            at = np.searchsorted(you, hits)
            left = np.abs(you[np.maximum(at - 1, 0)] - hits)
            right = np.abs(you[np.minimum(at, len(you) - 1)] - hits)
            near = int((np.minimum(left, right) <= NEAR).sum())
        _, first = np.unique(facts[hits, 0], return_index=True)
        found = facts[hits[first], 1]
        insults = int(facts[:, 2].sum())
        return [float(min(n, 5000)), 1000.0 * insults / n, 1000.0 * len(hits) / n, float(len(found)),
                float(found.max(initial=0.0)), float(found.sum()), 1000.0 * near / n, 1000.0 * len(you) / n,
                capitals / (letters or 1), shouted / n, 1000.0 * text.count("!") / n, 1000.0 * text.count("?") / n,
                1000.0 * sum(map(text.count, ".,;:")) / n, 1000.0 * mixed / n, 1000.0 * hidden / n]


class Boosted:
    """Logistic gradient boosting on binned features, trees of fixed depth stored as arrays."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        width, margin = self.bins + 1, np.full(len(y), self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-margin))
            grad, hess = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full(2 ** self.depth - 1, -1), np.full(2 ** self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2 ** level - 1, 2 ** level
                best_gain, choice = np.full(count, 1e-6), [None] * count
                for f in range(x.shape[1]):
                    slot = node * width + binned[:, f]
                    g = np.bincount(slot, grad, count * width).reshape(count, width).cumsum(1)
                    h = np.bincount(slot, hess, count * width).reshape(count, width).cumsum(1)
                    gain = (g ** 2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge)
                            - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge))[:, : len(cuts[f])]
                    for k in range(count) if gain.shape[1] else ():
                        b = int(gain[k].argmax())
                        if gain[k, b] > best_gain[k]:
                            best_gain[k], choice[k] = gain[k, b], (f, b)
                right = np.zeros(len(y), bool)
                for k, got in enumerate(choice):
                    if got:
                        feature[first + k], cut[first + k] = got[0], cuts[got[0]][got[1]]
                        right |= (node == k) & (binned[:, got[0]] > got[1])
                node = node * 2 + right
            leaves = 2 ** self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.ridge)
            self.trees.append((feature, cut, value))
            margin += value[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2 ** self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, rate) of the non-decreasing fit; equal scores are pooled first."""
    knots, inverse = np.unique(score, return_inverse=True)
    total, weight = np.bincount(inverse, y), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []  # sum, weight, first knot, last knot
    for k in range(len(knots)):
        pools.append([total[k], weight[k], k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][3] = last
    at = np.array([k for p in pools for k in (p[2], p[3])])
    rate = np.array([p[0] / p[1] for p in pools for _ in (0, 1)])
    return knots[at], rate


class Model:
    """Trees fitted on three quarters of the sample and calibrated on the rest."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.rate = float(y.mean()) if len(y) else 0.0
        if 0 < self.rate < 1:
            order = np.lexsort([*x.T, y])  # any order of the rows gives the same model
            x, y = x[order], y[order]
            aside = np.arange(len(y)) % 4 == 1
            self.trees = Boosted().fit(x[~aside], y[~aside])
            self.knots, self.rates = isotonic(self.trees.margin(x[aside]), y[aside])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a small part of the raw one keeps an order inside the steps."""
        if self.trees is None:
            return np.full(len(x), self.rate)
        margin = self.trees.margin(x)
        return 0.99 * np.interp(margin, self.knots, self.rates) + 0.01 / (1 + np.exp(-margin))


def feature_rows(rows: DataFrame, lexicon: dict[str, float], keep: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(lexicon)
        for batch in batches:
            got = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=[keep, "x"])

    return rows.select(keep, "text").mapInArrow(run, f"{keep} {kind}, x array<double>")


def fit(sample: DataFrame, terms: int = LEXICON_TERMS) -> Model:
    """Lexicon from the sample by Spark, then a table of at most the sample's size on the driver for the trees."""
    lexicon = learn_lexicon(sample, terms)
    rows = feature_rows(sample, lexicon, "toxic", "int").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return Model(lexicon, x, np.array([float(r.toxic > 0) for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row. NULL and empty texts are scored from all-zero features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(model.lexicon)
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float)
            got = np.clip(model.scores(x.reshape(-1, len(FEATURES))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
