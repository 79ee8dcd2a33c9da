"""Quality rules and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import small_side, words_of

BUCKETS = 1 << 16
#: Pseudo-count of each bucket of the trusted multinomial; the raw one gets it in proportion to its size.
PRIOR = 20.0
#: Documents whose mean ratio per n-gram is below this are dropped.
THRESHOLD = -0.2
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Most words, in percent, that may stand in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: Trusted ids up to this number are broadcast.
BROADCAST_IDS = 2_000_000
_CACHE = 500_000


class Hasher:
    """Buckets of the 1-grams and 2-grams of a text; word hashes are cached."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def words(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHE:
            known = self.known = {}
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "replace"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def grams(self, words: list[str]) -> np.ndarray:
        one = self.words(words)
        two = (one[:-1] * np.uint64(0x9E3779B1) ^ one[1:]) * np.uint64(0x85EBCA6B)
        return np.concatenate([(one * np.uint64(0xC2B2AE35) >> np.uint64(13)), two >> np.uint64(15)]) % np.uint64(self.buckets)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    often = times[window] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k: n - 2 + k] |= often
    return int(hit.sum())


def base_rules(text: str | None, words: list[str]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, n = text or "", len(words)
    lines = [x for x in text.split("\n") if words_of(x)]
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over the trusted documents and over all documents.

    Each task sums up its own documents, so ``buckets`` rows a task are shuffled and ``buckets`` rows reach the driver,
    however large the corpus is.
    """
    mark = trusted.select(F.col("doc_id").alias("_trusted"))
    marked = docs.select("doc_id", "text").join(
        small_side(mark, mark.count(), BROADCAST_IDS), F.col("doc_id") == F.col("_trusted"), "left"
    ).select("text", F.col("_trusted").isNotNull().alias("trusted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sums = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.bincount(hasher.grams(words_of(text)).astype(np.int64), minlength=buckets)
                sums[1] += got
                if good:
                    sums[0] += got
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])],
                                         names=["bucket", "target", "raw"])

    sums = (marked.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket")
            .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas())
    out = np.zeros((2, buckets), np.int64)
    out[:, sums["bucket"].to_numpy(np.int64)] = sums[["target", "raw"]].to_numpy(np.int64).T
    return out[0], out[1]


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log p_target(bucket) / p_raw(bucket); all 0 without trusted text. Rare buckets shrink towards 0."""
    if not target.sum():
        return np.zeros(len(raw))
    share = target.sum() / raw.sum()
    return np.log((target + prior) / (raw * share + prior))


def assess(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, llr (mean log ratio per n-gram), kept.

    A document is kept if the base rules pass and its llr is not below ``threshold``. NULL and empty texts have no words
    and fail the base rules; a text without n-grams has llr 0. Every row gets one result, repeated rows the same one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(ratios))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                base = base_rules(text, words)
                llr = float(ratios[hasher.grams(words).astype(np.int64)].mean()) if words else 0.0
                out.append((*base, llr, not base[-1] and llr >= threshold))
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=NAMES)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, llr double, kept boolean")


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
