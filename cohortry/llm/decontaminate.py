"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts and items are cut into lower-case words. Of every ``WINDOWS`` consecutive ``GRAM``-word hashes the smallest is kept as
a fingerprint, so any shared span of ``GRAM + WINDOWS - 1`` words leaves a common fingerprint on both sides. Document
fingerprints that the benchmark has are anchors; around each anchor the item-length windows are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import ascii_lower, small_side, written

SPAN = 10
GRAM, WINDOWS = 5, 6
#: Separators between words, as a Java class: ASCII but digits and small letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of up to so many rows are broadcast.
BROADCAST_ROWS = 500_000
#: A fingerprint packs the hash above the position; a text of 2 GB has fewer than 2^30 words.
_POSITION_BITS = 30


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _at(words: Column, i: Column | int) -> Column:
    return F.get(words, i if isinstance(i, Column) else F.lit(i))


def _grams(hashes: Column, words: int, tag: int) -> Column:
    """Packed (hash, position) of each run of ``words`` words; NULL where the run passes the end."""
    def gram(_: Column, i: Column) -> Column:
        parts = [_at(hashes, i + k) for k in range(words)]
        h = F.xxhash64(F.lit(tag), *parts)
        packed = F.shiftleft(F.shiftrightunsigned(h, 31), _POSITION_BITS).bitwiseOR(i.cast("bigint"))
        return F.when(parts[-1].isNotNull(), packed)

    return F.transform(hashes, gram)


def _minima(grams: Column) -> Column:
    """The smallest of every ``WINDOWS`` neighbours. The array ends in ``GRAM - 1`` NULLs, which ``least`` passes over, so
    windows that begin too late are left out by their own first NULL-free end."""
    def lowest(x: Column, i: Column) -> Column:
        last = _at(grams, i + (WINDOWS - 1))
        return F.when(last.isNotNull(), F.least(x, *[_at(grams, i + k) for k in range(1, WINDOWS)]))

    return F.array_distinct(F.transform(grams, lowest))


def fingerprints(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``keep``, span, fp, pos for each fingerprint of ``words``.

    Spans of ten words are winnowed. Shorter items have no room for a window of grams, so the spans of their own length are
    taken whole; that is only done for lengths that the benchmark has.
    """
    hashed = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    arrays = []
    if SPAN in lengths:
        hashed = hashed.withColumn("grams", _grams(F.col("hashes"), GRAM, SPAN))
        arrays.append((SPAN, _minima(F.col("grams"))))
    arrays += [(n, _grams(F.col("hashes"), n, n)) for n in lengths if n < SPAN]
    mask = F.lit((1 << _POSITION_BITS) - 1)
    out = None
    for span, packed in arrays:
        one = hashed.select(*keep, F.explode(packed).alias("v")).filter("v is not null").select(
            *keep, F.lit(span).alias("span"), F.shiftright("v", _POSITION_BITS).alias("fp"),
            F.col("v").bitwiseAND(mask).cast("int").alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out


def _spans(words: Column, starts: Column, span: int) -> Column:
    return F.transform(starts, lambda s: F.struct(
        F.lit(span).alias("span"), s.alias("start"), F.array_join(F.slice(words, s + 1, span), " ").alias("window")))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(window, span, item_id) rows, item words, and the span lengths present (at most ten numbers)."""
    items = benchmark.select("item_id", split_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = written(items.withColumn("span", F.least(F.size("words"), F.lit(SPAN))), "items")
    lengths = sorted(r.span for r in items.select("span").distinct().collect())
    windows = None
    for n in lengths:
        starts = F.sequence(F.lit(0), F.size("words") - n)
        one = items.filter(F.col("span") == n).select("item_id", F.explode(_spans(F.col("words"), starts, n)).alias("w"))
        one = one.select("item_id", "w.span", "w.window")
        windows = one if windows is None else windows.unionByName(one)
    return (written(windows.distinct(), "windows") if lengths else None), items, lengths


def find_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """Per contaminated document: doc_id, tie (text hash), starts (start, span), item_ids. None without any item words."""
    windows, items, lengths = benchmark_windows(benchmark)
    if not lengths:
        return None
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    known = None
    for n in lengths:
        one = fingerprints(items.filter(F.col("span") == n).select("words"), [n], []).select("span", "fp")
        known = one if known is None else known.unionByName(one)
    known = written(known.distinct(), "fingerprints")
    worded = keyed.select("doc_id", "tie", split_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    prints = fingerprints(worded, lengths, ["doc_id", "tie"])
    anchors = prints.join(small_side(known, known.count(), BROADCAST_ROWS), ["span", "fp"])
    anchors = written(anchors.groupBy("doc_id", "tie", "span").agg(F.collect_set("pos").alias("at")), "anchors")

    one_row = F.first  # repeated rows have the same anchors
    ids = anchors.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    some = keyed.join(small_side(ids, anchors.count(), BROADCAST_ROWS),
                      F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_semi")
    some = some.groupBy("doc_id", "tie").agg(one_row("text").alias("text")).select(
        F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), split_words(F.col("text")).alias("words"))
    near = some.join(anchors, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).drop("_id", "_tie")
    spans = None
    for n in lengths:
        last = F.size("words") - n
        reach = WINDOWS - 1 if n == SPAN else 0
        starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.filter(
            F.sequence(F.greatest(F.lit(0), p - reach), p), lambda s: s <= last))))
        one = near.filter(F.col("span") == n).withColumn("starts", starts).select(
            "doc_id", "tie", F.explode(_spans(F.col("words"), F.col("starts"), n)).alias("w"))
        spans = one if spans is None else spans.unionByName(one)
    spans = spans.select("doc_id", "tie", "w.*")
    texts = windows.select("span", "window").distinct()
    count = windows.count()
    hits = written(spans.join(small_side(texts, count, BROADCAST_ROWS), ["span", "window"]), "hits")
    covered = hits.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "span")).alias("starts"))
    named = (hits.select("doc_id", "tie", "span", "window").distinct()
             .join(small_side(windows, count, BROADCAST_ROWS), ["span", "window"])
             .groupBy("doc_id", "tie").agg(F.collect_set("item_id").alias("item_ids")))
    named = named.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "item_ids")
    return covered.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).drop("_id", "_tie")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated.

    A window is ten consecutive words of an item, or all words of a shorter one. NULL and empty texts have no words; items
    without words match nothing; items without an id are hit but not listed. Repeated rows get the same result each.
    """
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
                       F.size(split_words(F.col("text"))).cast("bigint").alias("n_words"))
    found = find_hits(docs, benchmark)
    none = F.array().cast("array<string>")
    if found is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_hit"), none.alias("item_ids"),
                           F.lit(False).alias("contaminated"))
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["start"], x["start"] + x["span"] - 1))))
    found = found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.size(hit).cast("bigint").alias("hit"),
                         F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))).alias("items"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    hits = F.coalesce("hit", F.lit(0))
    return joined.select("doc_id", "n_words", hits.cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("item_ids"),
                         (hits > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows."""
    found = find_hits(docs, benchmark)
    if found is None:
        return docs
    found = written(found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")), "contaminated")
    return docs.join(
        small_side(found, found.count(), BROADCAST_ROWS),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_tie")), "left_anti")
