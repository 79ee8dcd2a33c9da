"""Divergence of sources by the terms they favour.

Kept terms of a language, those in at least ``min_docs`` of its documents, are found by iceberg prefix refinement: byte
prefixes of 5, 10, 20, ... bytes, each level counting the distinct documents of the prefixes whose shorter prefix passed.
No term is in more documents than any of its prefixes, so a prefix below the threshold takes all its terms with it. A
term that ends within a level's length is followed by a zero byte there: its count is final. The levels end when only
complete terms remain.

The passed prefixes go to the tasks as a bitmap of their hashes, of a fixed largest size. A collision keeps a prefix one
level longer and never changes a result, for every level counts exactly. The texts are cut anew at each level: that costs less
than a written table of every document's terms, and needs no disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import written

#: Terms are runs of ASCII letters and of all characters beyond ASCII: bytes that belong to one, and their lower case.
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IN_TERM = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
MIN_DOCS = 30
FIRST_BYTES = 5
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Bits of the bitmap of passed prefixes: 16 for each, between these bounds (2 MB at most at the upper one's default).
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
_END = b"\x00"
#: Text of one step inside a task.
_HELD_BYTES = 6 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with about ``_HELD_BYTES`` of text."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column("text")), np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _HELD_BYTES)))
        yield batch.slice(start, stop - start)
        start = stop


def terms_of(texts: pa.BinaryArray, least: int = 0) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray]:
    """Every term of at least ``least`` bytes: the row and the number in the list of distinct terms; that list.

    Terms are the runs of term bytes; lower-casing and cutting are done for all texts at once.
    """
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]: bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = _IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, sizes = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = sizes - starts
    row = np.searchsorted(bounds, starts, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])])
    if least > 1:
        long = sizes >= least
        terms, row = terms.filter(pa.array(long)), row[long]
    found = terms.dictionary_encode()
    return row, np.asarray(found.indices, np.int64), found.dictionary


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = column.dictionary_encode()
    return np.asarray(found.indices, np.int64), found.dictionary


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the times of each; numpy sorts faster than it hashes."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def _places(lang: str, prefixes: list[bytes], bits: int) -> np.ndarray:
    """The bit of each of a language's prefixes."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in prefixes), np.uint64, len(prefixes)) & np.uint64(bits - 1)


def _passed(bitmap: np.ndarray, langs: pa.Array, prefixes: pa.Array, at: np.ndarray) -> np.ndarray:
    """Whether each ``language * len(prefixes) + prefix`` of ``at`` has its bit."""
    ok = np.zeros((len(langs), len(prefixes)), bool)
    ok.ravel()[at] = True
    for lang, row in zip(langs.to_pylist(), ok):
        present = np.flatnonzero(row)
        places = _places(lang, prefixes.take(pa.array(present)).to_pylist(), 8 * len(bitmap))
        row[present] = bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1
    return ok.ravel()[at]


def level_keys(terms: pa.BinaryArray, length: int) -> pa.BinaryArray:
    """The first ``length`` bytes of each term and its end mark."""
    return pc.binary_slice(pc.binary_join_element_wise(terms, pa.scalar(_END), pa.scalar(b"")), 0, length)


def _level_rows(batches: Iterator[pa.RecordBatch], length: int, before: int, bitmap) -> Iterator[pa.RecordBatch]:
    """Per slice and (language, key): the documents with a term of the key whose shorter prefix passed."""
    bitmap = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
    for whole in batches:
        for batch in _slices(whole):
            row, term, terms = terms_of(batch.column("text"), before)
            if not len(row):
                continue
            lang_of, langs = _coded(batch.column("lang"))
            if bitmap is not None:
                prefix, prefixes = _coded(pc.binary_slice(terms, 0, before))
                alive = _passed(bitmap, langs, prefixes, lang_of[row] * len(prefixes) + prefix[term])
                row, term = row[alive], term[alive]
            key, keys = _coded(level_keys(terms, length))
            # a document counts once for all its terms of a key, which are of its one language
            once, _ = _distinct(row * len(keys) + key[term])
            docs = np.bincount(lang_of[once // len(keys)] * len(keys) + once % len(keys))
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(at // len(keys))), keys.take(pa.array(at % len(keys))), pa.array(docs[at])],
                names=["lang", "key", "docs"])


def _count_rows(batches: Iterator[pa.RecordBatch], bitmap) -> Iterator[pa.RecordBatch]:
    """Per slice and (language, source, term with its end mark): occurrences of the terms in the bitmap."""
    bitmap = np.frombuffer(bitmap.value, np.uint8)
    for whole in batches:
        for batch in _slices(whole):
            row, term, terms = terms_of(batch.column("text"))
            if not len(row):
                continue
            (lang_of, langs), (source_of, sources) = _coded(batch.column("lang")), _coded(batch.column("source"))
            keys = level_keys(terms, 1 << 30)
            alive = _passed(bitmap, langs, keys, lang_of[row] * len(keys) + term)
            group = (lang_of * len(sources) + source_of)[row[alive]]
            found, n = _distinct(group * len(keys) + term[alive])
            group = found // len(keys)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))),
                 keys.take(pa.array(found % len(keys))), pa.array(n)], names=["lang", "source", "key", "n"])


def _bitmap_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(bits // 64, np.uint64)
    for batch in batches:
        lang_of, langs = _coded(batch.column(0))
        for g, lang in enumerate(langs.to_pylist()):
            places = _places(lang, batch.column(1).filter(pa.array(lang_of == g)).to_pylist(), bits)
            np.bitwise_or.at(held, places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63)))
    words = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array(words, pa.int64()), pa.array(held[words].view(np.int64), pa.int64())], names=["word", "bits"])


def bitmap_of(prefixes: DataFrame, n: int) -> bytes:
    """Bitmap over the hashes of (lang, key), at most ``MAX_BITS`` whatever ``n``."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * n).bit_length()))
    words = prefixes.select("lang", "key").mapInArrow(lambda it: _bitmap_words(it, bits), "word long, bits long")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.tobytes()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n: occurrences of each language's kept terms in the sources that have them.

    Every row is a document, also where ids repeat; a term counts once a document. NULL text, lang and source are ''.
    """
    spark = docs.sparkSession
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(name("lang"), name("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = rows.select("lang", "text")
    length, before, bitmap = FIRST_BYTES, 0, None
    complete = []
    while True:
        level = texts.mapInArrow(
            lambda it, a=length, b=before, c=bitmap: _level_rows(it, a, b, c), "lang string, key binary, docs long")
        passed = written(level.groupBy("lang", "key").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
                         .select("lang", "key", F.expr("endswith(key, X'00')").alias("complete")), "passed")
        complete.append(passed.filter("complete").select("lang", "key"))
        longer = passed.filter("not complete")
        n = longer.count()
        if not n:
            break
        bitmap = spark.sparkContext.broadcast(bitmap_of(longer, n))
        length, before = 2 * length, length
    kept = complete[0]
    for part in complete[1:]:
        kept = kept.unionByName(part)
    bitmap = spark.sparkContext.broadcast(bitmap_of(kept, kept.count()))
    counts = rows.mapInArrow(lambda it, a=bitmap: _count_rows(it, a), "lang string, source string, key binary, n long")
    term = F.expr("cast(substring(key, 1, octet_length(key) - 1) as string)")
    return written(counts.groupBy("lang", "source", "key").agg(F.sum("n").alias("n")).join(kept, ["lang", "key"])
                   .select("lang", "source", term.alias("term"), "n"), "kept-terms")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), in whole numbers; NULL without kept terms."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    above = whole(whole(count, 20) + F.lit(SMOOTH), 21) * whole(F.lit(SCALE), 10)
    below = whole(total, 20) + whole(F.lit(SMOOTH), 3) * whole(terms, 15)
    return F.when(terms > 0, F.call_function("div", above, below) + F.lit(1))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of each (lang, source): its distances from the language's other sources
    (``pair``) and the terms it favours over the language (``term``, ``top`` of them).

    NULL lang, source and text are ''. A source without terms takes part with counts of 0; a language without kept
    terms has pairs of value 0. Equal values rank by item. An empty table gives no rows.

    Distances sum over all kept terms, present or not, yet only present ones are joined: with p0 the share of an absent
    term, |p - q| of a term that one source lacks follows from the other's share alone, and these are counted by share.
    """
    kept = kept_terms(docs, min_docs)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    of_lang = written(kept.groupBy("lang", "term").agg(F.sum("n").alias("n")), "lang-terms")
    langs = of_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = (docs.select(name("lang"), name("source")).distinct().join(totals, ["lang", "source"], "left")
              .join(langs, "lang", "left").select(
                  "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("total", zero).alias("total"),
                  F.coalesce("lang_total", zero).alias("lang_total")))
    groups = written(groups.withColumn("p0", F.coalesce(_share(zero, F.col("total"), F.col("v")), zero)), "groups")
    shares = written(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0", "v", "lang_total"), "shares")
    # terms
    both = shares.join(of_lang, ["lang", "term"]).withColumn("q", _share(F.col("n"), F.col("lang_total"), F.col("v")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    favoured = (both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                            (F.col("p") - F.col("q")).alias("value"))
                .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    # pairs: what differs from |p0 of one - p0 of the other| for each kept term
    gap = F.abs(F.col("a0") - F.col("b0"))
    ours = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    theirs = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = ours.join(theirs, "lang").filter("a <> b").select("lang", "a", "b", (F.col("v") * gap).alias("x"))
    by_share = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("a0")).agg(F.count(F.lit(1)).alias("n"))
    single = by_share.join(theirs, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("n") * (F.abs(F.col("p") - F.col("b0")) - gap)).alias("x"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"), F.col("p0").alias("a0"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("b0"))
    joint = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(
        F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("a0") - F.col("q")) + gap).alias("x"))
    turned = lambda d: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "x")
    parts = pairs.unionByName(single).unionByName(turned(single)).unionByName(joint).unionByName(turned(joint))
    distances = (parts.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("x").alias("value"))
                 .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
                 .withColumn("rank", F.row_number().over(order)))
    return distances.unionByName(favoured)
