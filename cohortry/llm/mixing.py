"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

A schedule of slots is dealt to sources: slot ``j`` has the golden-ratio point ``frac(j * phi)``, which falls into one
source's interval of cumulative weights. The ``r``-th slot of a source takes block ``r mod blocks`` of that source's
shuffled word stream, cut into blocks of equal length, so each pass over a source is complete before the next begins.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import WORD, small_side, written

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 1.5
MOST = 2.0
BLOCK_WORDS = 1024
#: Documents in one chunk of a running sum, slots in one chunk of a ranking.
CHUNK_ROWS = 20_000
SLOT_CHUNK = 65_536
#: Source tables of up to so many rows are broadcast.
BROADCAST_SOURCES = 100_000

getcontext().prec = 50
_PHI = (Decimal(5).sqrt() - 1) / 2
_SPLIT = 1 << 20


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, shuffle key ``h`` (MD5 of the id; of the text where that is NULL) and a text hash
    ``tie`` for repeated ids."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), text)).alias("h"), F.xxhash64(text).alias("tie"),
    )


def source_targets(rows: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST) -> DataFrame:
    """One row per source: ``s`` (position), total size, weight and target.

    Positions follow code points, NULL last; weights repeat over positions. Targets share ``epochs`` times all words by
    weight and stop at ``most`` times the source; each round gives the excess of stopped sources to the others by weight.
    Only the source table is touched: one row per distinct source, two scalars a round on the driver.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int"))
    sources = written(sources.select("*", at.cast("bigint").alias("s"), weight.alias("weight")), "sources")
    total, everything = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, open_weight = epochs * float(total or 0), float(everything or 0)
    level = 0.0
    stopped = F.col("source_size") * most
    while open_weight > 0:
        level = left / open_weight
        over = stopped <= F.col("weight") * level
        full, rest = sources.agg(
            F.sum(F.when(over, stopped)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        remaining, rest = epochs * float(total or 0) - float(full or 0), float(rest or 0)
        if rest == open_weight:
            break
        left, open_weight = remaining, rest
    return sources.withColumn("target", F.least(stopped.cast("double"), F.col("weight") * level))


def _positions(rows: DataFrame) -> DataFrame:
    """Add ``at``: words of the source before this document, in shuffled order.

    The order is cut at hash prefixes into chunks of about ``CHUNK_ROWS`` documents; chunk totals carry the offsets, so a
    source with a third of all rows is spread over many tasks.
    """
    prefix = F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint")
    rows = rows.withColumn("chunk", F.floor(prefix * F.ceil(F.col("docs") / CHUNK_ROWS) / (1 << 28)))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("s", "chunk").agg(F.sum("size").alias("in_chunk"))
    chunks = chunks.select("s", "chunk", F.coalesce(F.sum("in_chunk").over(before), F.lit(0)).alias("offset"))
    within = (Window.partitionBy("s", "chunk").orderBy("h", "doc_id", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.join(chunks, ["s", "chunk"])
            .withColumn("at", F.col("offset") + F.sum("size").over(within) - F.col("size")).drop("chunk", "offset"))


def schedule(sources: DataFrame) -> DataFrame:
    """Slots (j, s, r): ``s`` from the golden-ratio point of ``j``, ``r`` its rank among the slots of ``s``.

    Every source gets its needed slots plus the discrepancy bound of the sequence, so none can come up short.
    """
    spark = sources.sparkSession
    needed = sources.agg(F.sum("slots"), F.count(F.lit(1))).first()
    total, count = int(needed[0] or 0), int(needed[1] or 0)
    margin = 8 + math.ceil(5 * math.log(total + count + 2))
    slots = total + count * margin
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = max(1024, 4 * count)
    share = F.col("slots") + margin
    intervals = (
        sources.withColumn("hi", F.sum(share).over(upto)).withColumn("lo", F.col("hi") - share)
        .select("s", "lo", "hi", F.explode(F.sequence(
            F.floor(F.col("lo") * grid / slots), F.floor(F.col("hi") * grid / slots))).alias("cell"))
    )
    high = float((_PHI * _SPLIT) % 1)
    turn = (F.floor(F.col("j") / _SPLIT) * high) + (F.col("j") % _SPLIT + 1) * float(_PHI)
    points = spark.range(slots).withColumnRenamed("id", "j").withColumn("u", turn - F.floor(turn))
    points = points.withColumn("point", F.col("u") * slots).withColumn("cell", F.floor(F.col("u") * grid))
    dealt = (
        points.join(small_side(intervals, count + grid, BROADCAST_SOURCES), "cell")
        .filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
        .select("j", "s", F.floor(F.col("j") / SLOT_CHUNK).alias("turns"))
    )
    before = Window.partitionBy("s").orderBy("turns").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("s", "turns").count()
    counts = counts.select("s", "turns", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("s", "turns").orderBy("j"))
    return dealt.join(counts, ["s", "turns"]).select("j", "s", (F.col("earlier") + rank - 1).alias("r"))


def mix(rows: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, most: float = MOST,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """Words taken from each document: doc_id, source, tie, size, source_size, target, taken, and ``slot``, the first slot
    of the schedule that takes any of them (NULL where nothing is taken).

    ``rows`` comes from :func:`sized`. The mix takes the rounded target of each source: whole passes first, then the
    beginning of one more, so a document is taken at most ``ceil(most)`` times. NULL and empty texts have size 0 and are
    taken 0 times; NULL is a source of its own; repeated rows stand beside each other and are taken one after the other;
    an empty table gives an empty result. Reruns agree, as the order hangs on ids and texts alone.
    """
    rows = written(rows, "sizes")
    sources = source_targets(rows, weights, epochs, most)
    length = F.ceil(F.col("source_size") / F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
    sources = sources.withColumn("block", F.greatest(F.lit(1), length)).withColumn(
        "words", F.round("target").cast("bigint")
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0)
    sources = written(sources.withColumn("blocks", blocks).withColumn(
        "slots", passes * blocks + F.ceil((F.col("words") - passes * F.col("source_size")) / F.col("block"))
    ), "targets")
    known = small_side(sources.drop("weight"), sources.count(), BROADCAST_SOURCES)
    rows = rows.join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = written(_positions(rows), "positions")

    begin = F.col("b") * F.col("block")
    upto = F.least(F.col("block"), F.col("source_size") - begin, F.col("words") - F.col("pass") * F.col("source_size") - begin)
    whole = F.least(F.col("block"), F.col("source_size") - begin)
    slots = (
        schedule(sources.select("s", "slots")).join(known.select("s", "source_size", "words", "block", "blocks", "slots"), "s")
        .filter(F.col("r") < F.col("slots"))
        .withColumn("b", F.col("r") % F.col("blocks")).withColumn("pass", F.floor(F.col("r") / F.col("blocks")))
        .withColumn("upto", upto).withColumn("full", F.col("upto") == whole)
        .groupBy("s", "b").agg(
            F.sum(F.col("full").cast("bigint")).alias("times"),
            F.coalesce(F.max(F.when(~F.col("full"), F.col("upto"))), F.lit(0)).alias("cut"), F.min("j").alias("j"),
        )
    )
    end = F.col("at") + F.col("size")
    pieces = rows.filter("size > 0").select("*", F.explode(F.sequence(
        F.floor(F.col("at") / F.col("block")), F.floor((end - 1) / F.col("block")))).alias("b"))
    first = F.greatest(F.col("at"), begin)
    last = F.least(end, begin + F.col("block"))
    part = (F.col("times") * (last - first) + F.greatest(F.lit(0), F.least(last, begin + F.col("cut")) - first))
    keys = ["source", "doc_id", "tie", "at", "size", "source_size", "target"]
    taken = (pieces.join(slots, ["s", "b"], "left").groupBy(*keys)
             .agg(F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias("taken"),
                  F.min(F.when(part > 0, F.col("j"))).alias("slot")))
    nothing = F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("slot")
    empty = rows.filter("size = 0").select(*keys, *nothing)
    return taken.unionByName(empty).drop("at")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it (the last, partly taken copy whole).

    Any other columns of ``docs`` stay as they are. :func:`in_schedule_order` gives the rows in the order of the schedule.
    """
    return _copies(docs, options).select("whole.*")


def in_schedule_order(docs: DataFrame, **options) -> DataFrame:
    """:func:`mixed_documents` along the schedule, by first slot and pass, so any beginning of it is near the weights.

    Rows come sorted over the partitions (a range shuffle of the texts) and lead with ``mix_pass`` and ``mix_slot``.
    """
    rows = _copies(docs, options)
    return rows.orderBy("pass", "slot").select(F.col("pass").alias("mix_pass"), F.col("slot").alias("mix_slot"), "whole.*")


def _copies(docs: DataFrame, options: dict) -> DataFrame:
    """(whole, slot, pass): the documents as one struct, so that their columns meet no others."""
    rows = mix(sized(docs), **options)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    often = (rows.withColumn("copies", copies).groupBy("doc_id", "tie")
             .agg(F.sum("copies").cast("int").alias("copies"), F.min("slot").alias("slot")).filter("copies > 0"))
    tied = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_tie"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    tied = tied.dropDuplicates(["id", "text_tie"])
    met = tied.join(often, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_tie") == F.col("tie")))
    return met.select("whole", "slot", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
