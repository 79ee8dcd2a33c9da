"""Order-dependent building blocks that never put a whole large group in one task.

A plain ``Window.partitionBy(group).orderBy(value)`` sends a group to a single
task, which fails when one group holds a third of the data.  The input here is
pre-aggregated to one row per (group, value), settled, and counted.  Up to
``TASK_ROWS`` rows in total the plain window is safe and used.  Beyond that the
value axis is cut at approximate quantiles, windows run inside ``(group,
chunk)``, and chunk totals (a bounded number per group) carry the offsets.

Cut points only balance the work: a chunk is a pure function of the value, so
any cut points give the same exact result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import settle

TASK_ROWS = 2_000_000
MAX_CHUNKS = 16_384


def chunk_count(rows: int) -> int:
    return min(MAX_CHUNKS, 2 * math.ceil(rows / TASK_ROWS))


def cut_points(df: DataFrame, values: Sequence[str], chunks: int) -> list[list[float]]:
    """At most ``chunks`` distinct approximate quantiles per column (driver-bounded)."""
    probabilities = [(i + 1) / chunks for i in range(chunks - 1)] or [0.5]
    row = df.agg(
        *[F.percentile_approx(F.col(v).cast("double"), probabilities, 20 * chunks) for v in values]
    ).first()
    return [sorted(set(cuts or [0.0])) for cuts in row]


def add_chunk(df: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """Monotone chunk number of ``value``.

    Even numbers are the open ranges between cut points, odd numbers hold a
    single value, so a value repeated very often gets a chunk of its own.
    """
    splits = [-math.inf, *cuts, math.inf]
    number = F.col(value).cast("double")
    # NULL sorts first and NaN last, as in a window; each has a chunk of its own
    defined = F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)
    cast = df.withColumn("_number", number).withColumn("_value", defined)
    placed = Bucketizer(splits=splits, inputCol="_value", outputCol="_place").transform(cast)
    place = F.col("_place").cast("int")
    at_cut = F.element_at(F.lit(splits), place + 1) == F.col("_value")
    chunk = (
        F.when(F.col("_number").isNull(), -2).when(F.isnan("_number"), 2 * len(splits))
        .otherwise(2 * place - at_cut.cast("int"))
    )
    return placed.withColumn(out, chunk).drop("_number", "_value", "_place")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which NULL matches NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def _chunked(df: DataFrame, order: str) -> DataFrame | None:
    """``df`` with ``_chunk``, or None while a plain window is safe."""
    rows = df.count()
    if rows <= TASK_ROWS:
        return None
    (cuts,) = cut_points(df, [order], chunk_count(rows))
    return add_chunk(df, order, cuts, "_chunk")


_RUNNING = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    *,
    descending: bool = False,
    chunk: Column | None = None,
    ties: Sequence[str] = (),
    how: str = "sum",
) -> DataFrame:
    """Add inclusive running sums (or minima, maxima) per ``keys`` along numeric ``order``.

    ``df`` holds one row per (keys, order, ties).  ``sums`` maps new column ->
    summed column.  ``chunk`` replaces the cut points by a given monotone expression
    (hash prefixes are balanced by nature and need no statistics).
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    fold, combine = _RUNNING[how]
    if chunk is not None:
        cut = df.withColumn("_chunk", chunk)
    else:
        df = settle(df)
        cut = _chunked(df, order)
        if cut is None:
            frame = (
                W.partitionBy(*keys).orderBy(direction(order), *ties)
                .rowsBetween(W.unboundedPreceding, W.currentRow)
            )
            return df.select("*", *[fold(src).over(frame).alias(out) for out, src in sums.items()])
    totals = cut.groupBy(*keys, "_chunk").agg(
        *[fold(src).alias(f"_t_{out}") for out, src in sums.items()]
    )
    before = (
        W.partitionBy(*keys).orderBy(direction("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_chunk", *[fold(f"_t_{out}").over(before).alias(f"_o_{out}") for out in sums]
    )
    inside = (
        W.partitionBy(*keys, "_chunk").orderBy(direction(order), *ties)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = cut.select(
        "*", *[fold(src).over(inside).alias(f"_l_{out}") for out, src in sums.items()]
    )
    return join_null_safe(local, offsets, [*keys, "_chunk"]).select(
        *[F.col(c) for c in df.columns],
        *[combine(F.col(f"_l_{out}"), F.col(f"_o_{out}")).alias(out) for out in sums],
    )


def ordered_pair_sum(
    df: DataFrame, keys: Sequence[str], order: str, early: str, late: str, out: str
) -> DataFrame:
    """Per ``keys``: the sum of early(a) * late(b) over rows with order(a) < order(b).

    ``df`` holds one row per (keys, order).  Pairs inside one chunk come from a
    bounded window, pairs across chunks from the chunk totals; no row is joined.
    """
    keys = list(keys)
    df = settle(df)
    cut = _chunked(df, order)
    part = [*keys, "_chunk"] if cut is not None else keys
    base = cut if cut is not None else df
    inside = W.partitionBy(*part).orderBy(F.col(order)).rowsBetween(W.unboundedPreceding, -1)
    product = F.col(late) * F.coalesce(F.sum(early).over(inside), F.lit(0))
    local = base.select(*keys, product.alias("_v"))
    if cut is not None:
        totals = cut.groupBy(*keys, "_chunk").agg(
            F.sum(early).alias("_e"), F.sum(late).alias("_w")
        )
        before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        across = F.col("_w") * F.coalesce(F.sum("_e").over(before), F.lit(0))
        local = local.unionByName(totals.select(*keys, across.alias("_v")))
    return local.groupBy(*keys).agg(F.sum("_v").alias(out))


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, *, weight: str | None = None
) -> DataFrame:
    """One row per (keys, value): ``_ties``, ``_below`` (strictly lower), ``_upto``, ``_total``.

    ``_below + 1`` is the minimum rank, ``below + (ties + 1) / 2`` the average
    rank and ``_upto`` the maximum rank.
    """
    keys = list(keys)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = settle(df.groupBy(*keys, value).agg(w.alias("_ties")))
    ranked = running_totals(counts, keys, value, {"_upto": "_ties"})
    totals = counts.groupBy(*keys).agg(F.sum("_ties").alias("_total"))
    ranked = join_null_safe(ranked, totals, keys) if keys else ranked.withColumn("_total", totals.scalar())
    return ranked.withColumn("_below", F.col("_upto") - F.col("_ties"))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Append the average rank of ``value`` within ``keys``, ``_n`` and ``_upto``."""
    keys = list(keys)
    ranks = value_ranks(df, keys, value).select(
        *keys,
        value,
        (F.col("_below") + (F.col("_ties") + 1) / 2.0).alias(out),
        F.col("_total").alias("_n"),
        F.col("_upto"),
    )
    return df.join(ranks, [*keys, value])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], *, weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per ``keys`` without one big buffer.

    Only the (at most two) distinct values around each wanted position survive
    the filter before the last aggregation.  An integer ``weight`` repeats rows.
    """
    keys = list(keys)
    ranked = value_ranks(df.where(F.col(value).isNotNull()), keys, value, weight=weight)
    columns = []
    wanted = F.lit(False)
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        has_low = (F.col("_below") <= low) & (low < F.col("_upto"))
        has_high = (F.col("_below") <= high) & (high < F.col("_upto"))
        wanted = wanted | has_low | has_high
        lo = F.max(F.when(has_low, F.col(value)))
        hi = F.max(F.when(has_high, F.col(value)))
        columns.append((lo + (hi - lo) * F.max(position - low)).alias(name))
    return ranked.where(wanted).groupBy(*keys).agg(*columns)


def hash_row_number(
    df: DataFrame, keys: Sequence[str], unit: str, salt: str, out: str = "rn"
) -> DataFrame:
    """Row number of unique ``unit`` per ``keys`` in the order of md5(salt || unit).

    MD5 prefixes are uniform, so the first four hex digits are ready-made
    balanced chunks: no statistics and no single-task sort.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(salt), F.col(unit).cast("string"))))
    hashed = hashed.withColumn("_one", F.lit(1).cast("bigint"))
    prefix = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    ranked = running_totals(hashed, keys, "_h", {out: "_one"}, chunk=prefix, ties=[unit])
    return ranked.drop("_h", "_one")


def row_number(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (), out: str = "rn"
) -> DataFrame:
    """Row number per ``keys`` along (order, ties); NULL first, NaN last, rows equal in both by a hash of the whole row.

    A large input is cut into ranges of (keys, order, ties), numbered inside each, and range sizes carry the
    offsets.  The ties take part in the cut, so a single value that holds most rows is numbered by many tasks.
    """
    keys = list(keys)
    df = settle(df)
    along = [order, *ties]
    rows = df.count()
    if rows <= TASK_ROWS:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*along, F.xxhash64(*df.columns))))
    whole = df.withColumn("_whole", F.xxhash64(*df.columns))
    along = [*along, "_whole"]
    cut = settle(whole.repartitionByRange(chunk_count(rows), *keys, *along).withColumn("_range", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = cut.withColumn("_at", F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*along)))
    return join_null_safe(inside, offsets, [*keys, "_range"]).select(
        *[F.col(c) for c in df.columns], (F.col("_at") + F.col("_offset")).alias(out)
    )
