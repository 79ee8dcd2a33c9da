"""Exact pair counting for concordance without pair joins.

A permissible pair is (earlier event i, later unit j).  Per group three sums
over such pairs are needed, with unit weights w:

* ``pairs``       sum of w_i * w_j
* ``concordant``  the part with risk_i > risk_j
* ``tied``        the part with risk_i = risk_j

Up to ``ordered.TASK_ROWS`` distinct points in total, whole groups are counted
by array code inside tasks, many groups per task.  Beyond that, ``pairs`` and
``tied`` come from :func:`ordered.ordered_pair_sum` and ``concordant`` from a
chunked inversion count: time and risk are both cut into chunks, and a pair is
in exactly one of three cases: same time chunk; other time chunk but same risk
chunk; both different.  The first two are solved inside parts by array code, the
third by :func:`across`, a dominance count by binary levels of the chunk number
that stays in windows.  A part of more than ``FRAME_ROWS`` points is cut again at
its own quantiles until none is left, so an array frame never holds more than
two times ``FRAME_ROWS`` points and a batch, whatever time or risk is hot.  No
pair is materialised.  Sums are doubles: counts are exact up to 2^53 pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle
from . import ordered
from .ordered import add_chunk, chunk_count, cut_points, join_null_safe, ordered_pair_sum


#: Points of an array frame: several tasks of an executor hold one each, numbers only, with sorts some hundred bytes a point.
FRAME_ROWS = 100_000
#: Up to so many groups their numbers are broadcast to the points.
FEW_GROUPS = 100_000


def later_and_lower(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point the weight of points of its group with larger x and smaller y.

    Ties in x are ordered by y and ties in y by x, so tied points never count.
    ``group`` leads both orders, so many groups are handled in one call: one
    stable sort per bit of the rank.
    """
    n = len(x)
    by_x = np.lexsort((y, x, group))
    x_rank = np.empty(n, dtype=np.int64)
    x_rank[by_x] = np.arange(n)
    order = np.lexsort((x, y, group))
    rank = x_rank[order]
    weight = w[order]
    found = np.zeros(n)
    for bit in range(max(1, int(n - 1).bit_length())):
        block = rank >> (bit + 1)
        late = (rank >> bit) & 1
        arranged = np.argsort(block, kind="stable")
        b, side, ww = block[arranged], late[arranged], weight[arranged]
        upto = np.cumsum(np.where(side == 1, ww, 0.0))
        first = np.r_[True, b[1:] != b[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        found[arranged] += np.where(side == 0, upto - np.r_[0.0, upto][start], 0.0)
    out = np.empty(n)
    out[order] = found
    return out


def _strictly_later(group: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each point the weight of points of its group with strictly larger x."""
    order = np.lexsort((x, group))
    g, xs, ws = group[order], x[order], w[order]
    total = np.r_[0.0, np.cumsum(ws)]
    n = len(x)
    group_end = np.searchsorted(g, g, side="right")
    new = np.r_[True, (g[1:] != g[:-1]) | (xs[1:] != xs[:-1])]
    tie_end = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
    out = np.empty(n)
    out[order] = total[group_end] - total[tie_end]
    return out


def _position(x: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Dense order position of (x, late); under the tied rule events precede censorings."""
    order = np.lexsort((late, x))
    step = np.r_[0, (np.diff(x[order]) != 0) | (np.diff(late[order]) != 0)]
    position = np.empty(len(x))
    position[order] = np.cumsum(step)
    return position


def _group_sums(pdf: pd.DataFrame, keys: list[str], columns: list[str]) -> pd.DataFrame:
    return pdf.groupby(keys, sort=False, dropna=False, as_index=False)[columns].sum()[[*keys, *columns]]


def _count_whole(keys: list[str], tied_censoring: bool):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        late = 1 - pdf["_ev"].to_numpy(int) if tied_censoring else np.zeros(len(pdf), int)
        x = _position(pdf["_x"].to_numpy(float), late)
        y, w = pdf["_r"].to_numpy(float), pdf["_w"].to_numpy(float)
        e = w * pdf["_ev"].to_numpy(float)
        same_risk = pd.DataFrame({"g": group, "y": y}).groupby(["g", "y"]).ngroup().to_numpy()
        pdf = pdf.assign(
            pairs=e * _strictly_later(group, x, w),
            concordant=e * later_and_lower(group, x, y, w),
            tied=e * _strictly_later(same_risk, x, w),
        )
        return _group_sums(pdf, keys, ["pairs", "concordant", "tied"])

    return count


def _count_parts(keys: list[str], limit: int):
    """Array count of whole parts that arrive one after the other, a bounded number of rows at a time."""
    part_key = [*keys, "_case", "_part"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(part_key, sort=False, dropna=False).ngroup().to_numpy()
        x = _position(pdf["_x"].to_numpy(float), pdf["_late"].to_numpy(int))
        lower = later_and_lower(group, x, pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float))
        return _group_sums(pdf.assign(concordant=pdf["_e"].to_numpy(float) * lower), keys, ["concordant"])

    def count(batches):
        held, rows, full = [], 0, limit
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows < full:
                continue
            joined = pd.concat(held, ignore_index=True)
            group = joined.groupby(part_key, sort=False, dropna=False).ngroup().to_numpy()
            open_part = group == group[-1]  # its rows may go on in the next batch
            if not open_part.all():
                yield one(joined[~open_part])
            held = [joined[open_part]]
            rows = int(open_part.sum())
            full = rows + limit
        if rows:
            yield one(pd.concat(held, ignore_index=True))

    return count


def concordance(
    df: DataFrame,
    keys: Sequence[str],
    *,
    duration: str = "duration",
    event: str = "event",
    risk: str = "score",
    weight: str | None = None,
    tied_censoring: bool = False,
) -> DataFrame:
    """Concordance components per ``keys``.

    ``tied_censoring=False``: only t_i < t_j with event_i counts (strict rule).
    ``tied_censoring=True``: an event also precedes a censoring at the same time.
    Rows without a defined duration, event or risk (NULL, NaN) take no part, at any size; NULL keys are a group.
    Returns keys, pairs, concordant, tied (double) and c_index (NULL without pairs).
    """
    keys = list(keys)
    named = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    sources = [F.col(k) for k in keys] or [F.lit(0)]
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    points = settle(
        df.select(
            *[c.alias(s) for c, s in zip(sources, named)],
            F.col(duration).cast("double").alias("_t"),
            F.col(event).cast("int").alias("_ev"),
            F.col(risk).cast("double").alias("_r"),
            *([F.col(weight)] if weight else []),
        )
        .where(F.col("_ev").isNotNull() & _defined("_t") & _defined("_r"))
        .groupBy(*named, "_t", "_ev", "_r")
        .agg(w.cast("double").alias("_w"))
    )
    # a group is a number from here on: array frames hold no texts
    groups = settle(points.select(*named).distinct().withColumn("_g", F.monotonically_increasing_id()))
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    numbered = join_null_safe(points, F.broadcast(groups) if few else groups, named)
    slot, points = ["_g"], numbered.select("_g", "_t", "_ev", "_r", "_w")
    rows = points.count()
    if rows <= min(ordered.TASK_ROWS, 4 * FRAME_ROWS):
        counted = _whole_groups(points, slot, tied_censoring)
    else:
        counted = _chunked_groups(points, slot, tied_censoring, chunk_count(rows))
    counted = counted.join(groups, "_g")
    p, c, t = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("pairs", "concordant", "tied"))
    return counted.select(
        *[F.col(s).alias(k) for k, s in zip(keys, named)],
        p.alias("pairs"),
        c.alias("concordant"),
        t.alias("tied"),
        F.when(p > 0, (c + 0.5 * t) / p).alias("c_index"),
    )


def _defined(name: str):
    return F.col(name).isNotNull() & ~F.isnan(name)


def _buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _key_schema(points: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)


def _whole_groups(points: DataFrame, keys: list[str], tied_censoring: bool) -> DataFrame:
    work = points.withColumnRenamed("_t", "_x").withColumn(
        "_bucket", F.pmod(F.xxhash64(*keys), F.lit(_buckets(points)))
    )
    return work.groupBy("_bucket").applyInPandas(
        _count_whole(keys, tied_censoring),
        schema=f"{_key_schema(points, keys)}, pairs double, concordant double, tied double",
    )


def _chunked_groups(points: DataFrame, keys: list[str], tied_censoring: bool, chunks: int) -> DataFrame:
    points = points.withColumn("_e", F.col("_w") * F.col("_ev"))
    pairs = _pairs_in_time(points, keys, tied_censoring, "pairs")
    tied = _pairs_in_time(points, [*keys, "_r"], tied_censoring, "tied")
    tied = tied.groupBy(*keys).agg(F.sum("tied").alias("tied"))
    concordant = _inversions(points, keys, tied_censoring, chunks)
    return join_null_safe(join_null_safe(pairs, tied, keys, "left"), concordant, keys, "left")


def _pairs_in_time(points: DataFrame, keys: list[str], tied_censoring: bool, out: str) -> DataFrame:
    by_time = settle(
        points.groupBy(*keys, "_t").agg(F.sum("_e").alias("_e"), F.sum("_w").alias("_w"))
    )
    result = ordered_pair_sum(by_time, keys, "_t", "_e", "_w", out)
    if not tied_censoring:
        return result
    same_time = by_time.groupBy(*keys).agg(
        F.sum(F.col("_e") * (F.col("_w") - F.col("_e"))).alias(out)
    )
    return result.unionByName(same_time).groupBy(*keys).agg(F.sum(out).alias(out))


def across(df: DataFrame, keys: list[str], x: str, y: str, bits: int, lowest: Column | None = None) -> DataFrame:
    """Per ``keys``: the sum of _e(a) * _w(b) over rows with x(a) < x(b) and y(b) < y(a), x below 2^bits.

    Two different numbers part at exactly one binary level: equal above it, 0 and 1 on it.  So each level of each
    block is one sum along y of the right half's weight below the left half's rows.  ``lowest`` is the first level
    on which a row can part from another.
    """
    start = F.lit(0) if lowest is None else lowest
    level = df.select(*keys, x, y, "_e", "_w", F.explode(F.sequence(start, F.lit(bits - 1))).alias("_level"))
    right = F.expr(f"shiftright({x}, _level) & 1") == 1
    sides = level.groupBy(*keys, "_level", F.expr(f"shiftright({x}, _level + 1)").alias("_block"), y).agg(
        F.sum(F.when(~right, F.col("_e")).otherwise(0.0)).alias("_left"),
        F.sum(F.when(right, F.col("_w")).otherwise(0.0)).alias("_right"),
    )
    found = ordered_pair_sum(sides, [*keys, "_level", "_block"], y, "_right", "_left", "concordant")
    return found.groupBy(*keys).agg(F.sum("concordant").alias("concordant"))


def _inversions(points: DataFrame, keys: list[str], tied_censoring: bool, chunks: int) -> DataFrame:
    t_cuts, r_cuts = cut_points(points, ["_t", "_r"], chunks)
    cut = add_chunk(add_chunk(points, "_t", t_cuts, "_bt"), "_r", r_cuts, "_br")
    late = (1 - F.col("_ev")) if tied_censoring else F.lit(0)
    # Single-value (odd) chunks are split further along the other axis, in the low bits.
    chunk_bits = (2 * chunks + 2).bit_length()
    half, low = 1 << chunk_bits, chunk_bits + 1
    single_t, single_r = F.col("_bt") % 2 == 1, F.col("_br") % 2 == 1
    cx = F.col("_bt").cast("bigint") * (1 << low) + F.when(single_t, late * half + F.col("_br")).otherwise(0)
    cy = F.col("_br").cast("bigint") * (1 << low) + F.when(single_r, F.col("_bt")).otherwise(0)
    cut = cut.withColumns({"_cx": cx.cast("bigint"), "_cy": cy.cast("bigint"), "_late": late})

    def instance(case: int, part: str, x: str, late_side: Column) -> DataFrame:
        return cut.select(
            *keys, F.lit(case).alias("_case"), F.col(part).alias("_part"),
            F.col(x).cast("double").alias("_x"), late_side.cast("int").alias("_late"), F.col("_r").alias("_y"), "_e", "_w",
        )

    parts = instance(0, "_cx", "_t", F.col("_late")).unionByName(instance(1, "_cy", "_cx", F.lit(0)))
    cells = cut.groupBy(*keys, "_cx", "_cy").agg(
        F.sum("_e").alias("_e"), F.sum("_w").alias("_w"), F.min(F.when(single_t, 0).otherwise(low)).alias("_low")
    )
    grid = across(cells, keys, "_cx", "_cy", chunk_bits + low, F.col("_low"))
    counted = grid.unionByName(_inside_parts(parts, keys))
    return counted.groupBy(*keys).agg(F.sum("concordant").alias("concordant"))


#: Cut points of a part that is too large; its chunk numbers have six bits.
PART_CUTS = 15


def _inside_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Inversions inside parts; a part of more than ``FRAME_ROWS`` rows is cut again, as often as it takes."""
    limit = min(ordered.TASK_ROWS, FRAME_ROWS)
    part_key = [*keys, "_case", "_part"]
    found = []
    while True:
        large = settle(parts.groupBy(*part_key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit))
        if large.isEmpty():
            break
        probabilities = [(i + 1) / (PART_CUTS + 1) for i in range(PART_CUTS)]
        marked = join_null_safe(parts, large.withColumn("_large", F.lit(True)).drop("_n"), part_key, "left")
        marked = settle(marked)
        over = marked.where("_large").drop("_large")
        cuts = over.groupBy(*part_key).agg(
            F.array_distinct(F.percentile_approx("_x", probabilities, F.lit(20 * PART_CUTS))).alias("_cuts")
        )
        place = F.size(F.filter("_cuts", lambda c: c <= F.col("_x")))
        at_cut = F.array_contains("_cuts", F.col("_x"))
        chunk = F.when(at_cut, 2 * (2 * place - 1) + F.col("_late")).otherwise(4 * place).cast("bigint")
        placed = settle(join_null_safe(over, cuts, part_key).withColumn("_chunk_x", chunk).drop("_cuts"))
        found.append(across(placed, part_key, "_chunk_x", "_y", 6).select(*keys, "concordant"))
        # a chunk of one value and side holds no pair; the ranges between the cuts are parts of their own
        rest = placed.where("_chunk_x % 4 = 0").withColumn(
            "_part", F.col("_part") * (PART_CUTS + 1) + F.expr("_chunk_x div 4"))
        small = marked.where("_large IS NULL").drop("_large")
        found.append(_count_small(small, keys, limit))
        parts = rest.drop("_chunk_x")
    found.append(_count_small(parts, keys, limit))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _count_small(parts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    part_key = [*keys, "_case", "_part"]
    arranged = parts.repartition(*part_key).sortWithinPartitions(*part_key)
    return arranged.mapInPandas(
        _count_parts(keys, limit), schema=f"{_key_schema(parts, keys)}, concordant double"
    )
