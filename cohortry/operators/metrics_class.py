"""Classification metrics as grouped aggregations over a long prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle
from ..functions.scalars import ratio_or_zero, safe_ratio
from .ordered import running_totals


def confusion(
    df: DataFrame, keys: Sequence[str], *, outcome: str = "outcome", call: str = "call",
    weight: str | None = None,
) -> DataFrame:
    """tp, tn, fp, fn and the derived rates; a rate with denominator 0 is 0."""
    w = F.col(weight) if weight else F.lit(1)
    y, c = F.col(outcome), F.col(call)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0)).cast("bigint")

    counts = df.groupBy(*keys).agg(
        total((y == 1) & (c == 1)).alias("tp"),
        total((y == 0) & (c == 0)).alias("tn"),
        total((y == 0) & (c == 1)).alias("fp"),
        total((y == 1) & (c == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    return counts.select(
        "*",
        n.alias("n_samples"),
        ratio_or_zero(tp + tn, n).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(tn, tn + fp).alias("specificity"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        # macro F1: mean of the two per-class F1 values
        ((ratio_or_zero(2 * tp, 2 * tp + fp + fn) + ratio_or_zero(2 * tn, 2 * tn + fp + fn)) / 2)
        .alias("macro_f1"),
    )


def ranking(
    df: DataFrame,
    keys: Sequence[str],
    *,
    score: str = "score",
    positive: Column | None = None,
    negative: Column | None = None,
) -> DataFrame:
    """AUROC and average precision per ``keys`` from one pass over distinct scores.

    ``positive`` and ``negative`` are row weights (default: outcome 1 / 0), so
    bootstrap weights and censoring weights use the same code.  ``credit`` is
    the sum over positive-negative pairs (ties half), ``pairs`` their weight.
    """
    keys = list(keys)
    pos = positive if positive is not None else F.col("outcome").cast("double")
    neg = negative if negative is not None else (1 - F.col("outcome")).cast("double")
    counts = settle(
        df.select(*keys, F.col(score).alias("_s"), pos.alias("_p"), neg.alias("_n"))
        .groupBy(*keys, "_s")
        .agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    )
    ranked = running_totals(counts, keys, "_s", {"_cp": "_p", "_cn": "_n"}, descending=True)
    precision = safe_ratio(F.col("_cp"), F.col("_cp") + F.col("_cn"))
    sums = ranked.groupBy(*keys).agg(
        F.sum("_p").alias("positive"),
        F.sum("_n").alias("negative"),
        F.sum(F.col("_n") * (F.col("_cp") - F.col("_p") / 2)).alias("credit"),
        F.sum(F.col("_p") * precision).alias("_ap"),
    )
    pairs = F.col("positive") * F.col("negative")
    return sums.select(
        *keys,
        "positive",
        "negative",
        "credit",
        pairs.alias("pairs"),
        safe_ratio(F.col("credit"), pairs).alias("auroc"),
        F.when(pairs > 0, F.col("_ap") / F.col("positive")).alias("auprc"),
    )


def within_fold_auroc(by_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool pair credit over folds, and average the folds that have both classes.

    Takes :func:`ranking` output at (keys, fold).
    """
    return by_fold.groupBy(*keys).agg(
        safe_ratio(F.sum("credit"), F.sum("pairs")).alias("auroc"),
        F.avg("auroc").alias("mean_fold_auroc"),
        F.sum("pairs").cast("bigint").alias("comparable_pairs"),
    )


def by_unit(
    df: DataFrame, keys: Sequence[str], unit: str = "group_id", *, score: str = "score"
) -> DataFrame:
    """Mean score per unit; outcome and fold must be constant within a unit.

    The spread columns let the caller enforce that with
    :func:`contracts.constant_within_group`; a majority tie counts as 1.
    """
    extra = [F.avg("call").alias("_c")] if "call" in df.columns else []
    out = df.groupBy(*keys, unit).agg(
        F.min("outcome").alias("outcome"),
        F.avg(score).alias(score),
        F.min("fold").alias("fold"),
        F.count(F.lit(1)).alias("n_samples"),
        *extra,
    )
    if extra:
        out = out.withColumn("call", (F.col("_c") >= 0.5).cast("int")).drop("_c")
    return out


def delta_to_reference(
    metrics: DataFrame, keys: Sequence[str], model: str, reference: str, value: str
) -> DataFrame:
    """Metric minus the reference model's metric with the same keys."""
    ref = metrics.where(F.col(model) == reference).select(*keys, F.col(value).alias("reference"))
    if keys:
        joined = metrics.join(ref, list(keys), "left")
    else:
        joined = metrics.withColumn("reference", ref.scalar())
    return joined.withColumn("delta", F.col(value) - F.col("reference"))


def metrics_long(metrics: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per (ids, metric); metric names in upper case."""
    cast = metrics.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return cast.unpivot(list(ids), list(values), "metric", "estimate").withColumn(
        "metric", F.upper("metric")
    )


def cohort_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples, groups, positives and events at both levels, repeats, duration range."""
    per_group = df.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("outcome").alias("outcome"),
        F.sum("outcome").alias("pos"),
        F.sum("event").alias("ev"),
        F.max("event").alias("any_event"),
        F.min("duration").alias("dmin"),
        F.max("duration").alias("dmax"),
    )
    return per_group.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("pos").alias("positive_samples"),
        F.sum("outcome").alias("positive_groups"),
        F.sum("ev").alias("events_samples"),
        F.sum("any_event").cast("bigint").alias("event_groups"),
        F.sum((F.col("n") > 1).cast("int")).alias("repeated_groups"),
        F.min("dmin").alias("duration_min"),
        F.max("dmax").alias("duration_max"),
    )
