"""Bootstrap by hash: multinomial weights, weighted metrics, percentile intervals.

A draw table holds (stratum columns, unit, rep, w): how often a unit was drawn
in a replicate.  One draw serves all models.  Metrics here take a weight column
and treat ``rep`` as one more key, so a bootstrap is a join plus a grouped
metric, never a loop.  :mod:`replicates` draws the units and holds the same
metrics on blocks of replicates, for the usual thousands of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle
from .metrics_class import ranking, within_fold_auroc
from .metrics_surv import pool_components
from .ordered import exact_quantiles, join_null_safe, value_ranks
from .pairs import concordance
from .replicates import draw_blocks, long_weights

Metric = Callable[[DataFrame, Sequence[str], str], DataFrame]


def draw_weights(
    units: DataFrame, strata: Sequence[str], unit: str, reps: range | int, seed: int = 42
) -> DataFrame:
    """(strata, unit, rep, w) for units drawn with replacement inside their stratum."""
    last = reps.stop if isinstance(reps, range) else reps
    long = long_weights(draw_blocks(units, strata, unit, last, seed), last)
    if isinstance(reps, range):
        long = long.where((F.col("rep") >= reps.start) & ((F.col("rep") - reps.start) % reps.step == 0))
    return long.select(*strata, unit, "rep", "w")


def replicate(df: DataFrame, weights: DataFrame, on: Sequence[str], metric: Metric, keys: Sequence[str]) -> DataFrame:
    """(keys, rep, value) of a weighted metric over all replicates in one job."""
    joined = join_null_safe(df, weights.select(*on, "rep", "w"), on)
    return metric(joined, [*keys, "rep"], "w")


def intervals(
    draws: DataFrame, keys: Sequence[str], requested: int, *, share: float = 0.0, at_least: int = 0,
    value: str = "value",
) -> DataFrame:
    """Percentile 95 % interval of the finite draws (linear interpolation).

    Too few valid draws (less than ``max(at_least, share * requested)``) give NULL limits.
    A group holds at most ``requested`` draws, so the exact aggregate is bounded.
    """
    needed = max(at_least, int(share * requested))
    finite = draws.where(F.col(value).isNotNull() & ~F.isnan(value))
    stats = finite.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.percentile(value, [0.025, 0.975]).alias("_q"),
        F.count(F.lit(1)).alias("valid"),
    )
    enough = F.col("valid") >= needed
    return stats.select(
        *keys, "mean", "sd",
        F.when(enough, F.col("_q")[0]).alias("ci_low"),
        F.when(enough, F.col("_q")[1]).alias("ci_high"),
        F.lit(requested).cast("bigint").alias("requested"),
        "valid",
    )


# ------------------------------------------------------- metrics with weights


def auroc_metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    out = ranking(df, keys, positive=F.col(w) * F.col("outcome"), negative=F.col(w) * (1 - F.col("outcome")))
    return out.select(*keys, F.col("auroc").alias("value"))


def class_metrics(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    """AUROC and AUPRC as rows (metric, value)."""
    out = ranking(df, keys, positive=F.col(w) * F.col("outcome"), negative=F.col(w) * (1 - F.col("outcome")))
    named = out.select(*keys, F.col("auroc").alias("AUROC"), F.col("auprc").alias("AUPRC"))
    return named.unpivot(list(keys), ["AUROC", "AUPRC"], "metric", "value")


def fold_auroc_metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
    by_fold = ranking(
        df, [*keys, "fold"], positive=F.col(w) * F.col("outcome"), negative=F.col(w) * (1 - F.col("outcome"))
    )
    return within_fold_auroc(by_fold, keys).select(*keys, F.col("auroc").alias("value"))


def concordance_metric(scope: Sequence[str], *, tied_censoring: bool, risk: str = "score") -> Metric:
    """Pooled concordance over pairs sharing the ``scope`` columns."""

    def metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
        parts = concordance(df, [*keys, *scope], weight=w, tied_censoring=tied_censoring, risk=risk)
        return pool_components(parts, keys).select(*keys, F.col("c_index").alias("value"))

    return metric


def mean_metric(value: str) -> Metric:
    def metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
        return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(w)) / F.sum(w)).alias("value"))

    return metric


def median_metric(value: str) -> Metric:
    def metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
        return exact_quantiles(df, keys, value, {"value": 0.5}, weight=w)

    return metric


def weighted_correlation(a: Column, b: Column, w: Column) -> Column:
    n = F.sum(w)
    va = F.sum(w * a * a) - F.sum(w * a) * F.sum(w * a) / n
    vb = F.sum(w * b * b) - F.sum(w * b) * F.sum(w * b) / n
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / n
    return F.when((va > 1e-9) & (vb > 1e-9), cov / F.sqrt(va * vb))


def spearman_metric(left: str, right: str) -> Metric:
    """Spearman correlation of the resampled rows (a row drawn twice is a tie)."""

    def metric(df: DataFrame, keys: Sequence[str], w: str) -> DataFrame:
        base = df.select(*keys, left, right, w)
        for column, out in ((left, "_ra"), (right, "_rb")):
            ranks = value_ranks(base, keys, column, weight=w)
            rank = F.col("_below") + (F.col("_ties") + 1) / 2.0 - F.col("_total") / 2.0
            base = base.join(ranks.select(*keys, column, rank.alias(out)), [*keys, column])
        return base.groupBy(*keys).agg(
            weighted_correlation(F.col("_ra"), F.col("_rb"), F.col(w)).alias("value"),
            F.sum(w).alias("n"),
        )

    return metric


def paired_difference(draws: DataFrame, keys: Sequence[str], model: str, reference: str) -> DataFrame:
    """Per replicate: value minus the reference model's value (shared draw)."""
    ref = draws.where(F.col(model) == reference).select(*keys, "rep", F.col("value").alias("_ref"))
    joined = draws.where(F.col(model) != reference).join(ref, [*keys, "rep"])
    return joined.select(*keys, model, "rep", (F.col("value") - F.col("_ref")).alias("value"))


def frozen_mean(draws: DataFrame, frozen: DataFrame, keys: Sequence[str], stratum: str) -> DataFrame:
    """Weighted mean over strata with eligibility and weights frozen on the original data.

    NULL if any frozen stratum has no value in the replicate.
    """
    total = frozen.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = draws.join(frozen.select(stratum, "weight"), stratum)
    return joined.groupBy(*keys).agg(
        F.count("value").alias("_have"),
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("_v"),
    ).withColumn("_need", total).select(
        *keys, F.when(F.col("_have") == F.col("_need"), F.col("_v")).alias("value")
    )


def complete_replicates(draws: DataFrame, model: str) -> DataFrame:
    """Set a replicate to NULL for all models unless every model has a value."""
    per_rep = draws.groupBy("rep").agg(
        (F.count("value") == F.count(F.lit(1))).alias("_ok")
    )
    return draws.join(per_rep, "rep").withColumn(
        "value", F.when(F.col("_ok"), F.col("value"))
    ).drop("_ok")


def metric_seed(base: int, identifier: Column) -> Column:
    """(base + first four SHA-256 bytes, little endian) mod (2^32 - 1)."""
    digest = F.sha2(identifier, 256)
    byte = lambda i: F.substring(digest, 2 * i + 1, 2)
    little = F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("bigint")
    return (F.lit(base) + little) % F.lit(2**32 - 1)
