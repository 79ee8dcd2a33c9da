"""Request tables, answer handling, decisions and dataset summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import ratio_or_zero
from .contracts import ContractError


def request_table(summaries: DataFrame, unit: str, instruction: Sequence[str], summary: str, schema_text: str) -> DataFrame:
    """One request row per unit: instruction lines plus the compact summary JSON."""
    prompt = F.concat_ws("\n", *[F.lit(x) for x in instruction], F.col(summary))
    return summaries.select(unit, prompt.alias("user_prompt"), F.lit(schema_text).alias("schema"))


def request_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the payload as JSON with sorted keys."""
    payload = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.sha2(payload, 256)


def cache_split(requests: DataFrame, cached: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answered with their results, still to send); the order column stays on the rows."""
    return requests.join(cached, key), requests.join(cached.select(key), key, "left_anti")


def in_request_order(requests: DataFrame, results: DataFrame, custom_id: str, strict: bool = True) -> DataFrame:
    """Results put back on their requests; a missing one is an error in strict mode."""
    joined = requests.join(results, custom_id, "left")
    if strict and requests.join(results, custom_id, "left_anti").limit(1).count():
        raise ContractError("missing batch outputs")
    return joined


def hybrid(model: DataFrame, rule: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """Model decision where present, else the rule decision, with a mode label."""
    m = model.select(unit, *[F.col(c).alias(f"_m_{c}") for c in columns], F.lit(True).alias("_has"))
    joined = rule.join(m, unit, "left")
    pick = [F.when(F.col("_has"), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    mode = F.when(F.col("_has"), "model").otherwise("hybrid_rule_fallback")
    return joined.select(unit, *pick, mode.alias("mode"))


def _classification() -> list[Column]:
    y, c = F.col("true_label"), F.col("call")
    t = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    tp, tn = t((y == 1) & (c == 1)), t((y == 0) & (c == 0))
    fp, fn = t((y == 0) & (c == 1)), t((y == 1) & (c == 0))
    return [
        ratio_or_zero(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(tn, tn + fp).alias("specificity"),
        ratio_or_zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def dataset_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics, null-skipping means and prediction counts per dataset."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.sum(F.col("call")).alias("positive_predictions"),
        F.sum(1 - F.col("call")).alias("negative_predictions"),
        *_classification(),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("total_tokens").alias("mean_total_tokens"),
    )


def report_rollup(rows: DataFrame, dataset: str) -> DataFrame:
    """Dataset rows plus one ALL_DATASETS row; rates other than accuracy only per dataset."""
    rolled = rows.rollup(dataset).agg(
        F.grouping(dataset).alias("_all"),
        F.count(F.lit(1)).alias("sample_count"),
        F.sum("call").alias("positive_predictions"),
        *_classification(),
        F.avg("confidence").alias("mean_confidence"),
        F.avg("total_tokens").alias("mean_total_tokens"),
    )
    total = F.col("_all") == 1
    only = [F.when(~total, F.col(c)).alias(c) for c in ("precision", "recall", "specificity", "f1")]
    return rolled.select(
        F.when(total, "ALL_DATASETS").otherwise(F.col(dataset)).alias(dataset),
        "sample_count", "positive_predictions", "accuracy", *only, "mean_confidence", "mean_total_tokens",
    )


def availability(expected: DataFrame, found: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """Expected grid left-joined with what exists, with a status and reason."""
    present = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_predictions"))
    joined = expected.join(present, list(keys), "left")
    ok = F.col("n_predictions").isNotNull()
    return joined.select(
        *keys,
        F.when(ok, "available_complete_prediction").otherwise("unavailable_source_prediction_not_found").alias("status"),
        F.when(~ok, reason).alias("reason"),
        F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"),
    )
