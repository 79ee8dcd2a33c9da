"""Strategy disagreement per analysis unit and rule-based case selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import all_of, count_true
from .contracts import constant_within_group, enforce, same_units, unique_key
from .ordered import row_number
from .rankstats import midrank_percentile, rank_dispersion


def select_predictions(df: DataFrame, strategies: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Rows of the compared strategies with their keys, contracts enforced."""
    keys = F.create_map(*[F.lit(x) for kv in strategies.items() for x in kv])
    chosen = df.where(F.col("model").isin(list(strategies))).withColumn("strategy", keys[F.col("model")])
    if strict:
        enforce(unique_key(chosen, ["strategy", "unit_id"]))
        enforce(constant_within_group(chosen, ["unit_id"], ["outcome", "fold"]))
        enforce(same_units(chosen, "strategy", ["unit_id"]))
    return chosen


def analysis_units(selected: DataFrame, keys: Sequence[str], unit: str = "group_id") -> DataFrame:
    """One row per (keys, unit, strategy): mean score, majority call, sample ids, percentile."""
    grouped = selected.groupBy(*keys, unit, "strategy").agg(
        F.min("outcome").alias("outcome"),
        F.min("fold").alias("fold"),
        F.avg("score").alias("score"),
        (F.avg("call") >= 0.5).cast("int").alias("call"),
        F.count_distinct("unit_id").alias("n_samples"),
        # the joined id list is the output itself; a unit is one patient's samples
        F.array_join(F.array_sort(F.collect_set("unit_id")), ";").alias("sample_ids"),
    )
    return midrank_percentile(grouped, [*keys, "strategy"], "score")


def wide_units(units: DataFrame, keys: Sequence[str], strategies: Sequence[str], unit: str = "group_id") -> DataFrame:
    """score_, percentile_ and call_ columns per strategy plus rank dispersion."""
    pick = lambda c, s: F.max(F.when(F.col("strategy") == s, F.col(c))).alias(f"{c}_{s}")
    wide = units.groupBy(*keys, unit).agg(
        F.min("outcome").alias("outcome"), F.min("fold").alias("fold"), F.min("n_samples").alias("n_samples"),
        F.min("sample_ids").alias("sample_ids"),
        *[pick(c, s) for c in ("score", "percentile", "call") for s in strategies],
    )
    return rank_dispersion(wide, [f"percentile_{s}" for s in strategies])


def decision_patterns(wide: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Unanimity, correctness counts, unique-correct flags and pattern strings."""
    calls = [F.col(f"call_{s}") for s in strategies]
    correct = [c == F.col("outcome") for c in calls]
    n = count_true(*correct)
    out = wide.withColumns({
        "unanimous_call": all_of(*[c == calls[0] for c in calls[1:]]),
        "n_correct": n,
        "all_correct": n == len(calls),
        "all_wrong": n == 0,
        "exactly_one_correct": n == 1,
        "exactly_two_correct": n == 2,
        "call_pattern": F.concat(*[c.cast("string") for c in calls]),
        "correctness_pattern": F.concat(*[F.when(c, "C").otherwise("W") for c in correct]),
    })
    return out.withColumns({
        f"unique_correct_{s}": c & (F.col("n_correct") == 1) for s, c in zip(strategies, correct)
    })


def pattern_counts(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = patterns.groupBy(*keys, "correctness_pattern").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_t"))
    return counts.join(totals, list(keys)).withColumn("rate", F.col("count") / F.col("_t")).drop("_t")


def discordant_groups(df: DataFrame, group: str, label: str, unit: str) -> DataFrame:
    """Rows of groups whose units carry different labels, with their sort keys."""
    mixed = df.groupBy(group).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a <> _b")
    text = F.col(unit).cast("string")
    suffix = F.regexp_extract(text, r"_(\d+)$", 1)
    return df.join(mixed.select(group), group, "left_semi").withColumns({
        "group_number": F.regexp_replace(F.col(group).cast("string"), r"\D", "").cast("bigint"),
        "prefix_order": F.when(F.lower(text).startswith("pre"), 0).otherwise(1),
        "suffix_order": F.when(suffix != "", suffix.cast("int")).otherwise(1),
    })


def top_per_group(df: DataFrame, keys: Sequence[str], value: str, unit: str) -> DataFrame:
    """Largest value per group, lexical tie-break, as one aggregation."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(unit).alias("u"))).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_b.u").alias(unit), (-F.col("_b.v")).alias(value))


def max_and_lower_median(df: DataFrame, keys: Sequence[str], value: str, unit: str) -> DataFrame:
    """Per group the row of largest value and the one at index (n - 1) // 2 ascending."""
    keys = list(keys)
    top = top_per_group(df, keys, value, unit).withColumn("role", F.lit("maximum range"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_number(df.select(*keys, value, unit), keys, value, ties=[unit]).join(sizes, keys)
    middle = ranked.where(F.col("rn") == F.floor((F.col("_n") - 1) / 2) + 1)
    return top.unionByName(middle.select(*keys, unit, value, F.lit("median range").alias("role")))


def repeat_summary(df: DataFrame, sample: Sequence[str], patient: str, baseline: Column, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(per sample over partitions, per patient over samples with eligibility)."""
    samples = df.groupBy(*sample).agg(
        F.avg("risk_score").alias("mean_score"), F.stddev_samp("risk_score").alias("sd_across_partitions"),
        F.min("risk_score").alias("min_score"), F.max("risk_score").alias("max_score"),
        F.count_distinct("repeat_seed").alias("n_partitions"),
    ).withColumns({"complete": F.col("n_partitions") == partitions, "is_baseline": baseline})
    patients = samples.groupBy(patient).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("is_baseline").cast("bigint")).alias("n_baseline"),
        F.min("mean_score").alias("score_min"), F.max("mean_score").alias("score_max"),
    ).withColumn("score_range", F.col("score_max") - F.col("score_min"))
    eligible = (F.col("n_samples") >= 2) & (F.col("n_baseline") >= 1)
    return samples, patients.withColumn("eligible", eligible)


def timepoint_day(label: Column, event_day: Column) -> Column:
    """BL, TOX, nW, a-bW and nM labels to days (fixed values); anything else is NULL."""
    text = F.upper(F.trim(label))
    number = r"(\d+(?:\.\d+)?)"
    week, span, month = f"^{number}W$", f"^{number}-{number}W$", f"^{number}M$"
    return (
        F.when(text == "BL", 0.0)
        .when(text == "TOX", event_day)
        .when(text.rlike(week), _num(text, week, 1) * 7.0)
        .when(text.rlike(span), (_num(text, span, 1) + _num(text, span, 2)) * 3.5)
        .when(text.rlike(month), _num(text, month, 1) * 30.4375)
    )


def _num(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).cast("double")
