"""Joins with declared cardinality, pivots, overlays and rule-driven selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .contracts import ContractError, enforce, unique_key

_ONE_SIDES = {
    "one_to_one": ("left", "right"),
    "many_to_one": ("right",),
    "one_to_many": ("left",),
    "many_to_many": (),
}


def validated_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], *, cardinality: str, how: str = "inner"
) -> DataFrame:
    """Equi-join that first proves the declared "one" sides unique."""
    for side in _ONE_SIDES[cardinality]:
        enforce(unique_key(left if side == "left" else right, on, f"{cardinality}:{side}"))
    return left.join(right, list(on), how)


def enrich(left: DataFrame, dim: DataFrame, on: Sequence[str], required: str) -> DataFrame:
    """Left join of a dimension; a row without a match is an error."""
    joined = left.join(dim, list(on), "left")
    if joined.where(F.col(required).isNull()).limit(1).count():
        raise ContractError(f"rows without {required}")
    return joined


def restrict(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids, list(on), "left_semi")


def exclude(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids, list(on), "left_anti")


def pair_models(df: DataFrame, keys: Sequence[str], left: str, right: str, value: str = "score") -> DataFrame:
    """One row per unit with both models' values and their difference."""
    pick = lambda m, name: F.max(F.when(F.col("model") == m, F.col(value))).alias(name)
    both = df.where(F.col("model").isin(left, right)).groupBy(*keys).agg(pick(left, "left"), pick(right, "right"))
    return both.where("left IS NOT NULL AND right IS NOT NULL").withColumn("delta", F.col("left") - F.col("right"))


def with_grid(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Repeat rows for each value of a short parameter list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pivot_models(df: DataFrame, keys: Sequence[str], models: Sequence[str], value: str = "score") -> DataFrame:
    """One column per model in one aggregation, the largest of repeated cells; a missing cell is an error for the caller to check."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models])


def overlay(retained: DataFrame, refit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retained rows minus the refit keys, plus the refit rows."""
    kept = retained.join(refit.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(refit, allowMissingColumns=True)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as an aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*order, *[c for c in rest if c not in order])
    picked = df.groupBy(*keys).agg(F.min(ordered).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def collapse(df: DataFrame, column: str, rule: Mapping[str, str], out: str) -> DataFrame:
    """Map rare levels to a composite level and keep the original column."""
    expression = None
    for level, target in rule.items():
        hit = F.col(column) == level
        expression = F.when(hit, target) if expression is None else expression.when(hit, target)
    return df.withColumn(out, expression.otherwise(F.col(column)))


def tagged_union(parts: Sequence[tuple[Mapping[str, str], DataFrame]]) -> DataFrame:
    out = None
    for tags, frame in parts:
        tagged = frame.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def rule_filter(df: DataFrame, rules: Sequence[Mapping[str, str]]) -> DataFrame:
    """Keep rows matching any rule; a rule is a conjunction of equalities."""
    keep: Column | None = None
    for rule in rules:
        part = None
        for c, v in rule.items():
            part = (F.col(c) == v) if part is None else part & (F.col(c) == v)
        keep = part if keep is None else keep | part
    return df.where(keep)


def analysis_rows(df: DataFrame, specs: Sequence[Mapping]) -> DataFrame:
    """Rows of every analysis: name, optional exclusion and baseline filter, label column."""
    entries = [
        F.when(
            (F.lit(not s["exclude_control"]) | ~F.col("is_control"))
            & (F.lit(not s["baseline_only"]) | F.col("is_baseline")),
            F.struct(F.lit(s["name"]).alias("analysis"), F.col(s["label"]).cast("int").alias("label")),
        )
        for s in specs
    ]
    usable = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return df.withColumn("_a", F.explode(usable)).select("*", "_a.analysis", "_a.label").drop("_a")


def primary_models(df: DataFrame, fixed: str, nested: str, locked: DataFrame) -> DataFrame:
    """Fixed scorer, nested choice and the locked historical choice from a lookup."""
    own = df.where(F.col("model").isin(fixed, nested)).withColumn("primary", F.col("model"))
    # the lookup has one row per (task, dataset): a handful, so Spark may broadcast it by size
    old = df.join(locked, ["stratum"]).where(F.col("model") == F.col("locked"))
    old = old.withColumn("primary", F.concat(F.lit("historical_locked:"), "locked")).drop("locked")
    return own.unionByName(old)
