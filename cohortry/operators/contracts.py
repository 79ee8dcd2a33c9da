"""Data contracts: each check returns violations as (rule, key, detail) rows.

No row means the contract holds.  :func:`enforce` is the strict mode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """A contract in strict mode found violations."""


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])


def _rows(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.alias("key"), detail.alias("detail"))


def enforce(violations: DataFrame) -> None:
    """Raise if there is any violation; at most five are shown."""
    found = violations.limit(5).collect()
    if found:
        shown = "; ".join(f"{r.rule}: {r.key} ({r.detail})" for r in found)
        raise ContractError(shown)


def unique_key(df: DataFrame, keys: Sequence[str], rule: str = "unique_key") -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return _rows(counted, rule, key_text(keys), F.concat(F.lit("rows="), F.col("_n")))


def id_set_equal(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ids missing from ``observed`` and ids it has in excess."""
    keys = list(keys)
    left, right = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    missing = _rows(left.join(right, keys, "left_anti"), "id_set", key_text(keys), F.lit("missing"))
    extra = _rows(right.join(left, keys, "left_anti"), "id_set", key_text(keys), F.lit("extra"))
    return missing.unionByName(extra)


def row_order(numbered: DataFrame, key: str, position: str, row_number: str) -> DataFrame:
    """Declared 0-based positions against the canonical row number (1-based)."""
    bad = numbered.where(~F.col(position).eqNullSafe(F.col(row_number) - 1))
    detail = F.concat(
        F.lit("declared="), F.col(position), F.lit(" canonical="), F.col(row_number) - 1
    )
    return _rows(bad, "row_order", F.col(key).cast("string"), detail)


def constant_within_group(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Functional dependency group -> column; NULL counts as a value.

    min = max with a NULL count replaces a distinct count, so one partial
    aggregation covers all columns.
    """
    aggregates = []
    for c in columns:
        differs = ~F.min(c).eqNullSafe(F.max(c))
        mixed = (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))
        aggregates.append((differs | mixed).alias(f"_v_{c}"))
    checked = df.groupBy(*group).agg(*aggregates)
    broken = F.filter(
        F.array(*[F.when(F.col(f"_v_{c}"), F.lit(c)) for c in columns]), lambda x: x.isNotNull()
    )
    listed = checked.withColumn("_c", F.explode(broken))
    return _rows(listed, "constant_within_group", key_text(group), F.col("_c"))


def domain(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Rows for which a named predicate is false or NULL."""
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(p, F.lit(False)), F.lit(name)) for name, p in rules.items()]),
        lambda x: x.isNotNull(),
    )
    listed = df.withColumn("_rule", F.explode(failed))
    return listed.select(
        F.col("_rule").alias("rule"), key_text(key).alias("key"), F.lit("value outside domain").alias("detail")
    )


def both_classes(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    counts = df.agg(F.min(outcome).alias("lo"), F.max(outcome).alias("hi"))
    return _rows(
        counts.where("NOT (lo <=> 0 AND hi <=> 1)"), "both_classes", F.lit(outcome),
        F.concat(F.lit("min="), F.col("lo"), F.lit(" max="), F.col("hi")),
    )


def value_agreement(
    canonical: DataFrame, source: DataFrame, keys: Sequence[str], column: str, tolerance: float | None = None
) -> DataFrame:
    """Canonical and source values of the same key must agree (exactly or within tolerance)."""
    a, b = canonical.select(*keys, F.col(column).alias("_a")), source.select(*keys, F.col(column).alias("_b"))
    same = (
        F.col("_a").eqNullSafe(F.col("_b"))
        if tolerance is None
        else F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.col("_a").isNull() & F.col("_b").isNull())
    )
    return _rows(a.join(b, list(keys)).where(~same), "value_agreement", key_text(keys), F.lit(column))


def same_units(df: DataFrame, model: str, unit: Sequence[str]) -> DataFrame:
    """Every model must cover every unit."""
    per_unit = df.groupBy(*unit).agg(F.count_distinct(model).alias("_have"))
    wanted = df.agg(F.count_distinct(model).alias("n")).scalar()
    short = per_unit.withColumn("_want", wanted).where("_have < _want")
    return _rows(
        short, "same_units", key_text(unit), F.concat(F.lit("models="), F.col("_have"), F.lit("/"), F.col("_want"))
    )


def expected_counts(df: DataFrame, keys: Sequence[str], expected: DataFrame, count: str = "n") -> DataFrame:
    """Category counts against a prespecified table, in both directions."""
    observed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_obs"))
    joined = observed.join(expected.withColumnRenamed(count, "_exp"), list(keys), "full")
    detail = F.concat(
        F.lit("observed="), F.coalesce("_obs", F.lit(0)), F.lit(" expected="), F.coalesce("_exp", F.lit(0))
    )
    return _rows(joined.where("NOT (_obs <=> _exp)"), "expected_counts", key_text(keys), detail)


def reproduction_gate(
    refit: DataFrame, stored: DataFrame, keys: Sequence[str], value: str, tolerance: float, by: str = "model"
) -> DataFrame:
    """n, max and mean absolute difference per model, and whether the gate passes."""
    stored = stored.select(*keys, F.col(value).alias("_ref"))
    gap = F.abs(F.col(value) - F.col("_ref"))
    return refit.join(stored, list(keys), "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        ((F.max(gap) <= tolerance) & (F.count("_ref") == F.count(F.lit(1)))).alias("passed"),
    )


def group_leakage(df: DataFrame, group: str = "group_id", fold: str = "fold") -> DataFrame:
    """Groups found in more than one fold."""
    leaked = df.groupBy(group).agg(F.min(fold).alias("_a"), F.max(fold).alias("_b")).where("_a <> _b")
    return _rows(
        leaked, "group_leakage", F.col(group).cast("string"),
        F.concat(F.lit("folds "), F.col("_a"), F.lit(".."), F.col("_b")),
    )


def forbidden_fields(df: DataFrame, key: str, payload: str, forbidden: Sequence[str]) -> DataFrame:
    """Identifier or outcome fields inside a JSON block."""
    names = F.array(*[F.lit(f) for f in forbidden])
    hits = F.array_sort(F.array_intersect(F.json_object_keys(F.col(payload)), names))
    found = df.withColumn("_hits", hits).where(F.size("_hits") > 0)
    return _rows(found, "forbidden_fields", F.col(key).cast("string"), F.array_join("_hits", ","))


def class_support(df: DataFrame, keys: Sequence[str], fold: str = "fold", outcome: str = "outcome") -> DataFrame:
    """Both classes on the train and test side of every fold."""
    keys = list(keys)
    per_fold = df.groupBy(*keys, fold).agg(
        F.sum(outcome).alias("_p"), F.sum(1 - F.col(outcome)).alias("_n")
    )
    total = per_fold.groupBy(*keys).agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    if keys:
        joined = per_fold.join(total, keys)
    else:
        joined = per_fold.withColumns({c: total.select(c).scalar() for c in ("_tp", "_tn")})
    sides = {
        "test_positive": F.col("_p"),
        "test_negative": F.col("_n"),
        "train_positive": F.col("_tp") - F.col("_p"),
        "train_negative": F.col("_tn") - F.col("_n"),
    }
    empty = F.filter(
        F.array(*[F.when(v == 0, F.lit(k)) for k, v in sides.items()]), lambda x: x.isNotNull()
    )
    listed = joined.withColumn("_side", F.explode(empty))
    return _rows(listed, "class_support", key_text([*keys, fold]), F.col("_side"))
