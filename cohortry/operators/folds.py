"""Leakage-free folds and deterministic selections, drawn by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import hash32
from .contracts import ContractError, constant_within_group, enforce
from .ordered import exact_quantiles, hash_row_number, row_number


def kfold(df: DataFrame, unit: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled K folds whose sizes differ by at most one."""
    numbered = hash_row_number(df, [], unit, f"{seed}:")
    return numbered.withColumn("fold", ((F.col("rn") - 1) % k + 1).cast("int")).drop("rn")


def stratified_patient_folds(
    df: DataFrame, group: str = "group_id", outcome: str = "outcome", k: int = 5, seed: int = 42,
    strict: bool = True,
) -> DataFrame:
    """(group, fold): one row per group, shuffled within the outcome stratum."""
    if strict:
        enforce(constant_within_group(df, [group], [outcome]))
    units = df.groupBy(group).agg(F.min(outcome).alias(outcome))
    if strict:
        smallest = units.groupBy(outcome).count().agg(F.min("count")).first()[0]
        if smallest < 5:
            raise ContractError("fewer than five groups in an outcome stratum")
    numbered = hash_row_number(units, [outcome], group, f"{seed}:")
    return numbered.select(group, ((F.col("rn") - 1) % k + 1).cast("int").alias("fold"))


def snake(rank: Column, k: Column | int) -> Column:
    """1..K, K..1, 1..K, ... along a 1-based rank."""
    position = (rank - 1) % k
    turned = F.floor((rank - 1) / k) % 2 == 1
    return F.when(turned, k - position).otherwise(position + 1).cast("int")


def _group_ranks(df: DataFrame, keys: Sequence[str], group: str, outcome: str, seed: int) -> DataFrame:
    """Groups of (keys): size, positives, rank by (class, size descending, hash)."""
    groups = df.groupBy(*keys, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("pos")
    )
    groups = groups.withColumn("_class", (F.col("pos") > 0).cast("int"))
    salted = F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))
    # one sortable number: larger groups first, then the 32-bit hash
    groups = groups.withColumn("_order", -F.col("n") * F.lit(1 << 32) + hash32(salted))
    return row_number(groups, [*keys, "_class"], "_order", ties=[group])


def stratified_group_folds(
    df: DataFrame, keys: Sequence[str] = (), group: str = "group_id", outcome: str = "outcome",
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """(keys, group, fold) with disjoint groups and balanced classes.

    Groups are dealt to the folds in a snake, largest first, separately for
    groups with and without a positive row.
    """
    ranked = _group_ranks(df, keys, group, outcome, seed)
    return ranked.select(*keys, group, "n", "pos", snake(F.col("rn"), k).alias("fold"))


def inner_folds(
    df: DataFrame, group: str = "group_id", outcome: str = "outcome", fold: str = "fold",
    folds: Sequence[int] = (1, 2, 3, 4, 5), most: int = 4, seed: int = 42,
) -> DataFrame:
    """Nested folds inside each outer training set; the largest valid K of most..2."""
    per_group = df.groupBy(group, fold).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(outcome).alias("_p")
    )
    outer = per_group.withColumn("outer_fold", F.explode(F.array(*[F.lit(f) for f in folds])))
    train = outer.where(F.col(fold) != F.col("outer_fold"))
    groups = train.groupBy("outer_fold", group).agg(F.sum("_n").alias("n"), F.sum("_p").alias("pos"))
    groups = groups.withColumn("_class", (F.col("pos") > 0).cast("int"))
    salted = F.concat((F.lit(seed) + F.col("outer_fold")).cast("string"), F.lit(":"), F.col(group).cast("string"))
    groups = groups.withColumn("_order", -F.col("n") * F.lit(1 << 32) + hash32(salted))
    ranked = row_number(groups, ["outer_fold", "_class"], "_order", ties=[group])
    tries = ranked.withColumn("k", F.explode(F.array(*[F.lit(x) for x in range(2, most + 1)])))
    dealt = tries.withColumn("inner_fold", snake(F.col("rn"), F.col("k")))
    per_fold = dealt.groupBy("outer_fold", "k", "inner_fold").agg(
        F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q")
    )
    valid = (
        per_fold.groupBy("outer_fold", "k")
        .agg(F.count(F.lit(1)).alias("found"), F.min("p").alias("p"), F.min("q").alias("q"))
        .where("found = k AND p > 0 AND q > 0")
        .groupBy("outer_fold").agg(F.max("k").alias("k"))
    )
    return dealt.join(valid, ["outer_fold", "k"], "left_semi").select(
        "outer_fold", group, F.col("k").alias("n_splits"), "inner_fold"
    )


def fold_drift(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that differ between a frozen and a recomputed assignment."""
    cols = expected.columns
    gone = stored.select(*cols).exceptAll(expected).withColumn("side", F.lit("stored"))
    new = expected.exceptAll(stored.select(*cols)).withColumn("side", F.lit("expected"))
    return gone.unionByName(new)


def leave_one_group_out(df: DataFrame, unit: str, stratum: str = "stratum", fold: str = "fold") -> DataFrame:
    """(unit, scheme, partition): each unit's test partition under both schemes."""
    entries = F.array(
        F.struct(F.lit("leave_one_out").alias("scheme"), F.col(stratum).cast("string").alias("partition")),
        F.struct(F.lit("kfold").alias("scheme"), F.concat(F.lit("fold_"), F.col(fold)).alias("partition")),
    )
    return df.select(unit, F.explode(entries).alias("_e")).select(unit, "_e.scheme", "_e.partition")


def repeated_folds(df: DataFrame, unit: str, seeds: Sequence[int], k: int = 5) -> DataFrame:
    """(unit, repeat_seed, fold): one stratum-free hash assignment per seed."""
    long = df.select(unit).distinct().withColumn("repeat_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    key = F.concat(F.col("repeat_seed").cast("string"), F.lit(":"), F.col(unit).cast("string"))
    return long.withColumn("fold", (hash32(key) % k + 1).cast("int"))


def train_validation(df: DataFrame, keys: Sequence[str], unit: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Flag a random validation share: at least one row, at most n - 1."""
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = hash_row_number(df, keys, unit, f"{seed}:")
    want = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.round(F.col("_n") * fraction)))
    return numbered.join(sizes, keys).withColumn("is_validation", F.col("rn") <= want).drop("rn", "_n")


# ------------------------------------------------------- names and classes


def canonical_group(name: Column) -> Column:
    """Strip one known prefix and one known suffix (fixed values)."""
    trimmed = F.regexp_replace(F.trim(name), "^(Pre_|Post_)", "")
    return F.regexp_replace(trimmed, "(_T_enriched|_myeloid_enriched|_2)$", "")


def timing_class(label: Column) -> Column:
    text = F.upper(F.trim(label))
    return (
        F.when(text == "PRE", "pretreatment")
        .when(text.isin("EDT", "ON"), "on_treatment")
        .otherwise("unverified")
    )


def study_source(name: Column) -> Column:
    text = F.trim(name)
    return (
        F.when(text.startswith("IPI_"), "VanAllen").when(text.startswith("Patient"), "Liu").otherwise("unresolved")
    )


# ---------------------------------------------------------- ordered limits


def _head(df: DataFrame, order: str, n: int, priority: int) -> DataFrame:
    """First n rows as a distributed top-k."""
    return df.orderBy(order).limit(n).withColumn("_priority", F.lit(priority))


def _fill(picked: DataFrame, df: DataFrame, unit: str, order: str, limit: int) -> DataFrame:
    rest = df.join(picked.select(unit), [unit], "left_anti")
    filled = picked.unionByName(_head(rest, order, limit, 9))
    return filled.orderBy("_priority", order).limit(limit).drop("_priority")


def balanced_limit(df: DataFrame, unit: str, order: str, limit: int, outcome: str = "outcome") -> DataFrame:
    """Half negatives, half positives in order, topped up from the rest."""
    negatives = limit // 2
    picked = _head(df.where(F.col(outcome) == 0), order, negatives, 0).unionByName(
        _head(df.where(F.col(outcome) == 1), order, limit - negatives, 1)
    )
    return _fill(picked, df, unit, order, limit)


def interleave_limit(df: DataFrame, order: str, limit: int, outcome: str = "outcome") -> DataFrame:
    """Positive, negative, positive, ... then cut.  Only 2 * limit rows are numbered."""
    heads = _head(df.where(F.col(outcome) == 1), order, limit, 0).unionByName(
        _head(df.where(F.col(outcome) == 0), order, limit, 1)
    )
    turn = F.row_number().over(W.partitionBy("_priority").orderBy(order))
    return heads.withColumn("_turn", turn).orderBy("_turn", "_priority").limit(limit).drop("_turn", "_priority")


def tertile_limit(df: DataFrame, unit: str, order: str, limit: int) -> DataFrame:
    """Early events, late censored and the remainder, a third each, then topped up."""
    cuts = exact_quantiles(df, [], "duration", {"lo": 0.33, "hi": 0.67}).first()
    early = (F.col("event") == 1) & (F.col("duration") <= cuts["lo"])
    late = (F.col("event") == 0) & (F.col("duration") >= cuts["hi"])
    third = limit // 3
    picked = _head(df.where(early), order, third, 0)
    picked = picked.unionByName(_head(df.where(late), order, third, 1))
    picked = picked.unionByName(_head(df.where(~early & ~late), order, limit - 2 * third, 2))
    return _fill(picked, df, unit, order, limit)
