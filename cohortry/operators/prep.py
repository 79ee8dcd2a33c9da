"""Fold-local preprocessing: fit on rows of the other folds, apply to the fold.

All folds are fitted in one job.  Additive statistics are total minus fold;
medians and ranges work on distinct values or per-fold extremes.  Sparse long
matrices (absent = 0) keep the absent cells in every count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import safe_ratio
from .contracts import ContractError
from .ordered import exact_quantiles


def _with_folds(df: DataFrame, folds: Sequence[int], name: str = "k") -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(k)) for k in folds])))


def fold_sizes(units: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(k, n_train): units outside fold k."""
    per = units.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("t")).scalar()
    return per.select(F.col("fold").alias("k"), (total - F.col("n")).alias("n_train"))


def train_moments(long: DataFrame, units: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(k, feature, mean, variance, scale): population moments over the training units.

    Values are centred by the overall feature mean before squares are summed,
    which avoids cancellation when total minus fold is formed.
    """
    n_units = units.agg(F.count(F.lit(1)).alias("n")).scalar()
    data = long.join(units.select("unit_id", "fold"), "unit_id")
    centre = data.groupBy("feature").agg((F.sum("value") / n_units).alias("_g"))
    dev = F.col("value") - F.col("_g")
    per_fold = data.join(centre, "feature").groupBy("feature", "fold").agg(
        F.first("_g").alias("_g"), F.count(F.lit(1)).alias("_c"),
        F.sum(dev).alias("_s"), F.sum(dev * dev).alias("_q"),
    )
    total = per_fold.groupBy("feature").agg(
        F.first("_g").alias("_g"), F.sum("_c").alias("_tc"), F.sum("_s").alias("_ts"), F.sum("_q").alias("_tq")
    )
    own = per_fold.select("feature", F.col("fold").alias("k"), "_c", "_s", "_q")
    grid = _with_folds(total, folds).join(own, ["feature", "k"], "left").join(fold_sizes(units, folds), "k")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    absent = F.col("n_train") - (F.col("_tc") - zero("_c"))
    s = F.col("_ts") - zero("_s") - absent * F.col("_g")
    q = F.col("_tq") - zero("_q") + absent * F.col("_g") * F.col("_g")
    shift = s / F.col("n_train")
    variance = F.greatest(F.lit(0.0), q / F.col("n_train") - shift * shift)
    out = grid.select("k", "feature", (F.col("_g") + shift).alias("mean"), variance.alias("variance"), "n_train")
    # rounding noise must not turn a constant column into a scaled one
    constant = F.col("variance") <= 1e-18 * (1 + F.col("mean") * F.col("mean"))
    return out.withColumn("scale", F.when(constant, 1.0).otherwise(F.sqrt("variance")))


def standardize(long: DataFrame, units: DataFrame, moments: DataFrame) -> DataFrame:
    """Stored cells of the test fold, scaled by the moments of the other folds."""
    test = long.join(units.select("unit_id", "fold"), "unit_id")
    fitted = moments.withColumnRenamed("k", "fold").select("fold", "feature", "mean", "scale")
    return test.join(fitted, ["fold", "feature"]).withColumn(
        "z", (F.col("value") - F.col("mean")) / F.col("scale")
    ).select("unit_id", "fold", "feature", "z")


def top_variance(moments: DataFrame, k: int) -> DataFrame:
    """The k features of largest training variance per fold, in name order."""
    order = W.partitionBy("k").orderBy(F.desc(F.round("variance", 9)), "feature")
    return moments.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def pca(vectors: DataFrame, folds: Sequence[int], components: int = 10) -> DataFrame:
    """(k, component, loadings, explained, mean, scale) of each training complement.

    Every task adds up its own p x p cross products per fold; those partial
    matrices, not the rows, are shuffled.  One eigen decomposition of a p x p
    matrix per fold runs in a task.  The sign makes the largest loading positive.
    """
    schema = "fold int, n double, s array<double>, c array<double>"

    def partial(batches):
        sums: dict[int, list] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = np.vstack(part["features"].to_numpy()).astype(float)
                entry = sums.setdefault(int(fold), [0.0, 0.0, 0.0])
                entry[0] += len(x)
                entry[1] = entry[1] + x.sum(axis=0)
                entry[2] = entry[2] + x.T @ x
        if sums:
            yield pd.DataFrame([
                {"fold": f, "n": float(n), "s": list(s), "c": list(c.ravel())} for f, (n, s, c) in sums.items()
            ])

    parts = vectors.select("fold", "features").mapInPandas(partial, schema)
    train = _with_folds(parts, folds).where(F.col("k") != F.col("fold"))

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["k"].iloc[0])
        n = pdf["n"].sum()
        mean = np.vstack(pdf["s"].to_numpy()).sum(axis=0) / n
        p = len(mean)
        cross = np.vstack(pdf["c"].to_numpy()).sum(axis=0).reshape(p, p) / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cross), 0, None))
        scale = np.where(sd <= 1e-12, 1.0, sd)
        values, axes = np.linalg.eigh(cross / np.outer(scale, scale))
        keep = min(components, int(n) - 1, p)
        order = np.argsort(values)[::-1][:keep]
        rows = []
        for i, j in enumerate(order):
            v = axes[:, j] * np.sign(axes[np.argmax(np.abs(axes[:, j])), j])
            rows.append({
                "k": fold, "component": i + 1, "loadings": list(v),
                "explained": float(values[j] / values.sum()), "mean": list(mean), "scale": list(scale),
            })
        return pd.DataFrame(rows)

    return train.groupBy("k").applyInPandas(
        decompose,
        "k int, component int, loadings array<double>, explained double, mean array<double>, scale array<double>",
    )


#: Numbers in the axes of all folds up to which they are broadcast (16 MB).
BROADCAST_NUMBERS = 2_000_000


def project(rows: DataFrame, fitted: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """``rows`` with ``pcs``, their scores on the axes of the fold that ``key`` names.

    The axes are one row per fold; a fold without axes gives NULL.  With the vectors' ``width`` known they are broadcast while small, so that the
    rows are not shuffled on a handful of fold values.
    """
    axes = fitted.groupBy(F.col("k").alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct("component", "loadings"))).alias("_axes"),
        F.first("mean").alias("_mean"), F.first("scale").alias("_scale"),
    )
    if width is not None and fitted.count() * width <= BROADCAST_NUMBERS:
        axes = F.broadcast(axes)
    joined = rows.join(axes, F.col(key) == F.col("_k"), "left")
    z = F.zip_with(
        F.zip_with("features", "_mean", lambda x, m: x - m), "_scale", lambda x, s: x / s
    )
    dot = lambda a: F.aggregate(
        F.zip_with(F.col("_z"), a["loadings"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x
    )
    scored = joined.withColumn("_z", z).withColumn("pcs", F.transform("_axes", dot))
    return scored.drop("_k", "_axes", "_mean", "_scale", "_z")


def pca_scores(vectors: DataFrame, fitted: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, fold, pcs) of the test rows; the fitted axes are K * components rows."""
    return project(vectors, fitted, "fold").select(unit, "fold", "pcs")


# -------------------------------------------------------------- categories


def train_level_counts(df: DataFrame, column: str, folds: Sequence[int]) -> DataFrame:
    """(k, level, n): level counts over the other folds."""
    per = df.where(F.col(column).isNotNull()).groupBy("fold", F.col(column).alias("level")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    spread = _with_folds(per, folds).where(F.col("k") != F.col("fold"))
    return spread.groupBy("k", "level").agg(F.sum("_c").alias("n"))


def impute_mode(df: DataFrame, column: str, folds: Sequence[int]) -> DataFrame:
    """(k, fill): most frequent training level, smallest on ties."""
    counts = train_level_counts(df, column, folds)
    return counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "level")).alias("m")).select(
        "k", F.col("m.level").alias("fill")
    )


def impute_median(df: DataFrame, column: str, folds: Sequence[int]) -> DataFrame:
    """(k, fill): exact training median from counts of distinct values."""
    counts = train_level_counts(df, column, folds)
    return exact_quantiles(counts, ["k"], "level", {"fill": 0.5}, weight="n")


def onehot(df: DataFrame, column: str, folds: Sequence[int], unit: str = "unit_id") -> DataFrame:
    """Indicator rows (unit, fold, feature, 1.0) of the test fold, first training level dropped."""
    levels = train_level_counts(df, column, folds)
    ranked = levels.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy("level")))
    kept = ranked.where("_r > 1").select(F.col("k").alias("fold"), F.col("level").alias(column))
    rows = df.join(kept, ["fold", column])
    clean = F.regexp_replace(F.concat_ws("_", F.lit(column), column), "[^0-9A-Za-z_]+", "_")
    return rows.select(unit, "fold", F.regexp_replace(clean, "^_+|_+$", "").alias("feature"), F.lit(1.0).alias("value"))


def unseen_levels(df: DataFrame, column: str, folds: Sequence[int]) -> DataFrame:
    """(fold, level) found in a test fold but not in its training folds."""
    test = df.where(F.col(column).isNotNull()).select(F.col("fold").alias("k"), F.col(column).alias("level")).distinct()
    return test.join(train_level_counts(df, column, folds), ["k", "level"], "left_anti")


def log_scaled(df: DataFrame, column: str, folds: Sequence[int], unit: str = "unit_id") -> DataFrame:
    """Train-median imputation, log1p (negative values are an error), train scaling."""
    if df.where(F.col(column) < 0).limit(1).count():
        raise ContractError(f"{column} must be non-negative for log1p")
    medians = impute_median(df, column, folds)
    # the imputed value depends on the fold under test, so moments are fitted on (k, row)
    spread = _with_folds(df.select(unit, "fold", column), folds).join(medians, "k")
    logged = spread.withColumn("_x", F.log1p(F.coalesce(F.col(column), F.col("fill"))))
    fitted = logged.where("k <> fold").groupBy("k").agg(
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("_sd")
    )
    test = logged.where("k = fold").join(fitted, "k")
    scale = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return test.select(unit, "fold", F.col("fill").alias("median"), ((F.col("_x") - F.col("mean")) / scale).alias("value"))


def varying_features(long: DataFrame, units: DataFrame, folds: Sequence[int], tolerance: float = 1e-12) -> DataFrame:
    """(k, feature) whose training range exceeds ``tolerance``; absent cells are zeros."""
    data = long.join(units.select("unit_id", "fold"), "unit_id")
    per = data.groupBy("feature", "fold").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_c")
    )
    spread = _with_folds(per, folds).where(F.col("k") != F.col("fold"))
    train = spread.groupBy("k", "feature").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.sum("_c").alias("c"))
    sized = train.join(fold_sizes(units, folds), "k")
    has_zero = F.col("c") < F.col("n_train")
    lo = F.when(has_zero, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(has_zero, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    return sized.where(hi - lo > tolerance).select("k", "feature")


def vectorize_maps(maps: DataFrame, folds: Sequence[int], unit: str = "unit_id") -> DataFrame:
    """Test cells of map features restricted to the training vocabulary of their fold."""
    cells = maps.select(unit, "fold", F.explode("features").alias("feature", "value"))
    vocabulary = _with_folds(cells.select("fold", "feature").distinct(), folds).where("k <> fold")
    vocabulary = vocabulary.select(F.col("k").alias("fold"), "feature").distinct()
    return cells.join(vocabulary, ["fold", "feature"], "left_semi")


def assemble(blocks: Mapping[str, DataFrame], unit: str = "unit_id") -> DataFrame:
    """Union of long covariate blocks; duplicate names or non-finite values are errors."""
    out = None
    for name, block in blocks.items():
        part = block.select(unit, "fold", F.concat(F.lit(f"{name}:"), "feature").alias("feature"), "value")
        out = part if out is None else out.unionByName(part)
    bad = out.where(F.isnan("value") | F.col("value").isNull() | (F.abs("value") == float("inf")))
    if bad.limit(1).count():
        raise ContractError("non-finite covariates")
    return out


def tie_canonical(df: DataFrame, keys: Sequence[str], covariates: Sequence[str], score: str) -> DataFrame:
    """Rows with identical covariates get their mean score (aggregate and join back)."""
    sign = F.xxhash64(*covariates)
    marked = df.withColumn("_sig", sign)
    means = marked.groupBy(*keys, "_sig", *covariates).agg(F.avg(score).alias(f"{score}_tied"))
    return marked.join(means, [*keys, "_sig", *covariates]).drop("_sig")


def duration_target(duration: Column) -> Column:
    return F.log1p(duration)


def duration_back(prediction: Column) -> Column:
    return F.expm1(prediction)


def round_metadata_scores(df: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Metadata-only scores to 12 digits, so algebraic ties compare equal."""
    meta = F.col(model).startswith("metadata_only|")
    return df.withColumn(score, F.when(meta, F.round(score, 12)).otherwise(F.col(score)))


def train_prevalence(units: DataFrame, folds: Sequence[int], outcome: str = "outcome") -> DataFrame:
    """(fold, prevalence) of the training complement: the score of a model without features."""
    per = units.groupBy("fold").agg(F.sum(outcome).alias("_p"), F.count(F.lit(1)).alias("_n"))
    spread = _with_folds(per, folds).where("k <> fold")
    return spread.groupBy(F.col("k").alias("fold")).agg(safe_ratio(F.sum("_p"), F.sum("_n")).alias("prevalence"))
