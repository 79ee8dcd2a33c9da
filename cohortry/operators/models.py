"""Cross-fitted models on pyspark.ml.

Features are one array column per unit.  Scaling constants are fitted on the
training folds (p numbers on the driver) and applied as array expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle

SEED = 42


def factories(rounds: int = 100) -> dict[str, tuple[Callable, bool]]:
    """name -> (estimator for (n rows, p features), needs scaling)."""
    return {
        "LR": (lambda n, p: LogisticRegression(
            featuresCol="x", labelCol="outcome", regParam=1.0 / n, standardization=False, maxIter=200), True),
        "SVM": (lambda n, p: LinearSVC(
            featuresCol="x", labelCol="outcome", regParam=1.0 / n, standardization=False, maxIter=50), True),
        "RF": (lambda n, p: RandomForestClassifier(
            featuresCol="x", labelCol="outcome", numTrees=100, seed=SEED), False),
        "MLP": (lambda n, p: MultilayerPerceptronClassifier(
            featuresCol="x", labelCol="outcome", layers=[p, 128, 64, 2], seed=SEED, maxIter=50), True),
        "GBT": (lambda n, p: GBTClassifier(
            featuresCol="x", labelCol="outcome", maxIter=rounds, maxDepth=4, seed=SEED), False),
    }


def _scaled(train: DataFrame, test: DataFrame, scale: bool) -> tuple[DataFrame, DataFrame, int, int]:
    row = train.select(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("features")).alias("s")
    ).first()["s"]
    n, mean = int(row["count"]), np.asarray(row["mean"].toArray())
    if not scale:
        x = array_to_vector(F.col("features").cast("array<double>"))
    else:
        sd = np.sqrt(np.asarray(row["variance"].toArray()) * (n - 1) / n)
        sd[sd <= 1e-12] = 1.0
        centred = F.zip_with("features", F.lit(mean.tolist()), lambda v, m: v - m)
        x = array_to_vector(F.zip_with(centred, F.lit(sd.tolist()), lambda v, s: v / s))
    return train.withColumn("x", x), test.withColumn("x", x), n, len(mean)


def _score(model, test: DataFrame) -> DataFrame:
    out = model.transform(test)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
        kind = F.lit("probability")
    else:
        # a margin ranks but is no probability; squash it where [0, 1] is needed
        margin = vector_to_array("rawPrediction")[1]
        out = out.withColumn("margin", margin)
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))
        kind = F.lit("decision_margin")
    return out.withColumns({
        "score": score, "score_kind": kind, "call": F.col("prediction").cast("int"),
    })


def oof_scores(df: DataFrame, factory: tuple[Callable, bool], folds: Sequence[int], name: str, unit: str = "unit_id") -> DataFrame:
    """Fit on the complement of each fold, score the fold: one row per unit."""
    build, scale = factory
    out = None
    for fold in folds:
        train, test, n, p = _scaled(df.where(F.col("fold") != fold), df.where(F.col("fold") == fold), scale)
        model = build(n, p).fit(train.withColumn("outcome", F.col("outcome").cast("double")))
        part = _score(model, test).select(
            unit, "group_id", "outcome", "fold", F.lit(name).alias("model"), "score", "call", "score_kind"
        )
        out = part if out is None else out.unionByName(part)
    return out


def candidate_pool(
    features: dict[str, DataFrame], models: dict[str, tuple[Callable, bool]], folds: Sequence[int], threads: int = 4
) -> DataFrame:
    """Out-of-fold rows of every feature set x classifier; fits run side by side."""
    jobs = [(f"{f}+{m}", df, factory) for f, df in sorted(features.items()) for m, factory in sorted(models.items())]
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(lambda j: oof_scores(j[1], j[2], folds, j[0]), jobs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nested_select(inner: DataFrame, outer: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best inner AUROC per outer fold (ties by name); its outer rows become ``nested_selected``.

    ``inner``: (keys, outer_fold, model, auroc).  ``outer``: predictions with fold.
    """
    best = inner.groupBy(*keys, "outer_fold").agg(
        F.min(F.struct((-F.col("auroc")).alias("a"), "model")).alias("_b")
    ).select(*keys, F.col("outer_fold").alias("fold"), F.col("_b.model").alias("selected_candidate"))
    joined = outer.join(best, [*keys, "fold"]).where(F.col("model") == F.col("selected_candidate"))
    return joined.withColumn("model", F.lit("nested_selected"))


def duration_regression(df: DataFrame, folds: Sequence[int], unit: str = "unit_id") -> DataFrame:
    """Regress log1p(duration), ignoring censoring; both score orientations are returned."""
    out = None
    for fold in folds:
        train, test, n, _ = _scaled(df.where(F.col("fold") != fold), df.where(F.col("fold") == fold), True)
        model = LinearRegression(
            featuresCol="x", labelCol="_y", regParam=1.0 / n, standardization=False, solver="normal"
        ).fit(train.withColumn("_y", F.log1p("duration")))
        predicted = F.expm1("prediction")
        part = model.transform(test).select(
            unit, "fold", "duration", "event", predicted.alias("predicted_duration"),
            (-predicted).alias("risk_from_negative_duration"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def fixed_score(df: DataFrame, column: str, model: str | Column, threshold: float = 0.0) -> DataFrame:
    """A precomputed score used as a model of the given name; call = score >= threshold."""
    return df.withColumns({
        "model": F.lit(model), "score": F.col(column), "call": (F.col(column) >= threshold).cast("int"),
    })


def fit_audit(predictions: DataFrame, auc: DataFrame) -> DataFrame:
    """Per (model, fold): train and test sizes and positives, test AUROC, id digest.

    The digest is an order-free sum of id hashes, so no fold is collected.
    """
    per = predictions.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("outcome").alias("pos_test"),
        F.sum(F.conv(F.substring(F.md5(F.col("unit_id").cast("string")), 1, 8), 16, 10).cast("bigint")).alias("test_ids"),
    )
    total = per.groupBy("model").agg(F.sum("n_test").alias("_n"), F.sum("pos_test").alias("_p"))
    return per.join(total, "model").join(auc.select("model", "fold", F.col("auroc").alias("test_auc")), ["model", "fold"]).select(
        "model", "fold", (F.col("_n") - F.col("n_test")).alias("n_train"), "n_test",
        (F.col("_p") - F.col("pos_test")).alias("pos_train"), "pos_test", "test_auc", "test_ids",
    )
