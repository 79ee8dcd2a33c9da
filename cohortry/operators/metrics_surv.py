"""Censored-survival metrics: concordance scopes, product-limit curves, IPCW."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle
from ..functions.scalars import safe_ratio
from .metrics_class import ranking
from .ordered import exact_quantiles, running_totals
from .pairs import concordance

COMPONENTS = ("pairs", "concordant", "tied")


def pool_components(parts: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Sum pair components over groups, then divide (never a mean of ratios)."""
    p, c, t = (F.sum(x) for x in COMPONENTS)
    return parts.groupBy(*keys).agg(
        p.alias(f"{prefix}pairs"),
        c.alias(f"{prefix}concordant"),
        t.alias(f"{prefix}tied"),
        safe_ratio(c + 0.5 * t, p).alias(f"{prefix}c_index"),
    )


def grouped_concordance(
    df: DataFrame, keys: Sequence[str], scope: Sequence[str], **options
) -> DataFrame:
    """Concordance over pairs that share the ``scope`` columns, pooled to ``keys``."""
    parts = concordance(df, [*keys, *scope], **options)
    return pool_components(parts, keys) if scope else parts


def reportable_by_stratum(
    df: DataFrame,
    *,
    stratum: str = "stratum",
    min_n: int,
    min_events: int,
    min_pairs: int,
    min_folds: int,
    fixed: Column | None = None,
) -> DataFrame:
    """Per (model, stratum): support, pooled and same-fold C, gate and reason text.

    ``fixed`` marks score sources on one scale for all folds: their primary
    value uses all pairs and the fold rule is waived.
    """
    is_fixed = fixed if fixed is not None else F.lit(False)
    keys = ["model", stratum]
    by_fold = settle(concordance(df, [*keys, "fold"], tied_censoring=True))
    crossfit = by_fold.groupBy(*keys).agg(
        F.sum("pairs").alias("crossfit_pairs"),
        safe_ratio(F.sum("concordant") + 0.5 * F.sum("tied"), F.sum("pairs")).alias("crossfit_c"),
        F.sum((F.col("pairs") > 0).cast("bigint")).alias("folds_with_pairs"),
    )
    pooled = concordance(df, keys, tied_censoring=True).select(
        *keys, F.col("pairs").alias("pooled_pairs"), F.col("c_index").alias("pooled_c")
    )
    support = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events")
    )
    joined = support.join(crossfit, keys, "left").join(pooled, keys, "left")
    primary_c = F.when(is_fixed, F.col("pooled_c")).otherwise(F.col("crossfit_c"))
    primary_pairs = F.when(is_fixed, F.col("pooled_pairs")).otherwise(F.col("crossfit_pairs"))
    ok = (
        (F.col("n") >= min_n)
        & (F.col("events") >= min_events)
        & (primary_pairs >= min_pairs)
        & (is_fixed | (F.col("folds_with_pairs") >= min_folds))
        & primary_c.isNotNull()
    )
    reason = F.concat(
        F.lit("support below threshold: n="), F.col("n"),
        F.lit(", events="), F.col("events"),
        F.lit(", pairs="), primary_pairs.cast("bigint"),
        F.lit(", folds_with_pairs="), F.col("folds_with_pairs"),
    )
    return joined.select(
        *keys,
        "n",
        "events",
        (F.col("n") - F.col("events")).alias("censored"),
        "pooled_c",
        F.col("pooled_pairs").cast("bigint").alias("pooled_pairs"),
        "crossfit_c",
        F.col("crossfit_pairs").cast("bigint").alias("crossfit_pairs"),
        "folds_with_pairs",
        primary_pairs.cast("bigint").alias("pairs"),
        ok.alias("reportable"),
        F.when(ok, primary_c).alias("c_index"),
        F.when(~ok, reason).alias("reason"),
    )


def weighted_over_strata(per_stratum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample- and pair-weighted means over the reportable strata."""
    used = per_stratum.where("reportable")

    def mean(weight: str) -> Column:
        return safe_ratio(F.sum(F.col("c_index") * F.col(weight)), F.sum(weight))

    return used.groupBy(*keys).agg(
        mean("n").alias("sample_weighted_c"),
        mean("pairs").alias("pair_weighted_c"),
        F.count(F.lit(1)).alias("eligible_strata"),
        F.sum("n").alias("eligible_n"),
        F.sum("events").alias("eligible_events"),
        F.sum("pairs").alias("eligible_pairs"),
    )


def outcome_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Permissible pairs from outcomes alone, tied event/censor pairs included."""
    flat = df.withColumn("_zero", F.lit(0.0))
    return concordance(flat, keys, risk="_zero", tied_censoring=True).select(
        *keys, F.col("pairs").cast("bigint").alias("outcome_pairs")
    )


def km_curve(
    df: DataFrame, keys: Sequence[str], *, duration: str = "duration", observed: str = "event"
) -> DataFrame:
    """Product-limit curve: one row per (keys, time) with at_risk, d, survival.

    ``before`` is the left limit.  The product is a running sum of logs, and a
    step that empties the risk set makes the curve zero.
    """
    keys = list(keys)
    steps = df.groupBy(*keys, F.col(duration).alias("time")).agg(
        F.count(F.lit(1)).alias("leaving"), F.sum(observed).alias("d")
    )
    return curve_from_steps(steps, keys)


def curve_from_steps(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`km_curve` from (keys, time, leaving, d) counts."""
    keys = list(keys)
    risk = running_totals(steps, keys, "time", {"at_risk": "leaving"}, descending=True)
    drop = F.when(
        (F.col("d") > 0) & (F.col("d") < F.col("at_risk")),
        F.log1p(-F.col("d") / F.col("at_risk")),
    ).otherwise(0.0)
    emptied = (F.col("at_risk") > 0) & (F.col("d") >= F.col("at_risk"))
    logged = risk.withColumn("_log", drop).withColumn("_end", emptied.cast("int"))
    run = running_totals(logged, keys, "time", {"_sum": "_log", "_ended": "_end"})
    return run.select(
        *keys,
        "time",
        "at_risk",
        "d",
        F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_sum")).alias("survival"),
        F.when(F.col("_ended") - F.col("_end") > 0, 0.0)
        .otherwise(F.exp(F.col("_sum") - F.col("_log")))
        .alias("before"),
    )


def curve_median(curve: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """First time with survival <= 0.5, NULL if never reached."""
    reached = F.col("survival") <= 0.5 + 1e-12
    return curve.groupBy(*keys).agg(F.min(F.when(reached, F.col("time"))).alias(out))


def cohort_by_stratum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, event rate, median time, KM and reverse-KM medians."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("event").alias("events"),
        F.sum(1 - F.col("event")).alias("censored"),
        F.avg("event").alias("event_rate"),
        F.min("duration").alias("duration_min"),
        F.max("duration").alias("duration_max"),
    )
    median = exact_quantiles(df, keys, "duration", {"median_time": 0.5})
    km = curve_median(km_curve(df, keys), keys, "km_median")
    flipped = df.withColumn("_censored", 1 - F.col("event"))
    reverse = curve_median(km_curve(flipped, keys, observed="_censored"), keys, "reverse_km_median")
    return counts.join(median, keys).join(km, keys).join(reverse, keys)


# ------------------------------------------------------------------- IPCW


def censoring_km(df: DataFrame, *, fold: str = "fold", folds: Sequence[int]) -> DataFrame:
    """Censoring curve of every training complement, for all folds in one job.

    Train counts are total minus fold at each time, so no row is replicated.
    The grid holds every observed time, so test times join by equality.
    """
    at = df.groupBy(F.col("duration").alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("event")).alias("c")
    )
    in_fold = df.groupBy(F.col("duration").alias("time"), F.col(fold).alias("k")).agg(
        F.count(F.lit(1)).alias("fn"), F.sum(1 - F.col("event")).alias("fc")
    )
    grid = at.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in folds])))
    train = grid.join(in_fold, ["time", "k"], "left").select(
        F.col("k").alias(fold),
        "time",
        (F.col("n") - F.coalesce("fn", F.lit(0))).alias("leaving"),
        (F.col("c") - F.coalesce("fc", F.lit(0))).alias("d"),
    )
    return curve_from_steps(train, [fold])


FLOOR = 1e-8


def ipcw(df: DataFrame, curve: DataFrame, horizons: Sequence[float], *, fold: str = "fold") -> DataFrame:
    """Case / control flags and weights per (row, horizon).

    Case (event by h): 1 / G(T-).  Control (T > h): 1 / G(h).  Otherwise 0.
    """
    at_time = curve.select(
        F.col(fold), F.col("time").alias("duration"), F.greatest(F.col("before"), F.lit(FLOOR)).alias("_g_left")
    )
    marks = [F.struct(F.lit(float(h)).alias("horizon")) for h in horizons]
    last = [
        F.max_by("survival", F.when(F.col("time") <= h, F.col("time"))).alias(f"_{i}")
        for i, h in enumerate(horizons)
    ]
    wide = curve.groupBy(fold).agg(*last)
    g_at = wide.select(
        fold,
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(float(h)).alias("horizon"),
                    F.greatest(F.coalesce(F.col(f"_{i}"), F.lit(1.0)), F.lit(FLOOR)).alias("g"),
                )
                for i, h in enumerate(horizons)
            ])
        ).alias("_m"),
    ).select(fold, F.col("_m.horizon").alias("horizon"), F.col("_m.g").alias("_g_h"))
    long = df.withColumn("_m", F.explode(F.array(*marks))).select("*", "_m.horizon").drop("_m")
    joined = long.join(at_time, [fold, "duration"], "left").join(g_at, [fold, "horizon"])
    case = (F.col("duration") <= F.col("horizon")) & (F.col("event") == 1)
    control = F.col("duration") > F.col("horizon")
    return joined.select(
        *[F.col(c) for c in df.columns],
        "horizon",
        case.cast("int").alias("is_case"),
        control.cast("int").alias("is_control"),
        F.when(case, 1 / F.col("_g_left")).when(control, 1 / F.col("_g_h")).otherwise(0.0).alias("ipcw"),
    )


def dynamic_auc(weighted: DataFrame, keys: Sequence[str], *, risk: str) -> DataFrame:
    """Weighted P(risk of a case > risk of a control), ties half; NULL if a side is empty."""
    out = ranking(
        weighted,
        keys,
        score=risk,
        positive=F.col("ipcw") * F.col("is_case"),
        negative=F.col("ipcw") * F.col("is_control"),
    )
    return out.select(*keys, F.col("auroc").alias("auc"), F.col("pairs").alias("pair_weight"))


def ipcw_brier(weighted: DataFrame, keys: Sequence[str], *, survival: str) -> DataFrame:
    """sum w (1{T > h} - S)^2 / n_test with the counts behind it."""
    gap = F.col("is_control") - F.col(survival)
    return weighted.groupBy(*keys).agg(
        (F.sum(F.col("ipcw") * gap * gap) / F.count(F.lit(1))).alias("brier"),
        F.sum("ipcw").alias("weight_sum"),
        F.sum("is_case").alias("n_cases"),
        F.sum("is_control").alias("n_controls"),
        F.sum(1 - F.col("is_case") - F.col("is_control")).alias("n_censored_before"),
    )


def pooled_time_metrics(by_fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair-weighted and plain fold means, sample sds, summed counts."""
    return by_fold.groupBy(*keys).agg(
        safe_ratio(F.sum(F.col("auc") * F.col("pair_weight")), F.sum("pair_weight")).alias("weighted_auc"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_samp("auc").alias("sd_auc"),
        F.avg("brier").alias("mean_brier"),
        F.stddev_samp("brier").alias("sd_brier"),
        F.sum("n_cases").alias("n_cases"),
        F.sum("n_controls").alias("n_controls"),
        F.sum("n_censored_before").alias("n_censored_before"),
    )


def ipcw_calibration(
    weighted: DataFrame, keys: Sequence[str], *, risk: str, iterations: int = 25, tolerance: float = 1e-10
) -> DataFrame:
    """Weighted logistic recalibration of logit(risk): intercept and slope per ``keys``.

    All keys are fitted together by Newton steps.  Data is first reduced to
    distinct (keys, risk) cells; each step is one aggregation whose result, two
    parameters per key, is written back as the next broadcast-free join side.
    """
    keys = list(keys)
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(risk)))
    cells = settle(
        weighted.where("ipcw > 0")
        .select(*keys, clipped.alias("_r"), "ipcw", "is_case")
        .groupBy(*keys, "_r")
        .agg(
            F.sum("ipcw").alias("_w"),
            F.sum(F.col("ipcw") * F.col("is_case")).alias("_wy"),
            F.count(F.lit(1)).alias("_c"),
        )
        .withColumn("_x", F.log(F.col("_r") / (1 - F.col("_r"))))
    )
    summary = cells.groupBy(*keys).agg(
        F.sum("_c").alias("n_known"),
        safe_ratio(F.sum("_wy"), F.sum("_w")).alias("observed_risk"),
        (F.sum(F.col("_r") * F.col("_c")) / F.sum("_c")).alias("mean_predicted"),
    )
    start = F.log(F.col("observed_risk") / (1 - F.col("observed_risk")))
    inside = (F.col("observed_risk") > 0) & (F.col("observed_risk") < 1)
    params = settle(
        summary.where(inside).select(
            *keys, start.alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("move")
        )
    )
    for _ in range(iterations):
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("_x"))))
        v = F.col("_w") * p * (1 - p)
        score = F.col("_wy") - F.col("_w") * p
        x = F.col("_x")
        sums = cells.join(params, keys).groupBy(*keys, "a", "b").agg(
            F.sum(score).alias("g0"), F.sum(score * x).alias("g1"),
            F.sum(v).alias("h00"), F.sum(v * x).alias("h01"), F.sum(v * x * x).alias("h11"),
        )
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        da = safe_ratio(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), det)
        db = safe_ratio(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), det)
        params = settle(sums.select(
            *keys,
            (F.col("a") + da).alias("a"),
            (F.col("b") + db).alias("b"),
            (F.abs(da) + F.abs(db)).alias("move"),
        ))
        worst = params.agg(F.max("move")).first()[0]
        if worst is None or worst < tolerance:
            break
    ok = F.col("move") < 1e-6
    return summary.join(params, keys, "left").select(
        *keys, "n_known", "observed_risk", "mean_predicted",
        F.when(ok, F.col("a")).alias("intercept"), F.when(ok, F.col("b")).alias("slope"),
    )


# ------------------------------------------------------------ pair scopes


def pair_scopes(
    models: DataFrame, *, fixed: Column, stratified: Column, strata: str = "stratum"
) -> DataFrame:
    """Valid pair scope per (model, estimand).

    Fixed scores compare all units; fitted scores only within a test fold; a
    stratified model has no global scope.  Paired deltas always use the common
    fold (and stratum) scope.
    """
    estimand = F.explode(F.array(F.lit("global"), F.lit("within_stratum")))
    long = models.select("model", estimand.alias("estimand"))
    is_global = F.col("estimand") == "global"
    scope = (
        F.when(is_global & stratified, "not_applicable")
        .when(is_global & fixed, "all")
        .when(is_global, "fold")
        .when(fixed, strata)
        .otherwise(f"fold+{strata}")
    )
    common = F.when(is_global, "fold").otherwise(f"fold+{strata}")
    return long.select("model", "estimand", scope.alias("scope"), common.alias("paired_scope"))


def scoped_concordance(df: DataFrame, scopes: DataFrame, *, strata: str = "stratum") -> DataFrame:
    """C per (model, estimand) in its own scope and in the common paired scope."""
    fine = settle(concordance(df, ["model", "fold", strata], tied_censoring=True))
    levels = {
        "all": concordance(df, ["model"], tied_censoring=True),
        "fold": pool_components(concordance(df, ["model", "fold"], tied_censoring=True), ["model"]),
        strata: pool_components(concordance(df, ["model", strata], tied_censoring=True), ["model"]),
        f"fold+{strata}": pool_components(fine, ["model"]),
    }
    table = None
    for name, frame in levels.items():
        part = frame.select("model", F.lit(name).alias("scope"), "pairs", "c_index")
        table = part if table is None else table.unionByName(part)
    table = settle(table)
    paired = table.select(
        "model", F.col("scope").alias("paired_scope"),
        F.col("pairs").alias("paired_pairs"), F.col("c_index").alias("paired_c"),
    )
    return scopes.join(table, ["model", "scope"], "left").join(paired, ["model", "paired_scope"], "left")


def fold_metrics(df: DataFrame, *, strata: str = "stratum") -> DataFrame:
    """Per (model, fold): n, events, C over all pairs and over same-stratum pairs."""
    keys = ["model", "fold"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"))
    whole = concordance(df, keys, tied_censoring=True).select(
        *keys, F.col("c_index").alias("global_c"), F.col("pairs").cast("bigint").alias("global_pairs")
    )
    within = pool_components(concordance(df, [*keys, strata], tied_censoring=True), keys).select(
        *keys, F.col("c_index").alias("within_c"), F.col("pairs").cast("bigint").alias("within_pairs")
    )
    return counts.join(whole, keys).join(within, keys)


def fold_deltas(metrics: DataFrame, *, baseline: str, value: str) -> DataFrame:
    """Per-fold delta to the baseline plus one summary row per model (fold NULL)."""
    base = metrics.where(F.col("model") == baseline).select("fold", F.col(value).alias("baseline_score"))
    joined = metrics.where(F.col("model") != baseline).join(base, "fold")
    joined = joined.select(
        "model", "fold", "baseline_score", F.col(value).alias("model_score"),
        (F.col(value) - F.col("baseline_score")).alias("delta"),
    )
    rows = joined.rollup("model", "fold").agg(
        F.grouping_id().alias("_g"),
        F.avg("baseline_score").alias("baseline_score"),
        F.avg("model_score").alias("model_score"),
        F.avg("delta").alias("delta"),
        F.count("delta").alias("n_fold_deltas"),
        F.stddev_samp("delta").alias("delta_sd"),
        F.sum((F.col("delta") > 0).cast("bigint")).alias("positive_folds"),
    )
    summary = F.col("_g") == 1
    return rows.where("_g < 3").select(
        F.when(summary, "fold_delta_summary").otherwise("fold_delta").alias("row_type"),
        "model", "fold", "baseline_score", "model_score", "delta",
        *[F.when(summary, F.col(c)).alias(c) for c in ("n_fold_deltas", "delta_sd", "positive_folds")],
    )


def by_unit_survival(df: DataFrame, keys: Sequence[str], unit: str, *, risk: str = "risk") -> DataFrame:
    """Mean risk per unit; duration, event and fold are constant within a unit."""
    return df.groupBy(*keys, unit).agg(
        F.min("duration").alias("duration"),
        F.min("event").alias("event"),
        F.avg(risk).alias(risk),
        F.min("fold").alias("fold"),
        F.count(F.lit(1)).alias("n_rows"),
    )
