"""Registered queries: classification metrics (g) and rank statistics (j)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import metrics_class as mc, rankstats as rs
from . import views
from .registry import query

THRESHOLDS = {"base": 100.0, "price": 200.0, "disc": 20.0, "fixed__lines": 4.0}
CALL_SQL = "cast(case when score >= case model " + " ".join(
    f"when '{m}' then {t}" for m, t in THRESHOLDS.items()
) + " end then 1 else 0 end as int)"


def called(spark, sf) -> DataFrame:
    threshold = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])[F.col("model")]
    return views.predictions(spark, sf).withColumn("call", (F.col("score") >= threshold).cast("int"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


_CONFUSION = f"""
with c as (select model, fold,
 cast(sum(case when outcome=1 and call=1 then 1 else 0 end) as bigint) tp,
 cast(sum(case when outcome=0 and call=0 then 1 else 0 end) as bigint) tn,
 cast(sum(case when outcome=0 and call=1 then 1 else 0 end) as bigint) fp,
 cast(sum(case when outcome=1 and call=0 then 1 else 0 end) as bigint) fn
 from (select *, {CALL_SQL} call from predictions) group by model, fold)"""

_AUC = """
ranked as (select {keys}, outcome, (rank() over (partition by {keys} order by score)
 + (count(*) over (partition by {keys}, score) - 1) / 2.0) r from {source}),
auc as (select {keys}, cast(sum(outcome) as double) n1, cast(sum(1-outcome) as double) n0,
 sum(case when outcome=1 then r end) - sum(outcome)*(sum(outcome)+1)/2.0 u from ranked group by {keys})"""

_AP = """
d as (select {keys}, score, sum(outcome) p, count(*) c from {source} group by {keys}, score),
r as (select *, sum(p) over (partition by {keys} order by score desc) cp,
 sum(c) over (partition by {keys} order by score desc) cc, sum(p) over (partition by {keys}) n1 from d)"""


@query("g01_confusion", _CONFUSION + """
select model, fold, tp, tn, fp, fn, tp+tn+fp+fn n_samples,
 round((tp+tn)*1.0/(tp+tn+fp+fn), 4) accuracy,
 round(coalesce(tp*1.0/nullif(tp+fp,0),0), 4) as precision,
 round(coalesce(tp*1.0/nullif(tp+fn,0),0), 4) recall,
 round(coalesce(tn*1.0/nullif(tn+fp,0),0), 4) specificity,
 round(coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0), 4) f1 from c""", ("predictions",))
def g01(spark, sf):
    out = mc.confusion(called(spark, sf), ["model", "fold"]).drop("macro_f1")
    return rounded(out, 4, "accuracy", "precision", "recall", "specificity", "f1")


@query("g02_macro_f1", _CONFUSION + """
select model, fold, round((coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0)
 + coalesce(2.0*tn/nullif(2*tn+fp+fn,0),0))/2, 6) macro_f1 from c""", ("predictions",))
def g02(spark, sf):
    out = mc.confusion(called(spark, sf), ["model", "fold"])
    return rounded(out.select("model", "fold", "macro_f1"), 6, "macro_f1")


@query("g03_auroc", "with " + _AUC.format(keys="model, stratum", source="predictions") + """
select model, stratum, n1 positive, n0 negative, round(u/nullif(n1*n0,0), 6) auroc from auc""", ("predictions",))
def g03(spark, sf):
    out = mc.ranking(views.predictions(spark, sf), ["model", "stratum"])
    return rounded(out.select("model", "stratum", "positive", "negative", "auroc"), 6, "auroc")


@query("g04_auprc", "with " + _AP.format(keys="model, stratum", source="predictions") + """
select model, stratum, round(sum(p*1.0/n1 * cp/cc), 6) auprc from r group by 1,2""", ("predictions",))
def g04(spark, sf):
    out = mc.ranking(views.predictions(spark, sf), ["model", "stratum"])
    return rounded(out.select("model", "stratum", "auprc"), 6, "auprc")


@query("g05_auroc_within_fold", "with " + _AUC.format(keys="model, fold", source="predictions") + """
select model, round(sum(u)/nullif(sum(n1*n0),0), 6) auroc, cast(sum(n1*n0) as bigint) comparable_pairs
 from auc group by 1""", ("predictions",))
def g05(spark, sf):
    by_fold = mc.ranking(views.predictions(spark, sf), ["model", "fold"])
    out = mc.within_fold_auroc(by_fold, ["model"])
    return rounded(out.select("model", "auroc", "comparable_pairs"), 6, "auroc")


@query("g06_auroc_fold_mean", "with " + _AUC.format(keys="model, stratum, fold", source="predictions") + """
select model, stratum, round(avg(case when n1*n0>0 then u/(n1*n0) end), 6) mean_fold_auroc
 from auc group by 1,2""", ("predictions",))
def g06(spark, sf):
    by_fold = mc.ranking(views.predictions(spark, sf), ["model", "stratum", "fold"])
    out = mc.within_fold_auroc(by_fold, ["model", "stratum"])
    return rounded(out.select("model", "stratum", "mean_fold_auroc"), 6, "mean_fold_auroc")


@query("g07_auroc_pooled", "with " + _AUC.format(keys="model", source="predictions") + """
select model, cast(n1 as bigint) positive, cast(n0 as bigint) negative, round(u/(n1*n0), 6) pooled_auroc from auc""",
       ("predictions",))
def g07(spark, sf):
    out = mc.ranking(views.predictions(spark, sf), ["model"])
    return out.select(
        "model", F.col("positive").cast("bigint").alias("positive"),
        F.col("negative").cast("bigint").alias("negative"), F.round("auroc", 6).alias("pooled_auroc"),
    )


_TWO = "(select * from predictions where stratum in ('BUILDING', 'MACHINERY'))"


@query("g08_subgroup_auroc", "with " + _AUC.format(keys="model, stratum, fold", source=_TWO) + """
select model, stratum, round(sum(u)/nullif(sum(n1*n0),0), 6) auroc, cast(sum(n1*n0) as bigint) comparable_pairs
 from auc group by 1,2""", ("predictions",))
def g08(spark, sf):
    chosen = views.predictions(spark, sf).where(F.col("stratum").isin("BUILDING", "MACHINERY"))
    by_fold = mc.ranking(chosen, ["model", "stratum", "fold"])
    out = mc.within_fold_auroc(by_fold, ["model", "stratum"])
    return rounded(out.select("model", "stratum", "auroc", "comparable_pairs"), 6, "auroc")


@query("g09_unit_aggregate_class", f"""
select model, group_id, min(outcome) outcome, round(avg(score), 6) score, min(fold) fold, count(*) n_samples,
 cast(case when avg({CALL_SQL}) >= 0.5 then 1 else 0 end as int) call from predictions group by 1,2""", ("predictions",))
def g09(spark, sf):
    return rounded(mc.by_unit(called(spark, sf), ["model"]), 6, "score")


@query("g10_majority_call", f"""
select model, call, count(*) n_groups, cast(sum(outcome) as bigint) positive from (
 select model, group_id, min(outcome) outcome, cast(case when avg({CALL_SQL}) >= 0.5 then 1 else 0 end as int) call
 from predictions group by 1,2) group by 1,2""", ("predictions",))
def g10(spark, sf):
    units = mc.by_unit(called(spark, sf), ["model"])
    return units.groupBy("model", "call").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("outcome").alias("positive")
    )


@query("g11_delta_vs_context", "with " + _AUC.format(keys="stratum, model, fold", source="predictions") + """,
m as (select stratum, model, sum(u)/nullif(sum(n1*n0),0) a from auc group by 1,2)
select m.stratum, m.model, round(m.a, 6) auroc, round(c.a, 6) reference, round(m.a-c.a, 6) delta
 from m join m c on m.stratum=c.stratum and c.model='fixed__lines'""", ("predictions",))
def g11(spark, sf):
    by_fold = mc.ranking(views.predictions(spark, sf), ["stratum", "model", "fold"])
    metrics = mc.within_fold_auroc(by_fold, ["stratum", "model"]).select("stratum", "model", "auroc")
    out = mc.delta_to_reference(metrics, ["stratum"], "model", "fixed__lines", "auroc")
    return rounded(out, 6, "auroc", "reference", "delta")


@query("g12_metrics_long", "with " + _AUC.format(keys="model", source="predictions") + "," +
       _AP.format(keys="model", source="predictions") + f""",
m as (select model, round(avg(case when outcome={CALL_SQL} then 1.0 else 0 end), 6) accuracy, count(*) n
 from predictions group by 1),
w as (select m.model, n, u/(n1*n0) auroc, ap, accuracy from m join auc using (model)
 join (select model, sum(p*1.0/n1 * cp/cc) ap from r group by 1) using (model))
select model, n, 'sample' analysis_level, 'AUROC' metric, round(auroc,6) estimate from w union all
select model, n, 'sample', 'AUPRC', round(ap,6) from w union all
select model, n, 'sample', 'ACCURACY', round(accuracy,6) from w""", ("predictions",))
def g12(spark, sf):
    pred = called(spark, sf)
    rank = mc.ranking(pred, ["model"]).select("model", "auroc", "auprc")
    conf = mc.confusion(pred, ["model"]).select("model", F.col("n_samples").alias("n"), "accuracy")
    long = mc.metrics_long(rank.join(conf, "model"), ["model", "n"], ["auroc", "auprc", "accuracy"])
    return rounded(long.withColumn("analysis_level", F.lit("sample")), 6, "estimate")


@query("g13_cohort_audit", """
with g as (select stratum, group_id, count(*) n, min(outcome) o, sum(outcome) p, sum(event) e, max(event) ae,
 min(duration) dmin, max(duration) dmax from units group by 1,2)
select stratum, cast(sum(n) as bigint) n_samples, count(*) n_groups, cast(sum(p) as bigint) positive_samples,
 cast(sum(o) as bigint) positive_groups, cast(sum(e) as bigint) events_samples, cast(sum(ae) as bigint) event_groups,
 cast(sum(case when n>1 then 1 else 0 end) as bigint) repeated_groups, min(dmin) duration_min, max(dmax) duration_max
 from g group by 1""", ("units",))
def g13(spark, sf):
    return mc.cohort_audit(views.units(spark, sf), ["stratum"])


# ---------------------------------------------------------------- ranks (j)
_R = "(rank() over (partition by {k} order by {v}) + (count(*) over (partition by {k}, {v}) - 1) / 2.0)"


@query("j01_midrank_percentile", f"""
select unit_id, model, round(({_R.format(k='model, stratum', v='score')} - 0.5)
 / count(*) over (partition by model, stratum), 9) percentile from predictions""", ("predictions",))
def j01(spark, sf):
    out = rs.midrank_percentile(views.predictions(spark, sf), ["model", "stratum"], "score")
    return rounded(out.select("unit_id", "model", "percentile"), 9, "percentile")


@query("j02_average_rank_pct", f"""
select unit_id, feature, round({_R.format(k='unit_id', v='value')}
 / count(*) over (partition by unit_id), 9) rank_pct from expr""", ("expr",))
def j02(spark, sf):
    out = rs.average_rank_percentile(views.expr(spark, sf), ["unit_id"], "value")
    return rounded(out.select("unit_id", "feature", "rank_pct"), 9, "rank_pct")


@query("j03_ecdf", """
select unit_id, model, round(cume_dist() over (partition by model order by score), 9) ecdf from predictions""",
       ("predictions",))
def j03(spark, sf):
    out = rs.ecdf(views.predictions(spark, sf), ["model"], "score")
    return rounded(out.select("unit_id", "model", "ecdf"), 9, "ecdf")


def wide_scores(spark, sf) -> DataFrame:
    """One row per unit with the four scores as columns (known models: no pivot job)."""
    return views.predictions(spark, sf).groupBy("unit_id", "group_id", "stratum", "fold", "outcome").agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(m) for m in views.MODELS]
    )


_WIDE = "wide as (select unit_id, group_id, stratum, fold, outcome, " + ", ".join(
    f"max(case when model='{m}' then score end) {m}" for m in views.MODELS
) + " from predictions group by all)"


@query("j04_spearman", f"""
with {_WIDE}, r as (select stratum, {_R.format(k='stratum', v='base')} ra, {_R.format(k='stratum', v='disc')} rb from wide)
select stratum, count(*) n, round(corr(ra, rb), 6) spearman from r group by 1""", ("predictions",))
def j04(spark, sf):
    return rounded(rs.spearman(wide_scores(spark, sf), ["stratum"], "base", "disc"), 6, "spearman")


@query("j05_fold_weighted_spearman", f"""
with {_WIDE}, r as (select stratum, fold, {_R.format(k='stratum, fold', v='base')} ra,
 {_R.format(k='stratum, fold', v='price')} rb from wide),
f as (select stratum, fold, count(*) n, corr(ra, rb) s from r group by 1,2)
select stratum, cast(sum(n) as bigint) n, round(sum(s*n)/sum(n), 6) weighted_spearman from f group by 1""",
       ("predictions",))
def j05(spark, sf):
    by_fold = rs.spearman(wide_scores(spark, sf), ["stratum", "fold"], "base", "price")
    out = rs.fold_weighted(by_fold, ["stratum"], "spearman", "weighted_spearman")
    return rounded(out, 6, "weighted_spearman")


def wide_percentiles(spark, sf, keys=("stratum",)) -> DataFrame:
    pct = rs.midrank_percentile(views.predictions(spark, sf), ["model", *keys], "score")
    wide = pct.groupBy("unit_id", "group_id", "stratum", "fold", "outcome").agg(
        *[F.max(F.when(F.col("model") == m, F.col("percentile"))).alias(f"percentile_{m}") for m in views.MODELS[:3]]
    )
    return rs.rank_dispersion(wide, [f"percentile_{m}" for m in views.MODELS[:3]])


_PCT = f"""pct as (select unit_id, group_id, stratum, fold, outcome, model, ({_R.format(k='model, stratum', v='score')} - 0.5)
 / count(*) over (partition by model, stratum) p from predictions),
disp as (select unit_id, group_id, stratum, fold, outcome,
 max(case when model in ('base','price','disc') then p end)
 - min(case when model in ('base','price','disc') then p end) d from pct group by all)"""


@query("j06_rank_dispersion", f"""
with {_PCT} select stratum, count(*) n_units, round(quantile_cont(d, 0.25), 9) q1,
 round(quantile_cont(d, 0.5), 9) median, round(quantile_cont(d, 0.75), 9) q3 from disp group by 1""", ("predictions",))
def j06(spark, sf):
    out = rs.dispersion_summary(wide_percentiles(spark, sf), ["stratum"])
    return rounded(out, 9, "q1", "median", "q3")


@query("j07_direct_rank_check", """
with v as (select model, stratum, fold, score, count(*) c from predictions group by 1,2,3,4),
d as (select a.model, a.stratum, a.fold, a.score, (sum(case when a.score>b.score then b.c else 0 end)
 + 0.5*sum(case when a.score=b.score then b.c else 0 end)) / sum(b.c) p, any_value(a.c) c
 from v a join v b on a.model=b.model and a.stratum=b.stratum and a.fold=b.fold group by 1,2,3,4)
select model, stratum, fold, cast(sum(c) as bigint) n, round(sum(p*p*c), 6) sum_squares, 0.0::double max_difference
 from d group by 1,2,3""", ("predictions",))
def j07(spark, sf):
    """Ranks must not change under a positive affine map per fold."""
    pred = views.predictions(spark, sf).select("unit_id", "model", "stratum", "fold", "score")
    moved = pred.withColumn("moved", F.col("score") * (F.col("fold") + 1.7) + (F.col("fold") - 2) * 100)
    keys = ["model", "stratum", "fold"]
    plain = rs.midrank_percentile(moved, keys, "score", "p")
    both = rs.midrank_percentile(plain, keys, "moved", "q")
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("p") * F.col("p")), 6).alias("sum_squares"),
        F.max(F.abs(F.col("p") - F.col("q"))).alias("max_difference"),
    )


@query("j08_kruskal_wallis", f"""
with r as (select model, stratum, score, {_R.format(k='model', v='score')} r from predictions),
g as (select model, stratum, count(*) n, sum(r) s from r group by 1,2),
t as (select model, sum(c*c*c-c) ties from (select model, score, count(*)::double c from predictions group by 1,2) group by 1),
k as (select model, sum(n)::double n, count(*) k, sum(s*s/n) q from g group by 1),
h as (select model, n, k, (12.0/(n*(n+1))*q - 3*(n+1)) / (1 - ties/(n*n*n-n)) h from k join t using (model))
select model, cast(n as bigint) n, k as groups, round(h, 6) h_statistic,
 round(exp(-h/2)*(1+h/2), 6) p_value, round(greatest(0, (h-k+1)/(n-k)), 6) epsilon_squared from h""", ("predictions",))
def j08(spark, sf):
    out = rs.kruskal_wallis(views.predictions(spark, sf), ["model"], "stratum", "score")
    return rounded(out, 6, "h_statistic", "p_value", "epsilon_squared")


@query("j09_bh_adjust", """
with p as (select event_type, sample_id, case when count(*) > 1 then round(avg(support_score), 6) end p
 from (select event_type, value, support_score, user_id as sample_id from events
  join responses using (event_type, value) where events.event_id=responses.sample_id) group by 1,2),
r as (select *, row_number() over (partition by event_type order by p, sample_id) k,
 count(*) over (partition by event_type) m from p where p is not null),
a as (select event_type, sample_id, least(1.0, min(p*m/k) over (partition by event_type order by k desc)) q from r)
select p.event_type, p.sample_id, p.p, round(q, 9) p_adjusted from p left join a using (event_type, sample_id)""",
       ("responses",))
def j09(spark, sf):
    events = views.table(spark, sf, "events")
    p = events.groupBy("event_type", F.col("user_id").alias("sample_id")).agg(
        F.when(
            F.count(F.lit(1)) > 1,
            F.round(F.avg(F.get_json_object("props", "$.k").cast("double") / 100), 6),
        ).alias("p")
    )
    return rounded(rs.bh_adjust(p, ["event_type"], "p"), 9, "p_adjusted")


@query("j10_risk_distribution", """
select model, stratum, count(*) n, round(avg(score), 6) mean, round(stddev_samp(score), 6) sd, min(score) "min", max(score) "max",
 round(quantile_cont(score, 0.25), 6) q1, round(quantile_cont(score, 0.5), 6) median, round(quantile_cont(score, 0.75), 6) q3,
 round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 6) iqr from predictions group by 1,2""", ("predictions",))
def j10(spark, sf):
    out = rs.distribution(views.predictions(spark, sf), ["model", "stratum"], "score")
    return rounded(out, 6, "mean", "sd", "q1", "median", "q3", "iqr")


@query("j11_zscore_cohort", """
with s as (select stratum, avg(duration) m, stddev_samp(duration) s from units group by 1)
select unit_id, round((duration-m)/case when s=0 then 1 else s end, 6) z_duration from units join s using (stratum)""",
       ("units",))
def j11(spark, sf):
    out = rs.zscore(views.units(spark, sf), ["stratum"], ["duration"])
    return rounded(out.select("unit_id", "z_duration"), 6, "z_duration")
