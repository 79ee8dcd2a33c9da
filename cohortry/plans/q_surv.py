"""Registered queries: survival metrics (h)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import MIN_EVENTS, MIN_FOLDS, MIN_N, MIN_PAIRS
from ..functions.lineage import settle
from ..operators import metrics_surv as ms
from ..operators.pairs import concordance
from . import views
from .q_class_rank import rounded
from .registry import query


def pair_sql(keys: str, scope: str = "", tied: bool = False, source: str = "predictions",
             risk: str = "score", name: str = "pr") -> str:
    """CTE with the pair components per keys; brute-force pairs of distinct points."""
    cols = [c.strip() for c in (keys + ("," + scope if scope else "")).split(",") if c.strip()]
    group = ", ".join(cols)
    on = " and ".join(f"a.{c}=b.{c}" for c in cols) or "true"
    later = "(a.duration<b.duration or (a.duration=b.duration and b.event=0))" if tied else "a.duration<b.duration"
    selected = ", ".join(f"a.{c.strip()}" for c in keys.split(",") if c.strip())
    prefix = selected + ", " if selected else ""
    return f"""{name}_pts as (select {group + ',' if group else ''} duration, event, {risk} s, count(*) w from {source} group by all),
{name} as (select {prefix} sum(a.w*b.w)::double pairs,
 coalesce(sum(case when a.s>b.s then a.w*b.w end), 0)::double concordant,
 coalesce(sum(case when a.s=b.s then a.w*b.w end), 0)::double tied
 from {name}_pts a join {name}_pts b on {on} and a.event=1 and {later} group by {selected or 'true'})"""


C = "round((concordant+0.5*tied)/nullif(pairs,0), 6)"


def is_fixed():
    return F.col("model").startswith("fixed__")



def predictions(spark, sf) -> DataFrame:
    return views.predictions(spark, sf)


def _components(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "pairs", "concordant", "tied", F.round("c_index", 6).alias("c_index"))


@query("h01_cindex_strict", "with " + pair_sql("model, stratum") +
       f" select model, stratum, pairs, concordant, tied, {C} c_index from pr", ("predictions",))
def h01(spark, sf):
    return _components(concordance(predictions(spark, sf), ["model", "stratum"]), "model", "stratum")


@query("h02_cindex_tied_censor", "with " + pair_sql("model, stratum", tied=True) +
       f" select model, stratum, pairs, concordant, tied, {C} c_index from pr", ("predictions",))
def h02(spark, sf):
    out = concordance(predictions(spark, sf), ["model", "stratum"], tied_censoring=True)
    return _components(out, "model", "stratum")


@query("h03_cindex_grouped", "with " + pair_sql("model", "subgroup", tied=True) +
       f" select model, pairs, concordant, tied, {C} c_index from pr", ("predictions",))
def h03(spark, sf):
    out = ms.grouped_concordance(predictions(spark, sf), ["model"], ["subgroup"], tied_censoring=True)
    return _components(out, "model")


@query("h04_cindex_fold", "with " + pair_sql("model", "fold") +
       f" select model, pairs, concordant, tied, {C} c_index from pr", ("predictions",))
def h04(spark, sf):
    return _components(ms.grouped_concordance(predictions(spark, sf), ["model"], ["fold"]), "model")


@query("h05_cindex_within_stratum", "with " + pair_sql("model", "fold, stratum", tied=True) +
       f" select model, pairs, concordant, tied, {C} c_index from pr", ("predictions",))
def h05(spark, sf):
    out = ms.grouped_concordance(predictions(spark, sf), ["model"], ["fold", "stratum"], tied_censoring=True)
    return _components(out, "model")


_H06 = "with " + pair_sql("model, stratum, subgroup", tied=True, name="po") + "," + pair_sql(
    "model, stratum, subgroup, fold", tied=True, name="fo") + """,
s as (select model, stratum, subgroup, count(*) n, cast(sum(event) as bigint) events from predictions group by 1,2,3),
f as (select model, stratum, subgroup, sum(pairs) fp, (sum(concordant)+0.5*sum(tied))/nullif(sum(pairs),0) fc,
 cast(sum(case when pairs>0 then 1 else 0 end) as bigint) nf from fo group by 1,2,3),
j as (select s.*, coalesce(po.pairs,0) pp, (po.concordant+0.5*po.tied)/nullif(po.pairs,0) pc, coalesce(fp,0) fp, fc,
 coalesce(nf,0) nf, s.model like 'fixed!_!_%' escape '!' fx
 from s left join po using (model,stratum,subgroup) left join f using (model,stratum,subgroup)),
k as (select *, case when fx then pc else fc end c, case when fx then pp else fp end p from j),
g as (select *, n>=400 and events>=190 and p>=9000 and (fx or nf>=4) and c is not null ok from k)"""


def _per_stratum(spark, sf) -> DataFrame:
    pred = predictions(spark, sf).withColumn("cell", F.concat_ws("|", "stratum", "subgroup"))
    return ms.reportable_by_stratum(
        pred, stratum="cell", min_n=400, min_events=190, min_pairs=9000, min_folds=MIN_FOLDS, fixed=is_fixed()
    )


@query("h06_stratum_reportable", _H06 + """
select model, stratum||'|'||subgroup cell, n, events, n-events censored, round(pc,6) pooled_c, cast(pp as bigint) pooled_pairs,
 round(fc,6) crossfit_c, cast(fp as bigint) crossfit_pairs, nf folds_with_pairs, cast(p as bigint) pairs, ok reportable,
 case when ok then round(c,6) end c_index,
 case when not ok then 'support below threshold: n='||n||', events='||events||', pairs='||cast(p as bigint)||', folds_with_pairs='||nf end reason
 from g""", ("predictions",))
def h06(spark, sf):
    return rounded(_per_stratum(spark, sf), 6, "pooled_c", "crossfit_c", "c_index")


@query("h07_weighted_c", _H06 + """
select model, round(sum(c*n)/sum(n),6) sample_weighted_c, round(sum(c*p)/sum(p),6) pair_weighted_c, count(*) eligible_strata,
 cast(sum(n) as bigint) eligible_n, cast(sum(events) as bigint) eligible_events, cast(sum(p) as bigint) eligible_pairs
 from g where ok group by 1""", ("predictions",))
def h07(spark, sf):
    out = ms.weighted_over_strata(_per_stratum(spark, sf), ["model"])
    return rounded(out, 6, "sample_weighted_c", "pair_weighted_c")


@query("h08_orientation", "with " + pair_sql("model, stratum") + f"""
select model, stratum, {C} c_as_given, round((pairs-concordant-0.5*tied)/nullif(pairs,0), 6) c_negated from pr""", ("predictions",))
def h08(spark, sf):
    pred = predictions(spark, sf).withColumn("negated", -F.col("score"))
    keys = ["model", "stratum"]
    given = concordance(pred, keys).select(*keys, F.round("c_index", 6).alias("c_as_given"))
    turned = concordance(pred, keys, risk="negated").select(*keys, F.round("c_index", 6).alias("c_negated"))
    return given.join(turned, keys)


@query("h09_outcome_pairs", """
with t as (select stratum, duration, sum(event) e, count(*) n from units group by 1,2)
select stratum, cast(sum(e*later + e*(n-e)) as bigint) outcome_pairs from
 (select *, coalesce(sum(n) over (partition by stratum order by duration desc rows between unbounded preceding and 1 preceding),0) later from t)
 group by 1""", ("units",))
def h09(spark, sf):
    return ms.outcome_pairs(views.units(spark, sf), ["stratum"])


def km_sql(source: str, keys: str, observed: str, name: str = "km") -> str:
    return f"""{name}_t as (select {keys}, duration as time, count(*) n, sum({observed}) d from {source} group by all),
{name}_r as (select *, sum(n) over (partition by {keys} order by time desc) at_risk from {name}_t),
{name} as (select {keys}, time, at_risk, d,
 case when sum(case when d=at_risk then 1 else 0 end) over w > 0 then 0 else
 exp(sum(case when d<at_risk then ln(1-d*1.0/at_risk) else 0 end) over w) end survival
 from {name}_r window w as (partition by {keys} order by time))"""


@query("h10_km_curve", "with " + km_sql("units", "stratum", "event") + """
select stratum, time, cast(at_risk as bigint) at_risk, cast(d as bigint) d, round(survival, 9) survival from km""", ("units",))
def h10(spark, sf):
    return rounded(ms.km_curve(views.units(spark, sf), ["stratum"]).drop("before"), 9, "survival")


@query("h11_reverse_km", "with " + km_sql("units", "subgroup", "1-event") + """
select subgroup, min(case when survival<=0.5+1e-12 then time end) reverse_km_median from km group by 1""", ("units",))
def h11(spark, sf):
    flipped = views.units(spark, sf).withColumn("censored", 1 - F.col("event"))
    return ms.curve_median(ms.km_curve(flipped, ["subgroup"], observed="censored"), ["subgroup"], "reverse_km_median")


@query("h12_cohort_by_stratum", "with " + km_sql("units", "stratum", "event", "ka") + "," + km_sql(
    "units", "stratum", "1-event", "kb") + """
select stratum, count(*) n, cast(sum(event) as bigint) events, cast(sum(1-event) as bigint) censored,
 round(avg(event),6) event_rate, min(duration) duration_min, max(duration) duration_max, median(duration) median_time,
 any_value((select min(time) from ka where ka.stratum=u.stratum and survival<=0.5+1e-12)) km_median,
 any_value((select min(time) from kb where kb.stratum=u.stratum and survival<=0.5+1e-12)) reverse_km_median
 from units u group by 1""", ("units",))
def h12(spark, sf):
    return rounded(ms.cohort_by_stratum(views.units(spark, sf), ["stratum"]), 6, "event_rate")


_TRAIN = """tr as (select k.k fold, u.duration as time, cast(sum(case when u.fold<>k.k then 1 else 0 end) as bigint) n,
 cast(sum(case when u.fold<>k.k then 1-u.event else 0 end) as bigint) d from units u cross join (select unnest([1,2,3,4,5]) k) k group by 1,2),
trr as (select *, sum(n) over (partition by fold order by time desc) at_risk from tr),
g as (select fold, time, cast(at_risk as bigint) at_risk, d,
 case when sum(case when d>=at_risk and at_risk>0 then 1 else 0 end) over w > 0 then 0 else
 exp(sum(case when d>0 and d<at_risk then ln(1-d*1.0/at_risk) else 0 end) over w) end survival
 from trr window w as (partition by fold order by time)),
gl as (select *, coalesce(lag(survival) over (partition by fold order by time), 1.0) as before from g)"""
HORIZONS = (600.0, 1200.0, 1800.0)
FOLDS = (1, 2, 3, 4, 5)


@query("h13_censoring_km", "with " + _TRAIN + """
select fold, time, at_risk, d, round(survival,9) survival, round(before,9) as "before" from gl""", ("units",))
def h13(spark, sf):
    return rounded(ms.censoring_km(views.units(spark, sf), folds=FOLDS), 9, "survival", "before")


_WEIGHTED = "with " + _TRAIN + """,
hz as (select unnest([600.0,1200.0,1800.0])::double horizon),
gh as (select fold, horizon, greatest(coalesce(arg_max(survival, case when time<=horizon then time end),1.0),1e-8) g from g cross join hz group by 1,2),
wt as (select u.*, hz.horizon, cast(u.duration<=hz.horizon and event=1 as int) is_case, cast(u.duration>hz.horizon as int) is_control,
 case when u.duration<=hz.horizon and event=1 then 1/greatest(gl.before,1e-8) when u.duration>hz.horizon then 1/gh.g else 0 end ipcw
 from units u cross join hz join gl on gl.fold=u.fold and gl.time=u.duration join gh on gh.fold=u.fold and gh.horizon=hz.horizon)"""


def _weights(spark, sf) -> DataFrame:
    units = views.units(spark, sf)
    return ms.ipcw(units, settle(ms.censoring_km(units, folds=FOLDS)), HORIZONS)


@query("h14_ipcw_weights", _WEIGHTED + """
select unit_id, horizon, is_case, is_control, round(ipcw,9) ipcw from wt""", ("units",))
def h14(spark, sf):
    return rounded(_weights(spark, sf).select("unit_id", "horizon", "is_case", "is_control", "ipcw"), 9, "ipcw")


_SCORED = _WEIGHTED + """,
ws as (select wt.*, p.model, p.score, 1-p.score/(p.score+100) surv from wt join predictions p using (unit_id))"""


def _scored(spark, sf) -> DataFrame:
    scores = views.order_scores(spark, sf)
    surv = 1 - F.col("score") / (F.col("score") + 100)
    return _weights(spark, sf).join(scores, "unit_id").withColumn("surv", surv)


_AUCF = """,
ar as (select model, horizon, fold, score, sum(ipcw*is_case) p, sum(ipcw*is_control) q from ws group by 1,2,3,4),
ac as (select *, sum(q) over (partition by model,horizon,fold order by score) cq from ar),
au as (select model, horizon, fold, sum(p*(cq-q/2)) credit, sum(p)*sum(q) pair_weight from ac group by 1,2,3),
br as (select model, horizon, fold, sum(ipcw*(is_control-surv)*(is_control-surv))/count(*) brier, sum(ipcw) weight_sum,
 cast(sum(is_case) as bigint) n_cases, cast(sum(is_control) as bigint) n_controls,
 cast(sum(1-is_case-is_control) as bigint) n_censored_before from ws group by 1,2,3)"""


@query("h15_dynamic_auc", _SCORED + _AUCF + """
select model, horizon, fold, round(credit/nullif(pair_weight,0),6) auc, round(pair_weight,3) pair_weight from au""",
       ("predictions",))
def h15(spark, sf):
    out = ms.dynamic_auc(_scored(spark, sf), ["model", "horizon", "fold"], risk="score")
    return out.select("model", "horizon", "fold", F.round("auc", 6).alias("auc"), F.round("pair_weight", 3).alias("pair_weight"))


@query("h16_ipcw_brier", _SCORED + _AUCF + """
select model, horizon, fold, round(brier,6) brier, round(weight_sum,6) weight_sum, n_cases, n_controls, n_censored_before from br""",
       ("predictions",))
def h16(spark, sf):
    out = ms.ipcw_brier(_scored(spark, sf), ["model", "horizon", "fold"], survival="surv")
    return rounded(out, 6, "brier", "weight_sum")


@query("h17_time_pooled", _SCORED + _AUCF + """
select model, horizon, round(sum(credit)/sum(pair_weight),6) weighted_auc, round(avg(credit/pair_weight),6) mean_auc,
 round(stddev_samp(credit/pair_weight),6) sd_auc, round(avg(brier),6) mean_brier, round(stddev_samp(brier),6) sd_brier,
 cast(sum(n_cases) as bigint) n_cases, cast(sum(n_controls) as bigint) n_controls, cast(sum(n_censored_before) as bigint) n_censored_before
 from au join br using (model,horizon,fold) group by 1,2""", ("predictions",))
def h17(spark, sf):
    keys = ["model", "horizon", "fold"]
    scored = settle(_scored(spark, sf))
    by_fold = ms.dynamic_auc(scored, keys, risk="score").join(ms.ipcw_brier(scored, keys, survival="surv"), keys)
    out = ms.pooled_time_metrics(by_fold, ["model", "horizon"])
    return rounded(out, 6, "weighted_auc", "mean_auc", "sd_auc", "mean_brier", "sd_brier")


@query("h18_ipcw_calibration")
def h18(spark, sf):
    scored = _scored(spark, sf).withColumn("risk", 1 - F.col("surv"))
    out = ms.ipcw_calibration(scored, ["model", "horizon"], risk="risk")
    return rounded(out, 6, "observed_risk", "mean_predicted", "intercept", "slope")


_SCOPES = "with " + ",".join(
    pair_sql("model", scope, tied=True, name=name)
    for name, scope in (("sa", ""), ("sf", "fold"), ("ss", "stratum"), ("st", "fold, stratum"))
)


@query("h20_pair_scope", _SCOPES + """,
lv as (select 'all' scope, * from sa union all select 'fold', * from sf union all select 'stratum', * from ss
 union all select 'fold+stratum', * from st),
m as (select distinct model, e estimand from predictions cross join (select unnest(['global','within_stratum']) e)),
sc as (select *, case when estimand='global' and model='disc' then 'not_applicable' when estimand='global' and model like 'fixed%' then 'all'
 when estimand='global' then 'fold' when model like 'fixed%' then 'stratum' else 'fold+stratum' end scope,
 case when estimand='global' then 'fold' else 'fold+stratum' end paired_scope from m)
select sc.model, estimand, sc.scope, sc.paired_scope, cast(a.pairs as bigint) pairs, round((a.concordant+0.5*a.tied)/a.pairs,6) c_index,
 cast(b.pairs as bigint) paired_pairs, round((b.concordant+0.5*b.tied)/b.pairs,6) paired_c
 from sc left join lv a on a.model=sc.model and a.scope=sc.scope left join lv b on b.model=sc.model and b.scope=sc.paired_scope""",
       ("predictions",))
def h20(spark, sf):
    pred = settle(predictions(spark, sf).select("model", "fold", "stratum", "duration", "event", "score"))
    models = pred.select("model").distinct()
    scopes = ms.pair_scopes(models, fixed=is_fixed(), stratified=F.col("model") == "disc")
    out = ms.scoped_concordance(pred, scopes)
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("pairs", "paired_pairs")})
    return rounded(out, 6, "c_index", "paired_c")


_FOLDM = "with " + pair_sql("model, fold", tied=True, name="wh") + "," + pair_sql(
    "model, fold", "stratum", tied=True, name="wi") + """,
fm as (select p.model, p.fold, n, events, (wh.concordant+0.5*wh.tied)/wh.pairs global_c, wh.pairs gp,
 (wi.concordant+0.5*wi.tied)/wi.pairs within_c, wi.pairs wp from
 (select model, fold, count(*) n, cast(sum(event) as bigint) events from predictions group by 1,2) p
 join wh using (model,fold) join wi using (model,fold))"""


@query("h21_fold_metrics", _FOLDM + """
select model, fold, n, events, round(global_c,6) global_c, cast(gp as bigint) global_pairs, round(within_c,6) within_c,
 cast(wp as bigint) within_pairs from fm""", ("predictions",))
def h21(spark, sf):
    return rounded(ms.fold_metrics(predictions(spark, sf)), 6, "global_c", "within_c")


@query("h22_global_summary", _FOLDM + "," + _SCOPES[5:] + """
select f.model, cast(sum(n) as bigint) n, cast(sum(events) as bigint) events, count(*) n_folds, round(avg(global_c),6) fold_mean_c,
 round(stddev_samp(global_c),6) fold_sd_c,
 any_value(round((sa.concordant+0.5*sa.tied)/sa.pairs,6)) pooled_c, any_value(round((sf.concordant+0.5*sf.tied)/sf.pairs,6)) crossfit_c,
 any_value(round((ss.concordant+0.5*ss.tied)/ss.pairs,6)) within_c, any_value(round((st.concordant+0.5*st.tied)/st.pairs,6)) within_crossfit_c,
 any_value(case when f.model like 'fixed%' then round((sa.concordant+0.5*sa.tied)/sa.pairs,6) else round((sf.concordant+0.5*sf.tied)/sf.pairs,6) end) primary_c
 from fm f join sa using (model) join sf using (model) join ss using (model) join st using (model) group by 1""", ("predictions",))
def h22(spark, sf):
    pred = settle(predictions(spark, sf).select("model", "fold", "stratum", "duration", "event", "score"))
    folds = ms.fold_metrics(pred).groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("events").alias("events"), F.count(F.lit(1)).alias("n_folds"),
        F.avg("global_c").alias("fold_mean_c"), F.stddev_samp("global_c").alias("fold_sd_c"),
    )
    scopes = {"pooled_c": [], "crossfit_c": ["fold"], "within_c": ["stratum"], "within_crossfit_c": ["fold", "stratum"]}
    out = folds
    for name, scope in scopes.items():
        part = ms.grouped_concordance(pred, ["model"], scope, tied_censoring=True)
        out = out.join(part.select("model", F.col("c_index").alias(name)), "model")
    primary = F.when(is_fixed(), F.col("pooled_c")).otherwise(F.col("crossfit_c"))
    return rounded(out.withColumn("primary_c", primary), 6, "fold_mean_c", "fold_sd_c", *scopes, "primary_c")


@query("h23_fold_paired_delta", _FOLDM + """,
d as (select f.model, f.fold, b.global_c bs, f.global_c s, f.global_c-b.global_c d from fm f join fm b on b.model='base' and b.fold=f.fold where f.model<>'base')
select 'fold_delta' row_type, model, fold, round(bs,6) baseline_score, round(s,6) model_score, round(d,6) delta,
 null::bigint n_fold_deltas, null::double delta_sd, null::bigint positive_folds from d union all
select 'fold_delta_summary', model, null, round(avg(bs),6), round(avg(s),6), round(avg(d),6), count(*), round(stddev_samp(d),6),
 cast(sum(case when d>0 then 1 else 0 end) as bigint) from d group by model""", ("predictions",))
def h23(spark, sf):
    metrics = settle(ms.fold_metrics(predictions(spark, sf)))
    out = ms.fold_deltas(metrics, baseline="base", value="global_c")
    return rounded(out, 6, "baseline_score", "model_score", "delta", "delta_sd")


_SCHEMES = "(select *, 'kfold' scheme, score s2 from predictions union all select *, 'leave_one_out', round(score/10) from predictions)"


@query("h24_scheme_comparison", "with " + pair_sql("scheme, model, stratum, subgroup", tied=True, source=_SCHEMES, risk="s2") + f""",
g as (select model, stratum, subgroup, count(*) n from predictions group by 1,2,3),
a as (select * from pr where scheme='kfold'), b as (select * from pr where scheme='leave_one_out')
select g.model, g.stratum, g.subgroup, g.n, round((a.concordant+0.5*a.tied)/a.pairs,6) c_kfold, round((b.concordant+0.5*b.tied)/b.pairs,6) c_leave_one_out,
 round((b.concordant+0.5*b.tied)/b.pairs-(a.concordant+0.5*a.tied)/a.pairs,6) difference,
 case when a.pairs>0 and b.pairs>0 then 'ok' else 'not_estimable' end status
 from g left join a using (model,stratum,subgroup) left join b using (model,stratum,subgroup)""", ("predictions",))
def h24(spark, sf):
    pred = predictions(spark, sf)
    keys = ["model", "stratum", "subgroup"]
    schemes = pred.withColumn("scheme", F.lit("kfold")).unionByName(
        pred.withColumn("scheme", F.lit("leave_one_out")).withColumn("score", F.round(F.col("score") / 10))
    )
    parts = concordance(schemes, ["scheme", *keys], tied_censoring=True)
    wide = parts.groupBy(*keys).agg(
        F.max(F.when(F.col("scheme") == "kfold", F.col("c_index"))).alias("c_kfold"),
        F.max(F.when(F.col("scheme") == "leave_one_out", F.col("c_index"))).alias("c_leave_one_out"),
    )
    counts = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(wide, keys, "left").withColumn("difference", F.col("c_leave_one_out") - F.col("c_kfold"))
    status = F.when(F.col("difference").isNotNull(), "ok").otherwise("not_estimable")
    return rounded(out.withColumn("status", status), 6, "c_kfold", "c_leave_one_out", "difference")


_LINES = """(select u.unit_id, u.duration, u.event, u.fold, u.stratum, l_quantity risk from units u join lineitem on cast(l_orderkey as varchar)=unit_id)"""


def unit_lines(spark, sf) -> DataFrame:
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("unit_id"), F.col("l_quantity").alias("risk")
    )
    return views.units(spark, sf).join(lines, "unit_id")


@query("h25_unit_aggregate_surv", f"""
select unit_id, min(duration) duration, min(event) event, round(avg(risk),6) risk, min(fold) fold, count(*) n_rows from {_LINES} group by 1""", ("units",))
def h25(spark, sf):
    return rounded(ms.by_unit_survival(unit_lines(spark, sf), [], "unit_id"), 6, "risk")


_FX = "(select * from predictions where model='fixed__lines')"


@query("h26_pooled_vs_fold", "with " + pair_sql("stratum", source=_FX, name="a") + "," + pair_sql("stratum", "fold", source=_FX, name="b") + """
select stratum, 'full_cohort' comparison_pairs, pairs, round((concordant+0.5*tied)/pairs,6) c_index from a union all
select stratum, 'fold_restricted_for_paired_comparison', pairs, round((concordant+0.5*tied)/pairs,6) from b""", ("predictions",))
def h26(spark, sf):
    pred = predictions(spark, sf).where(is_fixed())
    whole = concordance(pred, ["stratum"]).withColumn("comparison_pairs", F.lit("full_cohort"))
    folds = ms.grouped_concordance(pred, ["stratum"], ["fold"]).withColumn(
        "comparison_pairs", F.lit("fold_restricted_for_paired_comparison")
    )
    both = whole.unionByName(folds).select("stratum", "comparison_pairs", "pairs", "c_index")
    return rounded(both, 6, "c_index")
