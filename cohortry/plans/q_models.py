"""Registered queries: fold-local preprocessing (e), models (f), proportional hazards (h19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import settle
from ..functions.scalars import hash32
from ..operators import cox as cx, metrics_class as mc, models as md, prep as pp, rankstats as rs
from . import views
from .q_class_rank import called, rounded, wide_scores
from .registry import query

FOLDS = (1, 2, 3, 4, 5)
_H = "('0x'||substr(md5({}),1,8))::bigint"
_CUST = f"""cu as (select cast(c_custkey as varchar) unit_id, cast({_H.format("'42:'||c_custkey")}%5+1 as int) fold, cast({_H.format("'y:'||c_custkey")}%2 as int) outcome,
 case when c_custkey%7<>0 then c_mktsegment end seg, case when c_custkey%11<>0 then abs(c_acctbal) end tmb from customer),
ks as (select unnest([1,2,3,4,5])::int k)"""


def customers(spark, sf) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return views.table(spark, sf, "customer").select(
        key.alias("unit_id"),
        (hash32(F.concat(F.lit("42:"), key)) % 5 + 1).cast("int").alias("fold"),
        (hash32(F.concat(F.lit("y:"), key)) % 2).cast("int").alias("outcome"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("seg"),
        F.when(F.col("c_custkey") % 11 != 0, F.abs("c_acctbal")).alias("tmb"),
    )


_MOM = _CUST + """,
fe as (select distinct feature from expr), dn as (select cu.unit_id, cu.fold, fe.feature, coalesce(value,0.0) v from cu cross join fe left join expr e on e.unit_id=cu.unit_id and e.feature=fe.feature),
mo as (select k, feature, avg(v) mean, var_pop(v) variance, count(*) n_train from dn join ks on fold<>k group by 1,2)"""


def moments(spark, sf) -> DataFrame:
    return pp.train_moments(views.expr(spark, sf), customers(spark, sf), FOLDS)


@query("e01_standardize", f"""with {_MOM} select e.unit_id, cu.fold, e.feature, round((e.value-mean)/case when variance=0 then 1 else sqrt(variance) end,6) z
 from expr e join cu using (unit_id) join mo on k=cu.fold and mo.feature=e.feature""", ("expr",))
def e01(spark, sf):
    expr, units = views.expr(spark, sf), customers(spark, sf)
    return rounded(pp.standardize(expr, units, pp.train_moments(expr, units, FOLDS)), 6, "z")


@query("e02_top_variance", f"""with {_MOM} select k, feature, round(variance,6) variance from (select *, row_number() over (partition by k order by round(variance,9) desc, feature) r from mo) where r<=10""", ("expr",))
def e02(spark, sf):
    return pp.top_variance(moments(spark, sf), 10).select("k", "feature", F.round("variance", 6).alias("variance"))


def vectors(spark, sf) -> DataFrame:
    key = F.col("vec_id").cast("string")
    return views.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("unit_id"), key.alias("group_id"),
        (hash32(F.concat(F.lit("42:"), key)) % 5 + 1).cast("int").alias("fold"),
        (F.col("label") < 5).cast("int").alias("outcome"), F.col("embedding").cast("array<double>").alias("features"),
    )


@query("e03_pca")
def e03(spark, sf):
    vec = vectors(spark, sf)
    scores = pp.pca_scores(vec, pp.pca(vec, FOLDS))
    return scores.select("unit_id", "fold", F.posexplode("pcs").alias("component", "score"))


_LEV = _CUST + ", lv as (select k, seg as lev, count(*) n from cu join ks on fold<>k where seg is not null group by 1,2)"


@query("e04_impute_mode", f"with {_LEV} select k, arg_min(lev, (-n, lev)) fill from lv group by 1")
def e04(spark, sf):
    return pp.impute_mode(customers(spark, sf), "seg", FOLDS)


@query("e05_impute_median", f"with {_CUST} select k, round(median(tmb),6) fill from cu join ks on fold<>k group by 1")
def e05(spark, sf):
    return rounded(pp.impute_median(customers(spark, sf), "tmb", FOLDS), 6, "fill")


@query("e06_onehot_drop_first", f"""with {_LEV}, r as (select *, row_number() over (partition by k order by lev) r from lv)
select unit_id, cu.fold, 'seg_'||seg feature, 1.0::double as value from cu join r on k=cu.fold and lev=seg where r>1""")
def e06(spark, sf):
    return pp.onehot(customers(spark, sf), "seg", FOLDS)


_RARE = "case when c_custkey%211=0 then 'rare'||c_custkey else c_mktsegment end"


@query("e07_unseen_levels", f"""with {_CUST}, c as (select cast({_H.format("'42:'||c_custkey")}%5+1 as int) fold, {_RARE} lev from customer)
select distinct fold k, lev as "level" from c a where not exists (select 1 from c b where b.fold<>a.fold and b.lev=a.lev)""")
def e07(spark, sf):
    key = F.col("unit_id").cast("bigint")
    base = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), "c_mktsegment")
    units = customers(spark, sf).join(base, "unit_id").withColumn(
        "lev", F.when(key % 211 == 0, F.concat(F.lit("rare"), "unit_id")).otherwise(F.col("c_mktsegment"))
    )
    return pp.unseen_levels(units, "lev", FOLDS)


@query("e08_log1p", f"""with {_CUST}, md as (select k, median(tmb) m from cu join ks on fold<>k group by 1),
x as (select k, fold, unit_id, m, ln(1+coalesce(tmb,m)) x from cu join md on true), s as (select k, avg(x) a, stddev_pop(x) s from x where fold<>k group by 1)
select unit_id, fold, round(m,6) median, round((x-a)/s,6) as value from x join s using (k) where k=fold""")
def e08(spark, sf):
    return rounded(pp.log_scaled(customers(spark, sf), "tmb", FOLDS), 6, "median", "value")


@query("e09_drop_constant", f"""with {_CUST}, t as (select cu.unit_id, cu.fold, gene feature, case when gene<'C' and cu.fold<>3 then 0.0 else value end v from genes join cu using (unit_id)),
g as (select distinct feature from t), d as (select cu.fold, g.feature, coalesce(v,0.0) v from cu cross join g left join t on t.unit_id=cu.unit_id and t.feature=g.feature)
select k, feature from d join ks on fold<>k group by 1,2 having max(v)-min(v)>1e-12""", ("genes",))
def e09(spark, sf):
    units = customers(spark, sf)
    long = views.genes(spark, sf).join(units.select("unit_id", "fold"), "unit_id")
    # genes that vary in fold 3 alone: constant wherever that fold is the test fold
    value = F.when((F.col("gene") < "C") & (F.col("fold") != 3), 0.0).otherwise(F.col("value"))
    return pp.varying_features(long.select("unit_id", F.col("gene").alias("feature"), value.alias("value")), units, FOLDS)


@query("e10_sparse_vectorize", f"""with {_CUST}, m as (select cu.unit_id, cu.fold, case when unit_id::bigint%50=0 then feature||unit_id else feature end feature, value from expr join cu using (unit_id)),
w as (select * from m union all select unit_id, fold, feature||'.__present', 1.0 from m)
select unit_id, fold, feature, value from w a where exists (select 1 from w b where b.feature=a.feature and b.fold<>a.fold)""", ("expr",))
def e10(spark, sf):
    name = F.when(F.col("unit_id").cast("bigint") % 50 == 0, F.concat("feature", "unit_id")).otherwise(F.col("feature"))
    cells = views.expr(spark, sf).join(customers(spark, sf).select("unit_id", "fold"), "unit_id").withColumn("feature", name)
    entries = F.collect_list(F.struct("feature", "value"))
    maps = cells.groupBy("unit_id", "fold").agg(F.map_from_entries(entries).alias("m"))
    present = F.transform_values(F.transform_keys("m", lambda k, v: F.concat(k, F.lit(".__present"))), lambda k, v: F.lit(1.0))
    return pp.vectorize_maps(maps.withColumn("features", F.map_concat("m", present)), FOLDS)


@query("e11_assemble", f"""with {_MOM}, lv as (select k, seg as lev, count(*) n from cu join ks on fold<>k where seg is not null group by 1,2),
r as (select *, row_number() over (partition by k order by lev) r from lv)
select e.unit_id, cu.fold, 'numeric:'||e.feature feature, round((e.value-mean)/case when variance=0 then 1 else sqrt(variance) end,6) as value from expr e join cu using (unit_id) join mo on k=cu.fold and mo.feature=e.feature
union all select unit_id, cu.fold, 'clinical:seg_'||seg, 1.0 from cu join r on k=cu.fold and lev=seg where r>1""", ("expr",))
def e11(spark, sf):
    expr, units = views.expr(spark, sf), customers(spark, sf)
    numeric = pp.standardize(expr, units, pp.train_moments(expr, units, FOLDS)).withColumnRenamed("z", "value")
    return rounded(pp.assemble({"numeric": numeric, "clinical": pp.onehot(units, "seg", FOLDS)}), 6, "value")


@query("e12_tie_canonicalize", """
select unit_id, model, round(avg(score) over (partition by fold, model, stratum, subgroup, event),6) score_tied from predictions""", ("predictions",))
def e12(spark, sf):
    out = pp.tie_canonical(views.predictions(spark, sf), ["fold", "model"], ["stratum", "subgroup", "event"], "score")
    return rounded(out.select("unit_id", "model", "score_tied"), 6, "score_tied")


@query("e13_duration_target", "select unit_id, round(ln(1+duration),9) target, round(exp(ln(1+duration))-1,6) back from units", ("units",))
def e13(spark, sf):
    target = views.units(spark, sf).withColumn("t", pp.duration_target(F.col("duration")))
    return target.select("unit_id", F.round("t", 9).alias("target"), F.round(pp.duration_back(F.col("t")), 6).alias("back"))


@query("e14_combined_features", f"""with {_CUST}, p as (select unit_id, count(*) n, round(sum(value),6) total from expr group by 1)
select unit_id, fold, 'expr' block, n n_cells, total from p join cu using (unit_id) union all
select unit_id, fold, 'seg', 1, 1.0 from cu where seg is not null""", ("expr",))
def e14(spark, sf):
    units = customers(spark, sf)
    numeric = views.expr(spark, sf).join(units.select("unit_id", "fold"), "unit_id")
    clinical = units.where("seg IS NOT NULL").select("unit_id", "fold", F.concat(F.lit("is_"), "seg").alias("feature"), F.lit(1.0).alias("value"))
    both = pp.assemble({"expr": numeric, "seg": clinical}).withColumn("block", F.split("feature", ":")[0])
    return both.groupBy("unit_id", "fold", "block").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("value"), 6).alias("total"))


@query("e15_round_metadata_scores", """
select unit_id, case when model='disc' then 'metadata_only|'||model else model end model, case when model='disc' then round(score/7,12) else score/7 end score from predictions""", ("predictions",))
def e15(spark, sf):
    name = F.when(F.col("model") == "disc", F.concat(F.lit("metadata_only|"), "model")).otherwise(F.col("model"))
    pred = views.predictions(spark, sf).select("unit_id", name.alias("model"), (F.col("score") / 7).alias("score"))
    return pp.round_metadata_scores(pred)


# ---------------------------------------------------------------- models (f)
def _fit(spark, sf, name: str, rounds: int = 100) -> DataFrame:
    return md.oof_scores(settle(vectors(spark, sf)), md.factories(rounds)[name], FOLDS, name)


@query("f01_logistic")
def f01(spark, sf):
    return _fit(spark, sf, "LR")


@query("f02_linear_svm_margin")
def f02(spark, sf):
    return _fit(spark, sf, "SVM")


@query("f03_random_forest")
def f03(spark, sf):
    return _fit(spark, sf, "RF")


@query("f04_mlp")
def f04(spark, sf):
    return _fit(spark, sf, "MLP")


@query("f05_boosted_trees")
def f05(spark, sf):
    return _fit(spark, sf, "GBT", rounds=10)


@query("f06_oof_scores")
def f06(spark, sf):
    oof = settle(_fit(spark, sf, "LR"))
    auc = mc.ranking(oof, ["model", "fold"]).select("model", "fold", "auroc")
    return oof.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("score_min"), F.max("score").alias("score_max")
    ).join(auc, ["model", "fold"])


def _pool(spark, sf) -> DataFrame:
    vec = settle(vectors(spark, sf))
    half = vec.withColumn("features", F.slice("features", 1, 32))
    models = {k: v for k, v in md.factories().items() if k in ("LR", "SVM")}
    return settle(md.candidate_pool({"full": vec, "half": half}, models, FOLDS))


@query("f07_candidate_pool")
def f07(spark, sf):
    pool = _pool(spark, sf)
    conf = mc.confusion(pool, ["model"]).select("model", "accuracy", "macro_f1")
    return mc.ranking(pool, ["model"]).select("model", "auroc", "auprc").join(conf, "model")


_INNER = """ia as (select o.k outer_fold, model, sum(case when outcome=1 then r end) s, sum(outcome)::double n1, sum(1-outcome)::double n0 from
 (select k.k, model, outcome, rank() over (partition by k.k, model order by score) + (count(*) over (partition by k.k, model, score)-1)/2.0 r from predictions join (select unnest([1,2,3,4,5]) k) k on fold<>k.k) o group by 1,2),
ib as (select outer_fold, model, round((s-n1*(n1+1)/2)/(n1*n0),9) a from ia), best as (select outer_fold, arg_min(model, (-a, model)) m from ib group by 1)"""


@query("f08_nested_select", f"with {_INNER} select unit_id, fold, 'nested_selected' model, m selected_candidate, score from predictions join best on outer_fold=fold and m=model", ("predictions",))
def f08(spark, sf):
    """Inner AUROC of every candidate on the rows outside each outer fold."""
    pred = settle(views.predictions(spark, sf))
    outside = pred.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in FOLDS]))).where("outer_fold <> fold")
    inner = rounded(mc.ranking(outside, ["outer_fold", "model"]).select("outer_fold", "model", "auroc"), 9, "auroc")
    return md.nested_select(inner, pred).select("unit_id", "fold", "model", "selected_candidate", "score")


COVARIATES = ["base", "disc", "fixed__lines"]


def survival_rows(spark, sf) -> DataFrame:
    outcome = views.units(spark, sf).select("unit_id", "duration", "event")
    return settle(wide_scores(spark, sf).join(outcome, "unit_id"))


def _cox(spark, sf, stratum=None):
    data = survival_rows(spark, sf)
    rows = cx.training_rows(data, FOLDS)
    return data, rows, cx.fit(rows, COVARIATES, stratum=stratum)


@query("f09_cox_ph")
def f09(spark, sf):
    return _cox(spark, sf)[2].frame(spark)


@query("f10_cox_stratified")
def f10(spark, sf):
    return _cox(spark, sf, "stratum")[2].frame(spark)


@query("f11_cox_oof_risk")
def f11(spark, sf):
    data, _, fitted = _cox(spark, sf)
    tied = pp.tie_canonical(cx.oof_risk(data, fitted), ["fold"], COVARIATES, "risk")
    return tied.select("unit_id", "fold", "duration", "event", F.col("risk_tied").alias("risk"))


@query("f12_survival_curve")
def f12(spark, sf):
    data, rows, fitted = _cox(spark, sf)
    hazard = cx.baseline_hazard(rows, fitted)
    return cx.survival_at(data, fitted, hazard, [600.0, 1200.0, 1800.0]).select(
        "unit_id", "fold", "survival_600", "survival_1200", "survival_1800"
    )


@query("f13_duration_regression")
def f13(spark, sf):
    data = survival_rows(spark, sf).withColumn("features", F.array(*COVARIATES))
    return md.duration_regression(data, FOLDS)


@query("f14_constant_fallback", f"with {_CUST} select unit_id, fold, round(p,9) score from cu join (select k, avg(outcome) p from cu join ks on fold<>k group by 1) on k=fold")
def f14(spark, sf):
    units = customers(spark, sf)
    out = units.join(pp.train_prevalence(units, FOLDS), "fold")
    return out.select("unit_id", "fold", F.round("prevalence", 9).alias("score"))


@query("f15_metadata_model")
def f15(spark, sf):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    units = customers(spark, sf).withColumn("group_id", F.col("unit_id")).withColumn(
        "features", F.array(*[F.coalesce((F.col("seg") == s).cast("double"), F.lit(0.0)) for s in levels])
    )
    factory = (md.factories()["LR"][0], False)
    oof = md.oof_scores(settle(units), factory, FOLDS, "metadata_only|segment|LR")
    return pp.round_metadata_scores(oof).select("unit_id", "fold", "model", "score", "call")


@query("f16_fixed_score_control", "select unit_id, 'Biology-score '||model as model, round(score-100,6) score, cast(score-100>=0 as int) \"call\" from predictions", ("predictions",))
def f16(spark, sf):
    net = views.predictions(spark, sf).withColumn("net", F.col("score") - 100)
    return md.fixed_score(net, "net", F.concat(F.lit("Biology-score "), "model")).select("unit_id", "model", F.round("score", 6).alias("score"), "call")


@query("f17_fit_audit", f"""
with r as (select model, fold, outcome, rank() over (partition by model, fold order by score)+(count(*) over (partition by model, fold, score)-1)/2.0 r from predictions),
a as (select model, fold, (sum(case when outcome=1 then r end)-sum(outcome)*(sum(outcome)+1)/2.0)/(sum(outcome)::double*sum(1-outcome)) auc from r group by 1,2),
p as (select model, fold, count(*) n_test, sum(outcome) pos_test, sum({_H.format('unit_id')}) test_ids from predictions group by 1,2)
select model, fold, cast(sum(n_test) over (partition by model)-n_test as bigint) n_train, n_test, cast(sum(pos_test) over (partition by model)-pos_test as bigint) pos_train, cast(pos_test as bigint) pos_test,
 round(auc,6) test_auc, cast(test_ids as bigint) test_ids from p join a using (model, fold)""", ("predictions",))
def f17(spark, sf):
    pred = settle(views.predictions(spark, sf))
    return rounded(md.fit_audit(pred, mc.ranking(pred, ["model", "fold"])), 6, "test_auc")


@query("f18_ph_full_fit")
def f18(spark, sf):
    rows = survival_rows(spark, sf).withColumn("k", F.lit(0))
    return cx.fit(rows, COVARIATES).frame(spark)


@query("f19_cox_pca_risk")
def f19(spark, sf):
    """Survival baseline: scaled scores, principal axes and ridge Cox, all of the other folds."""
    rows = survival_rows(spark, sf).withColumn("features", F.array(*COVARIATES))
    return cx.pca_oof_risk(rows, FOLDS, penalizer=0.1)


@query("h19_ph_test")
def h19(spark, sf):
    rows = survival_rows(spark, sf).withColumn("k", F.lit(0))
    tested = cx.ph_test(rows, cx.fit(rows, COVARIATES), unit="unit_id")
    return rs.bh_adjust(tested, ["k"], "p_value", "q_value")
