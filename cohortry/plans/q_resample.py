"""Registered queries: resampling and uncertainty (i), correlation table (j12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import settle, stored
from ..operators import metrics_class as mc, rankstats as rs, replicates as rp, resample as rb
from ..operators.metrics_surv import grouped_concordance
from . import views
from .q_class_rank import _PCT, _WIDE, called, rounded, wide_percentiles, wide_scores
from .registry import query


#: Replicates of the audits and of the analyses.
AUDIT, PUBLISHED = 1000, 2000


def draw_sql(strata: str, unit: str, source: str, reps: int, seed: int = 42) -> str:
    """CTE bw(strata, unit, rep, w): the same hash draws in SQL."""
    cols = [c.strip() for c in strata.split(",") if c.strip()]
    lead = "".join(f"{c}, " for c in cols)
    part = f"partition by {', '.join(cols)}" if cols else ""
    name = "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in cols) + ")" if cols else "''"
    on = " and ".join([f"dr.{c}=nb.{c}" for c in cols] + ["dr.pick=nb.slot"])
    return f"""nb0 as (select distinct {lead}{unit} from {source}),
nb as (select {lead}{unit}, row_number() over ({part} order by md5('{seed}:'||{unit}), {unit})-1 slot, count(*) over ({part}) n from nb0),
dr as (select {lead}rep, ('0x'||substr(md5('{seed}:'||rep||':'||{name}||':'||slot),1,15))::bigint % n pick, count(*) w
 from nb cross join (select unnest(range({reps})) rep) group by all),
bw as (select {''.join(f'nb.{c}, ' for c in cols)}nb.{unit}, rep, w from dr join nb on {on})"""


def auc_w(keys: str, source: str, name: str) -> str:
    """CTE name(keys, u, pairs, auroc, ap) of a weighted AUROC / AP; source has outcome, score, w."""
    return f"""{name}_c as (select {keys}, score, sum(w*outcome)::double p, sum(w*(1-outcome))::double q from {source} group by all),
{name}_r as (select *, sum(p) over (partition by {keys} order by score desc) cp, sum(q) over (partition by {keys} order by score desc) cq from {name}_c),
{name} as (select {keys}, sum(q*(cp-p/2)) u, sum(p)*sum(q) pairs, sum(q*(cp-p/2))/nullif(sum(p)*sum(q),0) auroc,
 case when sum(q)>0 then sum(p*cp/(cp+cq))/nullif(sum(p),0) end ap from {name}_r group by {keys})"""


def ci_sql(keys: str, source: str, requested: int, needed: int = 0, value: str = "value", extra: str = "") -> str:
    return f"""select {keys}, round(avg({value}),6) mean, round(stddev_samp({value}),6) sd,
 case when count({value})>={needed} then round(quantile_cont({value},0.025),6) end ci_low,
 case when count({value})>={needed} then round(quantile_cont({value},0.975),6) end ci_high, {requested}::bigint requested, count({value}) valid{extra}
 from {source} where {value} is not null group by {keys}"""


def ci_round(df: DataFrame) -> DataFrame:
    return rounded(df, 6, "mean", "sd", "ci_low", "ci_high")


@query("i01_boot_cluster", "with " + draw_sql("", "group_id", "predictions", AUDIT) + f""",
j as (select model, stratum, outcome, score, rep, w from predictions p join bw using (group_id)),
""" + auc_w("model, stratum, rep", "j", "a") + ci_sql("model, stratum", "a", AUDIT, 800, "auroc"), ("predictions",))
def i01(spark, sf):
    pred = views.stored_predictions(spark, sf)
    blocks = rp.draws(pred, [], "group_id", AUDIT)
    draws = rp.one_value(pred, blocks, ["group_id"], rp.RANKING, ["model", "stratum"], AUDIT, "auroc")
    return ci_round(rb.intervals(draws, ["model", "stratum"], AUDIT, share=0.8, at_least=100))


_DISP = f"{_PCT}, dd as (select *, d as rank_dispersion from disp)"


@query("i02_boot_cluster_strict", f"with {_PCT}," + draw_sql("", "group_id", "disp", PUBLISHED) + """,
j as (select stratum, rep, d, unnest(range(w)) from disp join bw using (group_id)),
m as (select stratum, rep, quantile_cont(d, 0.5) as value from j group by 1,2)
""" + ci_sql("stratum", "m", PUBLISHED, 1800), ("predictions",))
def i02(spark, sf):
    wide = stored(wide_percentiles(spark, sf), "wide")
    blocks = rp.draws(wide, [], "group_id", PUBLISHED)
    draws = rp.one_value(wide, blocks, ["group_id"], rp.median_metric("rank_dispersion"), ["stratum"], PUBLISHED)
    return ci_round(rb.intervals(draws, ["stratum"], PUBLISHED, share=0.9, at_least=20))


# Weighted pair counts of a thousand replicates are too slow in SQL; tests hold these queries against counts by pairs.


def patient_paired(pred: DataFrame, reps: int) -> DataFrame:
    """Concordance of every model and its difference from ``base`` over shared draws of patients."""
    blocks = rp.draws(pred, [], "unit_id", reps)
    draws = settle(rp.scoped_concordance(pred, blocks, ["unit_id"], ["model"], ["fold", "stratum"], reps, tied_censoring=True))
    deltas = rb.paired_difference(draws, [], "model", "base")
    absolute = rb.intervals(draws, ["model"], reps).withColumn("kind", F.lit("absolute"))
    return absolute.unionByName(rb.intervals(deltas, ["model"], reps).withColumn("kind", F.lit("paired")))


@query("i03_boot_patient_paired")
def i03(spark, sf):
    return ci_round(patient_paired(views.stored_predictions(spark, sf), AUDIT))


_GROUPS = "pu as (select model, group_id, min(outcome) outcome, avg(score) score, min(fold) fold from predictions group by 1,2)"


def patients(spark, sf) -> DataFrame:
    return mc.by_unit(views.predictions(spark, sf), ["model"])


@query("i04_boot_fold_label", f"with {_GROUPS}," + draw_sql("fold, outcome", "group_id", "pu", PUBLISHED) + """,
j as (select pu.*, rep, w from pu join bw using (group_id)),
""" + auc_w("model, fold, rep", "j", "a") + """,
v as (select model, rep, sum(u)/nullif(sum(pairs),0) as value from a group by 1,2)
""".replace(",\nv as", ", v as") + ci_sql("model", "v", PUBLISHED), ("predictions",))
def i04(spark, sf):
    units = stored(patients(spark, sf), "patients")
    blocks = rp.draws(units, ["fold", "outcome"], "group_id", PUBLISHED)
    return ci_round(rb.intervals(rp.fold_auroc(units, blocks, ["group_id"], ["model"], PUBLISHED), ["model"], PUBLISHED))


def stratum_draws(pred: DataFrame, reps: int) -> DataFrame:
    """(model, stratum, rep, value): units drawn inside stratum and fold."""
    blocks = rp.draws(pred, ["stratum", "fold"], "unit_id", reps)
    return settle(rp.scoped_concordance(pred, blocks, ["unit_id"], ["model", "stratum"], ["fold"], reps, tied_censoring=True))


def frozen_deltas(pred: DataFrame, draws: DataFrame, reps: int, *, units: int = 40, events: int = 20, pairs: int = 100) -> DataFrame:
    """Differences of the mean over strata that were eligible on the original data, with their original weights."""
    base = pred.where("model = 'base'")
    support = base.groupBy("stratum").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum("event").alias("e"))
    point = grouped_concordance(base, ["stratum"], ["fold"], tied_censoring=True)
    frozen = settle(support.join(point, "stratum").where(f"weight >= {units} AND e >= {events} AND pairs >= {pairs}"))
    means = rb.frozen_mean(draws, frozen, ["model", "rep"], "stratum")
    deltas = rb.paired_difference(rb.complete_replicates(settle(means), "model"), [], "model", "base")
    return rb.intervals(deltas, ["model"], reps, share=0.95)


@query("i05_boot_stratum_fold")
def i05(spark, sf):
    pred = views.stored_predictions(spark, sf)
    return ci_round(frozen_deltas(pred, stratum_draws(pred, PUBLISHED), PUBLISHED))


@query("i06_boot_fold_in_stratum")
def i06(spark, sf):
    draws = stratum_draws(views.stored_predictions(spark, sf), PUBLISHED)
    return ci_round(rb.intervals(rb.paired_difference(draws, ["stratum"], "model", "base"), ["stratum", "model"], PUBLISHED))


def scheme_deltas(schemes: DataFrame, units: DataFrame, reps: int) -> DataFrame:
    """Per model: leave-one-out less k-fold concordance over shared draws inside each stratum."""
    blocks = rp.draws(units, ["stratum"], "unit_id", reps)
    draws = settle(rp.scoped_concordance(
        schemes, blocks, ["unit_id"], ["scheme", "model"], ["stratum", "subgroup"], reps, tied_censoring=True))
    return rb.intervals(rb.paired_difference(draws, ["model"], "scheme", "kfold"), ["model"], reps)


@query("i07_boot_within_stratum")
def i07(spark, sf):
    pred = views.stored_predictions(spark, sf)
    schemes = pred.withColumn("scheme", F.lit("kfold")).unionByName(
        pred.withColumn("scheme", F.lit("leave_one_out")).withColumn("score", F.round(F.col("score") / 10))
    )
    return ci_round(scheme_deltas(schemes, views.units(spark, sf), PUBLISHED))


@query("i08_boot_rows_reference", "with " + draw_sql("", "unit_id", "predictions", AUDIT) + """,
j as (select p.*, rep, w from predictions p join bw using (unit_id)),
""" + auc_w("model, rep", "j", "a") + """,
d as (select a.model, a.rep, a.auroc-b.auroc as value from a join a b on a.rep=b.rep and b.model='fixed__lines' where a.model<>'fixed__lines')
""" + ci_sql("model", "d", AUDIT, 800), ("predictions",))
def i08(spark, sf):
    pred = views.stored_predictions(spark, sf)
    blocks = rp.draws(pred, [], "unit_id", AUDIT)
    draws = settle(rp.one_value(pred, blocks, ["unit_id"], rp.RANKING, ["model"], AUDIT, "auroc"))
    deltas = rb.paired_difference(draws, [], "model", "fixed__lines")
    return ci_round(rb.intervals(deltas, ["model"], AUDIT, share=0.8))


def rank_w(keys: str, source: str, value: str, name: str) -> str:
    return f"""{name}_c as (select {keys}, {value}, sum(w) t from {source} group by all),
{name} as (select {keys}, {value}, sum(t) over (partition by {keys} order by {value}) - t + (t+1)/2.0 {name}_rank from {name}_c)"""


_CORR = """(sum(w*ra*rb)-sum(w*ra)*sum(w*rb)/sum(w))/sqrt((sum(w*ra*ra)-sum(w*ra)*sum(w*ra)/sum(w))*(sum(w*rb*rb)-sum(w*rb)*sum(w*rb)/sum(w)))"""


@query("i09_boot_within_fold_rank", f"with {_WIDE}," + draw_sql("fold", "unit_id", "wide", PUBLISHED) + """,
j as (select wide.*, rep, w from wide join bw using (unit_id)),
""" + rank_w("fold, rep", "j", "base", "a") + "," + rank_w("fold, rep", "j", "disc", "b") + f""",
f as (select j.fold, j.rep, sum(w) n, {_CORR.replace('ra', 'a_rank').replace('rb', 'b_rank')} s from j join a using (fold, rep, base) join b using (fold, rep, disc) group by 1,2),
v as (select 'base~disc' pair, rep, sum(s*n)/sum(n) as value from f group by rep)
""" + ci_sql("pair", "v", PUBLISHED, 1900), ("predictions",))
def i09(spark, sf):
    wide = stored(wide_scores(spark, sf), "wide")
    blocks = rp.draws(wide, ["fold"], "unit_id", PUBLISHED)
    by_fold = rp.replicate(wide, blocks, ["unit_id"], rp.spearman_metric("base", "disc"), ["fold"], PUBLISHED)
    draws = rs.fold_weighted(by_fold, ["rep"], "value", "spearman")
    draws = draws.select(F.lit("base~disc").alias("pair"), "rep", F.col("spearman").alias("value"))
    return ci_round(rb.intervals(draws, ["pair"], PUBLISHED, share=0.95))


@query("i10_percentile_ci", ci_sql("event_type, sample_id", "repeats", 20, 16, "risk_score"), ("repeats",))
def i10(spark, sf):
    draws = views.repeats(spark, sf)
    return ci_round(rb.intervals(draws, ["event_type", "sample_id"], 20, share=0.8, value="risk_score"))


@query("i11_metric_seed", """
with i as (select distinct 'correlation|'||model||'|'||stratum id from predictions), h as (select id, sha256(id) s from i)
select id, (42 + ('0x'||substr(s,7,2)||substr(s,5,2)||substr(s,3,2)||substr(s,1,2))::bigint) % 4294967295 seed from h""", ("predictions",))
def i11(spark, sf):
    ids = views.predictions(spark, sf).select("model", "stratum").distinct()
    named = ids.select(F.concat_ws("|", F.lit("correlation"), "model", "stratum").alias("id"))
    return named.withColumn("seed", rb.metric_seed(42, F.col("id")))


_I12 = f"with {_GROUPS}," + draw_sql("", "group_id", "pu", AUDIT) + """,
j as (select pu.*, rep, w from pu join bw using (group_id)),
""" + auc_w("model, rep", "j", "a") + "," + auc_w("model", "(select *, 1 w from pu)", "pt") + """,
v as (select model, rep, 'AUROC' metric, auroc as value from a union all select model, rep, 'AUPRC', ap from a),
q as (select model, 'AUROC' metric, auroc estimate from pt union all select model, 'AUPRC', ap from pt),
ng as (select count(distinct group_id) g from pu)"""


@query("i12_class_metric_ci", _I12 + """
select c.*, round(q.estimate,6) estimate, g n_groups from (""" + ci_sql("model, metric", "v", AUDIT) + ") c join q using (model, metric), ng", ("predictions",))
def i12(spark, sf):
    units = stored(patients(spark, sf), "patients")
    blocks = rp.draws(units, [], "group_id", AUDIT)
    drawn = rp.replicate(units, blocks, ["group_id"], rp.RANKING, ["model"], AUDIT)
    named = drawn.select("model", "rep", F.col("auroc").alias("AUROC"), F.col("auprc").alias("AUPRC"))
    draws = named.unpivot(["model", "rep"], ["AUROC", "AUPRC"], "metric", "value")
    point = rb.class_metrics(units.withColumn("w", F.lit(1)), ["model"], "w").withColumnRenamed("value", "estimate")
    groups = units.agg(F.count_distinct("group_id").alias("n")).scalar()
    out = rb.intervals(draws, ["model", "metric"], AUDIT).join(point, ["model", "metric"])
    return rounded(ci_round(out.withColumn("n_groups", groups)), 6, "estimate")


@query("i13_class_paired_ci", _I12 + """,
d as (select a.model, a.rep, a.auroc-b.auroc as value from a join a b on a.rep=b.rep and b.model='fixed__lines' where a.model<>'fixed__lines')
""" + ci_sql("model", "d", AUDIT), ("predictions",))
def i13(spark, sf):
    units = stored(patients(spark, sf), "patients")
    blocks = rp.draws(units, [], "group_id", AUDIT)
    draws = settle(rp.one_value(units, blocks, ["group_id"], rp.RANKING, ["model"], AUDIT, "auroc"))
    return ci_round(rb.intervals(rb.paired_difference(draws, [], "model", "fixed__lines"), ["model"], AUDIT))


def survival_paired(pred: DataFrame, reps: int, reference: str = "fixed__lines") -> DataFrame:
    """Fold-restricted concordance less the reference model's, over shared draws of groups."""
    blocks = rp.draws(pred, [], "group_id", reps)
    draws = settle(rp.scoped_concordance(pred, blocks, ["group_id"], ["model"], ["fold", "stratum"], reps, tied_censoring=False))
    return rb.intervals(rb.paired_difference(draws, [], "model", reference), ["model"], reps)


@query("i14_surv_paired_ci")
def i14(spark, sf):
    return ci_round(survival_paired(views.stored_predictions(spark, sf), AUDIT))


_PAIRS = (("base", "price"), ("base", "disc"), ("price", "disc"))


def _j12_sql() -> str:
    text = f"with {_WIDE}," + draw_sql("", "group_id", "wide", PUBLISHED) + """,
j as (select wide.*, rep, w from wide join bw using (group_id)), k as (select wide.*, 1 w from wide)"""
    parts = []
    for i, (a, b) in enumerate(_PAIRS):
        corr = _CORR.replace("ra", f"a{i}_rank").replace("rb", f"b{i}_rank")
        point = _CORR.replace("ra", f"c{i}_rank").replace("rb", f"d{i}_rank")
        text += "," + rank_w("stratum, rep", "j", a, f"a{i}") + "," + rank_w("stratum, rep", "j", b, f"b{i}")
        text += "," + rank_w("stratum", "k", a, f"c{i}") + "," + rank_w("stratum", "k", b, f"d{i}")
        text += f""", v{i} as (select stratum, rep, {corr} as value from j join a{i} using (stratum, rep, {a}) join b{i} using (stratum, rep, {b}) group by 1,2),
 p{i} as (select stratum, count(*) n_units, count(distinct group_id) n_patients, {point} e from k join c{i} using (stratum, {a}) join d{i} using (stratum, {b}) group by 1)"""
        parts.append(f"""select '{a}' strategy_a, '{b}' strategy_b, c.*, n_units, n_patients, round(e,6) estimate
 from ({ci_sql('stratum', f'v{i}', PUBLISHED, 1800)}) c join p{i} using (stratum)""")
    return text + " " + " union all ".join(parts)


@query("j12_correlation_table", _j12_sql(), ("predictions",))
def j12(spark, sf):
    wide = stored(wide_scores(spark, sf), "wide")
    blocks = rp.draws(wide, [], "group_id", PUBLISHED)
    sizes = wide.groupBy("stratum").agg(F.count_distinct("group_id").alias("n_patients"))
    out = None
    for a, b in _PAIRS:
        draws = rp.one_value(wide, blocks, ["group_id"], rp.spearman_metric(a, b), ["stratum"], PUBLISHED)
        ci = rb.intervals(draws, ["stratum"], PUBLISHED, share=0.9, at_least=20)
        point = rb.spearman_metric(a, b)(wide.withColumn("w", F.lit(1)), ["stratum"], "w").select(
            "stratum", F.col("n").alias("n_units"), F.col("value").alias("estimate")
        )
        part = ci.join(point, "stratum").join(sizes, "stratum").withColumns(
            {"strategy_a": F.lit(a), "strategy_b": F.lit(b)}
        )
        out = part if out is None else out.unionByName(part)
    return rounded(ci_round(out), 6, "estimate")
