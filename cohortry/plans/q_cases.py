"""Registered queries: disagreement and case selection (k)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import settle
from ..operators import disagreement as dg, resample as rb
from . import views
from .q_class_rank import CALL_SQL, called, rounded
from .q_resample import ci_round, ci_sql, draw_sql
from .registry import query

NAMES = {"base": "conventional", "price": "representation", "fixed__lines": "fixed"}
S = list(NAMES.values())
_SEL = f"""sel as (select *, case model when 'base' then 'conventional' when 'price' then 'representation' else 'fixed' end strategy, {CALL_SQL} "call" from predictions where model<>'disc')"""
_UNITS = _SEL + """,
au0 as (select stratum, group_id, strategy, min(outcome) outcome, min(fold) fold, avg(score) score, cast(avg("call")>=0.5 as int) "call", count(distinct unit_id) n_samples,
 array_to_string(list_sort(list(distinct unit_id)),';') sample_ids from sel group by 1,2,3),
au as (select *, (rank() over (partition by stratum, strategy order by score) + (count(*) over (partition by stratum, strategy, score)-1)/2.0 - 0.5)/count(*) over (partition by stratum, strategy) percentile from au0)"""
_WIDE = _UNITS + ", wu0 as (select stratum, group_id, min(outcome) outcome, min(fold) fold, min(n_samples) n_samples, min(sample_ids) sample_ids, " + ", ".join(
    f"max(case when strategy='{s}' then {c} end) {c.strip(chr(34))}_{s}" for c in ("score", "percentile", '"call"') for s in S
) + " from au group by 1,2), wu as (select *, greatest(percentile_conventional,percentile_representation,percentile_fixed)-least(percentile_conventional,percentile_representation,percentile_fixed) rank_dispersion from wu0)"
_PAT = _WIDE + """,
pt0 as (select *, (call_conventional=outcome)::int+(call_representation=outcome)::int+(call_fixed=outcome)::int n_correct from wu),
pt as (select *, call_conventional=call_representation and call_conventional=call_fixed unanimous_call, n_correct=3 all_correct, n_correct=0 all_wrong, n_correct=1 exactly_one_correct,
 n_correct=2 exactly_two_correct, call_conventional||''||call_representation||call_fixed call_pattern,
 case when call_conventional=outcome then 'C' else 'W' end||case when call_representation=outcome then 'C' else 'W' end||case when call_fixed=outcome then 'C' else 'W' end correctness_pattern,
 call_conventional=outcome and n_correct=1 unique_correct_conventional, call_representation=outcome and n_correct=1 unique_correct_representation, call_fixed=outcome and n_correct=1 unique_correct_fixed from pt0)"""


def selected(spark, sf, strict=True) -> DataFrame:
    return dg.select_predictions(called(spark, sf), NAMES, strict)


def units(spark, sf) -> DataFrame:
    return dg.analysis_units(selected(spark, sf, strict=False), ["stratum"])


def wide(spark, sf) -> DataFrame:
    return dg.wide_units(units(spark, sf), ["stratum"], S)


def patterns(spark, sf) -> DataFrame:
    return dg.decision_patterns(wide(spark, sf), S)


@query("k01_select_predictions", f'with {_SEL} select unit_id, strategy, outcome, fold, score, "call" from sel', ("predictions",))
def k01(spark, sf):
    return selected(spark, sf).select("unit_id", "strategy", "outcome", "fold", "score", "call")


@query("k02_analysis_units", f"""with {_UNITS} select stratum, group_id, strategy, outcome, fold, round(score,6) score, "call", n_samples, sample_ids, round(percentile,9) percentile from au""", ("predictions",))
def k02(spark, sf):
    return rounded(rounded(units(spark, sf), 6, "score"), 9, "percentile")


_SCORES = [f"score_{s}" for s in S]
_PCTS = [f"percentile_{s}" for s in S] + ["rank_dispersion"]


@query("k03_wide_units", f"""with {_WIDE} select stratum, group_id, outcome, fold, n_samples, sample_ids, {', '.join(f'round({c},6) {c}' for c in _SCORES)},
 {', '.join(f'round({c},9) {c}' for c in _PCTS)}, {', '.join(f'call_{s}' for s in S)} from wu""", ("predictions",))
def k03(spark, sf):
    return rounded(rounded(wide(spark, sf), 6, *_SCORES), 9, *_PCTS)


_P = ["unanimous_call", "n_correct", "all_correct", "all_wrong", "exactly_one_correct", "exactly_two_correct", "call_pattern", "correctness_pattern"] + [f"unique_correct_{s}" for s in S]


@query("k04_decision_patterns", f"with {_PAT} select stratum, group_id, {', '.join(_P)} from pt", ("predictions",))
def k04(spark, sf):
    return patterns(spark, sf).select("stratum", "group_id", *_P)


_METRICS = ["unanimous_call", "all_correct", "all_wrong", "exactly_one_correct", "exactly_two_correct"] + [f"unique_correct_{s}" for s in S]


@query("k05_agreement_rates", f"with {_PAT}," + draw_sql("", "group_id", "pt", 40) + f""",
ln as (select stratum, group_id, m metric, case m {' '.join(f"when '{m}' then {m}" for m in _METRICS)} end::int x from pt cross join (select unnest([{','.join("'" + m + "'" for m in _METRICS)}]) m)),
v as (select stratum, metric, rep, sum(x*w)*1.0/sum(w) as value from ln join bw using (group_id) group by 1,2,3),
q as (select stratum, metric, count(*) n_units, cast(sum(x) as bigint) "count", round(avg(x),6) rate from ln group by 1,2)
select c.*, n_units, "count", rate from (""" + ci_sql("stratum, metric", "v", 40, 36) + ") c join q using (stratum, metric)", ("predictions",))
def k05(spark, sf):
    table = patterns(spark, sf)
    flags = table.select("stratum", "group_id", *[F.col(m).cast("int").alias(m) for m in _METRICS])
    long = settle(flags.unpivot(["stratum", "group_id"], _METRICS, "metric", "x"))
    weights = rb.draw_weights(long, [], "group_id", 40)
    draws = rb.replicate(long, weights, ["group_id"], rb.mean_metric("x"), ["stratum", "metric"])
    point = long.groupBy("stratum", "metric").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("x").alias("count"), F.round(F.avg("x"), 6).alias("rate")
    )
    ci = rb.intervals(draws, ["stratum", "metric"], 40, share=0.9, at_least=20)
    return ci_round(ci).join(point, ["stratum", "metric"])


@query("k06_pattern_counts", f"""with {_PAT}, c as (select stratum, correctness_pattern, count(*) "count" from pt group by 1,2)
select stratum, correctness_pattern, "count", round("count"*1.0/sum("count") over (partition by stratum),6) rate from c""", ("predictions",))
def k06(spark, sf):
    return rounded(dg.pattern_counts(patterns(spark, sf), ["stratum"]), 6, "rate")


@query("k07_discordant_groups", """
with n as (select *, case when event=1 then 'Pre_' else 'Post_' end||'P'||group_id||case when fold>2 then '_'||fold else '' end nm from units),
m as (select group_id from units group by 1 having min(event)<>max(event))
select unit_id, 'P'||group_id patient, nm, cast(group_id as bigint) group_number, case when event=1 then 0 else 1 end prefix_order, case when fold>2 then fold else 1 end suffix_order
 from n join m using (group_id)""", ("units",))
def k07(spark, sf):
    name = F.concat(
        F.when(F.col("event") == 1, "Pre_").otherwise("Post_"), F.lit("P"), "group_id",
        F.when(F.col("fold") > 2, F.concat(F.lit("_"), F.col("fold").cast("string"))).otherwise(""),
    )
    named = views.units(spark, sf).withColumns({"nm": name, "patient": F.concat(F.lit("P"), "group_id")})
    out = dg.discordant_groups(named, "patient", "event", "nm")
    return out.select("unit_id", "patient", "nm", "group_number", "prefix_order", "suffix_order")


@query("k08_top_per_group", f"""with {_WIDE} select stratum, outcome, group_id, round(rank_dispersion,9) rank_dispersion from
 (select *, row_number() over (partition by stratum, outcome order by round(rank_dispersion,9) desc, group_id) r from wu) where r=1""", ("predictions",))
def k08(spark, sf):
    table = rounded(wide(spark, sf), 9, "rank_dispersion")
    return dg.top_per_group(table, ["stratum", "outcome"], "rank_dispersion", "group_id")


@query("k09_max_and_lower_median", f"""with {_WIDE}, r as (select stratum, outcome, group_id, round(rank_dispersion,9) rank_dispersion from wu),
n as (select *, row_number() over (partition by stratum, outcome order by rank_dispersion, group_id) a, row_number() over (partition by stratum, outcome order by rank_dispersion desc, group_id) d,
 count(*) over (partition by stratum, outcome) n from r)
select stratum, outcome, group_id, rank_dispersion, 'maximum range' "role" from n where d=1 union all select stratum, outcome, group_id, rank_dispersion, 'median range' from n where a=(n-1)//2+1""", ("predictions",))
def k09(spark, sf):
    table = rounded(wide(spark, sf), 9, "rank_dispersion")
    return dg.max_and_lower_median(table, ["stratum", "outcome"], "rank_dispersion", "group_id")


_REP = """sm as (select sample_id, event_type, avg(risk_score) mean_score, stddev_samp(risk_score) sd_across_partitions, min(risk_score) min_score, max(risk_score) max_score,
 count(distinct repeat_seed) n_partitions, event_type='click' is_baseline from repeats group by 1,2),
pa as (select *, score_max-score_min score_range, n_samples>=2 and n_baseline>=1 eligible from (select sample_id, count(*) n_samples, cast(sum(is_baseline::int) as bigint) n_baseline, min(mean_score) score_min,
 max(mean_score) score_max from sm group by 1))"""


def _repeats(spark, sf):
    return dg.repeat_summary(views.repeats(spark, sf), ["sample_id", "event_type"], "sample_id", F.col("event_type") == "click", 20)


@query("k10_repeat_summary", f"""with {_REP} select s.sample_id, event_type, round(mean_score,6) mean_score, round(sd_across_partitions,6) sd_across_partitions, round(min_score,6) min_score,
 round(max_score,6) max_score, n_partitions, n_partitions=20 complete, n_samples, n_baseline, round(score_range,6) score_range, eligible from sm s join pa using (sample_id)""", ("repeats",))
def k10(spark, sf):
    samples, patients = _repeats(spark, sf)
    out = samples.join(patients, "sample_id").drop("is_baseline", "score_min", "score_max")
    return rounded(out, 6, "mean_score", "sd_across_partitions", "min_score", "max_score", "score_range")


_LABEL = "case event_type when 'click' then 'BL' when 'view' then '6W' when 'error' then '6-8W' when 'purchase' then 'TOX' else '3M' end"
_DAY = "case event_type when 'click' then 0.0 when 'view' then 42.0 when 'error' then 49.0 when 'purchase' then {e} else 91.3125 end::double"



@query("k11_temporal_cases", f"""with {_REP}, el as (select sample_id, sample_id%2 label, round(score_range,9) score_range from pa where eligible),
nn as (select *, row_number() over (partition by label order by score_range, sample_id) a, row_number() over (partition by label order by score_range desc, sample_id) d, count(*) over (partition by label) n from el),
ca as (select label, sample_id, score_range, 'maximum range' "role" from nn where d=1 union all select label, sample_id, score_range, 'median range' from nn where a=(n-1)//2+1)
select ca.label, ca."role", ca.sample_id, ca.score_range, {_LABEL} collection_time, {_DAY.format(e='(ca.sample_id%90)')} collection_day, round(mean_score,6) mean_score from ca join sm using (sample_id)""", ("repeats",))
def k11(spark, sf):
    samples, patients = _repeats(spark, sf)
    eligible = patients.where("eligible").withColumn("label", F.col("sample_id") % 2)
    chosen = dg.max_and_lower_median(rounded(eligible, 9, "score_range"), ["label"], "score_range", "sample_id")
    timeline = samples.join(chosen, "sample_id").withColumn("collection_time", F.expr(_LABEL))
    day = dg.timepoint_day(F.col("collection_time"), (F.col("sample_id") % 90).cast("double"))
    return timeline.select(
        "label", "role", "sample_id", "score_range", "collection_time", day.alias("collection_day"), F.round("mean_score", 6).alias("mean_score")
    )


@query("k12_timepoint_to_day", f"""select event_id, {_LABEL} label, {_DAY.format(e="cast(json_extract(props,'$.k') as double)")} as "day" from events""")
def k12(spark, sf):
    events = views.table(spark, sf, "events").withColumn("label", F.expr(_LABEL))
    day = dg.timepoint_day(F.col("label"), F.get_json_object("props", "$.k").cast("double"))
    return events.select("event_id", "label", day.alias("day"))
