"""Registered queries: data contracts (b), reshapes (c), folds (d)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import work_path
from ..operators import contracts as ct, folds as fo, reshape as rh
from ..operators.pairs import concordance
from ..functions.scalars import hash32
from . import views
from .q_class_rank import called, rounded
from .registry import query

_V = "'{rule}' rule, {key} key, {detail} detail"


@query("b02_unique_key", """
select 'unique_key' rule, group_id||'|'||cast(cast(duration as int) as varchar)||'.0' key, 'rows='||count(*) detail
 from units group by group_id, duration having count(*)>1""", ("units",))
def b02(spark, sf):
    return ct.unique_key(views.units(spark, sf), ["group_id", "duration"])


@query("b03_id_set_equal", """
select 'id_set' rule, unit_id key, 'missing' detail from units where unit_id not in (select cast(l_orderkey as varchar) from lineitem)
union all select distinct 'id_set', cast(l_orderkey as varchar), 'extra' from lineitem where cast(l_orderkey as varchar) not in (select unit_id from units)""",
       ("units",))
def b03(spark, sf):
    observed = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"))
    return ct.id_set_equal(views.units(spark, sf), observed, ["unit_id"])


@query("b04_row_order", """
with n as (select doc_id, cast(floor(doc_id/2)*1 as bigint) declared, row_number() over (order by doc_id) rn from documents)
select 'row_order' rule, cast(doc_id as varchar) key, 'declared='||declared||' canonical='||(rn-1) detail from n where declared<>rn-1""")
def b04(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id")
    numbered = fo.row_number(docs, [], "doc_id")
    declared = numbered.withColumn("declared", F.floor(F.col("doc_id") / 2))
    return ct.row_order(declared, "doc_id", "declared", "rn")


@query("b05_constant_within_group", """
select 'constant_within_group' rule, group_id key, c detail from (
 select group_id, count(distinct outcome) a, count(distinct event) b, count(distinct fold) d, count(distinct subgroup) e from units group by 1)
 cross join (select unnest(['outcome','event','fold','subgroup']) c)
 where case c when 'outcome' then a when 'event' then b when 'fold' then d else e end > 1""", ("units",))
def b05(spark, sf):
    return ct.constant_within_group(views.units(spark, sf), ["group_id"], ["outcome", "event", "fold", "subgroup"])


@query("b06_domain", """
select r rule, unit_id||'|'||model key, 'value outside domain' detail from predictions
 cross join (select unnest(['finite_score','score_below_280','duration_from_30']) r)
 where case r when 'finite_score' then not isfinite(score) when 'score_below_280' then score>=280 else duration<30 end""", ("predictions",))
def b06(spark, sf):
    rules = {
        "finite_score": ~F.isnan("score") & ~F.abs("score").isin(float("inf")),
        "score_below_280": F.col("score") < 280,
        "duration_from_30": F.col("duration") >= 30,
    }
    return ct.domain(views.predictions(spark, sf), ["unit_id", "model"], rules)


@query("b07_value_agreement", """
select 'value_agreement' rule, cast(l_orderkey as varchar)||'|'||l_linenumber||'|'||l_partkey key, 'price' detail
 from (select l_orderkey, l_linenumber, l_partkey, sum(l_extendedprice) x, sum(l_quantity*p_retailprice) y from lineitem join part on l_partkey=p_partkey group by 1,2,3)
 where abs(x-y)>20000""")
def b07(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = views.table(spark, sf, "lineitem")
    part = views.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    canonical = lines.groupBy(*keys).agg(F.sum("l_extendedprice").alias("price"))
    priced = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    source = priced.groupBy(*keys).agg(F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("price"))
    return ct.value_agreement(canonical, source, keys, "price", tolerance=20000)


@query("b08_same_units_across_models", """
with m as (select count(distinct event_type||day(ts)%4) w from events),
h as (select user_id, count(distinct event_type||day(ts)%4) h from events group by 1)
select 'same_units' rule, cast(user_id as varchar) key, 'models='||h||'/'||w detail from h, m where h<w""")
def b08(spark, sf):
    events = views.table(spark, sf, "events").withColumn(
        "model", F.concat("event_type", (F.dayofmonth("ts") % 4).cast("string"))
    )
    return ct.same_units(events, "model", ["user_id"])


@query("b09_expected_counts", """
with e as (select r_name||'-'||seg k, 1000+r_regionkey n from region cross join (select unnest(['BUILDING','MACHINERY']) seg)),
o as (select r_name||'-'||stratum k, count(*) n from units join customer on group_id=cast(c_custkey as varchar)
 join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1)
select 'expected_counts' rule, k key, 'observed='||coalesce(o.n,0)||' expected='||coalesce(e.n,0) detail
 from o full join e using (k) where o.n is distinct from e.n""", ("units",))
def b09(spark, sf):
    nation, region = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    customer = views.table(spark, sf, "customer")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("c_custkey").cast("string").alias("group_id"), "r_name")
    units = views.units(spark, sf).join(named, "group_id").withColumn("k", F.concat_ws("-", "r_name", "stratum"))
    expected = region.select(
        F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("seg"), "r_name", "r_regionkey"
    ).select(F.concat_ws("-", "r_name", "seg").alias("k"), (1000 + F.col("r_regionkey")).alias("n"))
    return ct.expected_counts(units, ["k"], expected)


@query("b10_reproduction_gate", """
select model, count(*) n, round(max(abs(score-round(score/5)*5)),6) max_abs_diff, round(avg(abs(score-round(score/5)*5)),6) mean_abs_diff,
 max(abs(score-round(score/5)*5))<=2.0 passed from predictions group by 1""", ("predictions",))
def b10(spark, sf):
    pred = views.predictions(spark, sf).select("unit_id", "model", "score")
    stored = pred.withColumn("score", F.round(F.col("score") / 5) * 5)
    out = ct.reproduction_gate(pred, stored, ["unit_id", "model"], "score", 2.0)
    return rounded(out, 6, "max_abs_diff", "mean_abs_diff")


@query("b11_group_leakage", """
with u as (select group_id, cast(('0x'||substr(md5('leak:'||unit_id),1,8))::bigint%5+1 as int) f from units)
select 'group_leakage' rule, group_id key, 'folds '||min(f)||'..'||max(f) detail from u group by group_id having min(f)<>max(f)""", ("units",))
def b11(spark, sf):
    by_unit = (hash32(F.concat(F.lit("leak:"), "unit_id")) % 5 + 1).cast("int")
    return ct.group_leakage(views.units(spark, sf).withColumn("fold", by_unit))


@query("b12_forbidden_fields", """
select 'forbidden_fields' rule, cast(event_id as varchar) key, 'fold,outcome' detail from events where event_type='error'
union all select 'forbidden_fields', cast(event_id as varchar), 'label' from events where event_type='view'""")
def b12(spark, sf):
    events = views.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    payload = (
        F.when(F.col("event_type") == "error", F.to_json(F.struct(k.alias("outcome"), k.alias("fold"), k.alias("x"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(k.alias("label"))))
        .otherwise(F.col("props"))
    )
    return ct.forbidden_fields(events.withColumn("payload", payload), "event_id", "payload", ["label", "fold", "outcome"])


@query("b13_train_class_support", """
with u as (select subgroup, stratum, cast(('0x'||substr(md5('s:'||unit_id),1,8))::bigint%400+1 as int) fold, outcome from units),
f as (select subgroup, fold, sum(outcome) p, sum(1-outcome) n from u group by 1,2)
select 'class_support' rule, subgroup||'|'||fold key, s detail from f cross join (select unnest(['test_positive','test_negative']) s)
 where case s when 'test_positive' then p else n end = 0""", ("units",))
def b13(spark, sf):
    fold = (hash32(F.concat(F.lit("s:"), "unit_id")) % 400 + 1).cast("int")
    return ct.class_support(views.units(spark, sf).withColumn("fold", fold), ["subgroup"])


# ---------------------------------------------------------------- reshapes (c)
@query("c01_validated_join", """
select stratum, count(*) n, round(sum(c_acctbal),2) balance from units join customer on group_id=cast(c_custkey as varchar) group by 1""", ("units",))
def c01(spark, sf):
    customer = views.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("group_id"), "c_acctbal")
    joined = rh.validated_join(views.units(spark, sf), customer, ["group_id"], cardinality="many_to_one")
    return joined.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("c02_left_enrich", """
select n_name, r_name, count(*) customers from customer left join nation on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey group by 1,2""")
def c02(spark, sf):
    nation = views.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = views.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = rh.enrich(views.table(spark, sf, "customer"), nation, ["c_nationkey"], "n_name")
    out = rh.enrich(out, region, ["n_regionkey"], "r_name")
    return out.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("c03_semi", """
select unit_id, group_id, stratum from units where group_id in (select unit_id from alter_v)""",
       ("units", "alter_v"))
def c03(spark, sf):
    analysed = views.alter(spark, sf).select(F.col("unit_id").alias("group_id"))
    return rh.restrict(views.units(spark, sf), analysed, ["group_id"]).select("unit_id", "group_id", "stratum")


@query("c04_anti", """
select unit_id, fold from units where unit_id not in (select cast(l_orderkey as varchar) from lineitem)""", ("units",))
def c04(spark, sf):
    covered = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("unit_id"))
    return rh.exclude(views.units(spark, sf), covered, ["unit_id"]).select("unit_id", "fold")


@query("c05_pair_models", """
select a.unit_id, a.fold, a.score "left", b.score "right", round(a.score-b.score,6) delta from predictions a join predictions b
 on a.unit_id=b.unit_id and a.model='base' and b.model='price'""", ("predictions",))
def c05(spark, sf):
    return rounded(rh.pair_models(views.predictions(spark, sf), ["unit_id", "fold"], "base", "price"), 6, "delta")


@query("c06_comparable_pairs", """
with s as (select stratum, fold, sum(outcome)::bigint * sum(1-outcome)::bigint class_pairs from units group by 1,2),
t as (select a.stratum, a.fold, count(*) time_pairs from units a join units b on a.stratum=b.stratum and a.fold=b.fold and a.event=1 and a.duration<b.duration group by 1,2)
select stratum, fold, cast(class_pairs as bigint) class_pairs, time_pairs from s join t using (stratum, fold)""", ("units",))
def c06(spark, sf):
    """Pair counts without building the pairs: products of counts and order sums."""
    units = views.units(spark, sf)
    keys = ["stratum", "fold"]
    classes = units.groupBy(*keys).agg(
        (F.sum("outcome") * F.sum(1 - F.col("outcome"))).alias("class_pairs")
    )
    times = concordance(units, keys, risk="duration").select(*keys, F.col("pairs").cast("bigint").alias("time_pairs"))
    return classes.join(times, keys)


@query("c07_cross_grid", """
select m.model, e estimand, r replicate, n from (select model, count(*) n from predictions group by 1) m
 cross join (select unnest(['global','within_stratum']) e) cross join (select unnest(range(0,10)) r)""", ("predictions",))
def c07(spark, sf):
    models = views.predictions(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    grid = rh.with_grid(models, "estimand", ["global", "within_stratum"])
    replicates = F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))
    return grid.withColumn("replicate", F.explode(replicates))


@query("c08_pivot_models", """
select unit_id, fold, max(case when model='base' then score end) base, max(case when model='price' then score end) price,
 max(case when model='disc' then score end) disc, max(case when model='fixed__lines' then score end) fixed__lines from predictions group by 1,2""",
       ("predictions",))
def c08(spark, sf):
    return rh.pivot_models(views.predictions(spark, sf), ["unit_id", "fold"], views.MODELS)


@query("c09_unpivot", """
select unit_id, 'duration' name, duration as value from units union all select unit_id, 'event', event::double from units
 union all select unit_id, 'fold', fold::double from units""", ("units",))
def c09(spark, sf):
    wide = views.units(spark, sf).select("unit_id", "duration", F.col("event").cast("double").alias("event"), F.col("fold").cast("double").alias("fold"))
    return wide.unpivot("unit_id", ["duration", "event", "fold"], "name", "value")


@query("c10_overlay", """
select unit_id, model, score, null::varchar source from predictions where not (model='disc' and fold=2)
union all select unit_id, model, score+1000, 'refit' from predictions where model='disc' and fold=2""", ("predictions",))
def c10(spark, sf):
    pred = views.predictions(spark, sf).select("unit_id", "model", "fold", "score")
    refit = pred.where("model = 'disc' AND fold = 2").select(
        "unit_id", "model", (F.col("score") + 1000).alias("score"), F.lit("refit").alias("source")
    )
    return rh.overlay(pred.drop("fold"), refit, ["unit_id", "model"])


@query("c11_first_per_key", """
select group_id, unit_id, duration, stratum from (select *, row_number() over (partition by group_id order by duration, unit_id) r from units) where r=1""", ("units",))
def c11(spark, sf):
    units = views.units(spark, sf).select("group_id", "unit_id", "duration", "stratum")
    return rh.first_per_key(units, ["group_id"], ["duration", "unit_id"])


@query("c12_category_collapse", """
select stratum, case when stratum in ('HOUSEHOLD','FURNITURE') then 'HOME (household + furniture)' else stratum end stratum_model, count(*) n from units group by 1,2""", ("units",))
def c12(spark, sf):
    rule = {"HOUSEHOLD": "HOME (household + furniture)", "FURNITURE": "HOME (household + furniture)"}
    out = rh.collapse(views.units(spark, sf), "stratum", rule, "stratum_model")
    return out.groupBy("stratum", "stratum_model").agg(F.count(F.lit(1)).alias("n"))


@query("c13_tagged_union", """
select unit_id, score, 'task1' task, 'Strategy 1' strategy from predictions where model='base' union all
select unit_id, score, 'task1', 'Fixed' from predictions where model='fixed__lines'""", ("predictions",))
def c13(spark, sf):
    pred = views.predictions(spark, sf)
    part = lambda m: pred.where(F.col("model") == m).select("unit_id", "score")
    return rh.tagged_union([
        ({"task": "task1", "strategy": "Strategy 1"}, part("base")),
        ({"task": "task1", "strategy": "Fixed"}, part("fixed__lines")),
    ])


@query("c14_dynamic_filter", """
select unit_id, model, stratum, score from predictions where (model='base' and stratum='BUILDING') or (model='price' and stratum='MACHINERY')""", ("predictions",))
def c14(spark, sf):
    rules = [{"model": "base", "stratum": "BUILDING"}, {"model": "price", "stratum": "MACHINERY"}]
    return rh.rule_filter(views.predictions(spark, sf), rules).select("unit_id", "model", "stratum", "score")


@query("c15_value_counts", """
select stratum, count(*) n, cast(sum(event) as bigint) events, count(distinct group_id) n_groups, cast(sum(case when duration>1000 then 1 else 0 end) as bigint) long_follow_up
 from units group by 1""", ("units",))
def c15(spark, sf):
    return views.units(spark, sf).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.count_distinct("group_id").alias("n_groups"),
        F.sum((F.col("duration") > 1000).cast("bigint")).alias("long_follow_up"),
    )


@query("c16_analysis_filter", """
select unit_id, 'baseline_outcome' analysis, outcome as label from units where stratum<>'HOUSEHOLD' and subgroup='1-URGENT' union all
select unit_id, 'all_event', event from units where stratum<>'HOUSEHOLD' union all
select unit_id, 'all_outcome', outcome from units""", ("units",))
def c16(spark, sf):
    units = views.units(spark, sf).withColumns({
        "is_control": F.col("stratum") == "HOUSEHOLD", "is_baseline": F.col("subgroup") == "1-URGENT",
    })
    specs = [
        {"name": "baseline_outcome", "baseline_only": True, "exclude_control": True, "label": "outcome"},
        {"name": "all_event", "baseline_only": False, "exclude_control": True, "label": "event"},
        {"name": "all_outcome", "baseline_only": False, "exclude_control": False, "label": "outcome"},
    ]
    return rh.analysis_rows(units, specs).select("unit_id", "analysis", "label")


@query("c17_primary_models", """
with l as (select stratum, case when length(stratum)%2=0 then 'price' else 'base' end locked from (select distinct stratum from units))
select unit_id, model, model as "primary", score from predictions where model in ('fixed__lines','disc') union all
select unit_id, model, 'historical_locked:'||locked, score from predictions join l using (stratum) where model=locked""", ("predictions",))
def c17(spark, sf):
    pred = views.predictions(spark, sf)
    locked = pred.select("stratum").distinct().withColumn(
        "locked", F.when(F.length("stratum") % 2 == 0, "price").otherwise("base")
    )
    return rh.primary_models(pred, "fixed__lines", "disc", locked).select("unit_id", "model", "primary", "score")


# ------------------------------------------------------------------ folds (d)
def _rn(keys: str, unit: str, salt: str) -> str:
    part = f"partition by {keys} " if keys else ""
    return f"row_number() over ({part}order by md5('{salt}'||{unit}), {unit})"


@query("d01_kfold", f"select unit_id, cast(({_rn('', 'unit_id', '42:')}-1)%5+1 as int) fold from units", ("units",))
def d01(spark, sf):
    return fo.kfold(views.units(spark, sf).select("unit_id"), "unit_id")


_D02 = f"""g as (select group_id, min(outcome) outcome from units group by 1),
f as (select group_id, cast(({_rn('outcome', 'group_id', '42:')}-1)%5+1 as int) pfold from g)"""


@query("d02_stratified_patient_folds", f"with {_D02} select unit_id, pfold fold from units join f using (group_id)", ("units",))
def d02(spark, sf):
    units = views.units(spark, sf)
    folds = fo.stratified_patient_folds(units)
    return units.select("unit_id", "group_id").join(folds, "group_id").select("unit_id", "fold")


def _ranked_groups(keys: str, salt: str, source: str) -> str:
    lead = f"{keys}, " if keys else ""
    return f"""(select *, row_number() over (partition by {lead}pos>0 order by n desc, ('0x'||substr(md5({salt}||':'||group_id),1,8))::bigint, group_id) rn
 from (select {lead}group_id, count(*) n, sum(o) pos from {source} group by {lead}group_id))"""


_SNAKE = "cast(case when ((rn-1)//{k})%2=1 then {k}-(rn-1)%{k} else (rn-1)%{k}+1 end as int)"


@query("d03_stratified_group_folds", f"""
select stratum, group_id, n, cast(pos as bigint) pos, {_SNAKE.format(k=5)} fold from {_ranked_groups('stratum', "'42'", '(select *, event o from units)')}""", ("units",))
def d03(spark, sf):
    return fo.stratified_group_folds(views.units(spark, sf), ["stratum"], outcome="event")


@query("d04_freeze_folds", f"""
select distinct k fold, count(*) over () total, 0::bigint drift from (select cast(({_rn('', 'unit_id', '42:')}-1)%5+1 as int) k from units)""", ("units",))
def d04(spark, sf):
    """Freeze once to the shared folder, read back, compare exactly."""
    expected = fo.kfold(views.units(spark, sf).select("unit_id"), "unit_id")
    path = work_path(spark, "folds")
    expected.write.mode("errorifexists").parquet(path)
    stored = spark.read.parquet(path)
    drift = fo.fold_drift(stored, expected).agg(F.count(F.lit(1)).alias("n")).scalar()
    total = stored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stored.select("fold").distinct().withColumns({"total": total, "drift": drift})


@query("d05_leave_one_group_out", """
select unit_id, 'leave_one_out' scheme, stratum as "partition" from units union all select unit_id, 'kfold', 'fold_'||fold from units""", ("units",))
def d05(spark, sf):
    return fo.leave_one_group_out(views.units(spark, sf), "unit_id")


@query("d06_inner_folds_fallback", f"""
with t as (select o.k outer_fold, u.group_id, u.outcome o from units u cross join (select unnest([1,2,3,4,5]) k) o where u.fold<>o.k),
r as {_ranked_groups('outer_fold', "cast(42+outer_fold as varchar)", 't').replace("md5(cast(42+outer_fold as varchar)||':'||group_id)", "md5(cast(42+outer_fold as varchar)||':'||group_id)")},
d as (select r.*, k, {_SNAKE.format(k='k')} inner_fold from r cross join (select unnest([2,3,4]) k)),
v as (select outer_fold, max(k) k from (select outer_fold, k, count(*) f, min(p) p, min(q) q from
 (select outer_fold, k, inner_fold, sum(pos) p, sum(n)-sum(pos) q from d group by 1,2,3) group by 1,2) where f=k and p>0 and q>0 group by 1)
select d.outer_fold, d.group_id, d.k n_splits, d.inner_fold from d join v on d.outer_fold=v.outer_fold and d.k=v.k""", ("units",))
def d06(spark, sf):
    return fo.inner_folds(views.units(spark, sf))


@query("d07_repeated_folds", """
select r.sample_id, event_type, repeat_seed, cast(('0x'||substr(md5(repeat_seed||':'||sample_id),1,8))::bigint%5+1 as int) fold, round(risk_score,9) risk_score
 from repeats r""", ("repeats",))
def d07(spark, sf):
    repeats = views.repeats(spark, sf)
    folds = fo.repeated_folds(repeats, "sample_id", range(20))
    return rounded(repeats.join(folds, ["sample_id", "repeat_seed"]), 9, "risk_score")


@query("d08_train_validation_split", f"""
select unit_id, stratum, {_rn('stratum', 'unit_id', '42:')} <= least(count(*) over (partition by stratum)-1,
 greatest(1, round(count(*) over (partition by stratum)*0.1))) is_validation from units""", ("units",))
def d08(spark, sf):
    return fo.train_validation(views.units(spark, sf).select("unit_id", "stratum"), ["stratum"], "unit_id")


_NAMES = """select unit_id, (case when event=1 then 'Pre_' when outcome=1 then 'Post_' else '' end)||'P'||group_id||
 (case fold when 1 then '_T_enriched' when 2 then '_myeloid_enriched' when 3 then '_2' else '' end) nm from units"""


def _names(spark, sf) -> DataFrame:
    prefix = F.when(F.col("event") == 1, "Pre_").when(F.col("outcome") == 1, "Post_").otherwise("")
    suffix = (
        F.when(F.col("fold") == 1, "_T_enriched").when(F.col("fold") == 2, "_myeloid_enriched")
        .when(F.col("fold") == 3, "_2").otherwise("")
    )
    return views.units(spark, sf).withColumn("nm", F.concat(prefix, F.lit("P"), "group_id", suffix))


@query("d09_group_canonicalize", f"""
select unit_id, nm, 'P'||group_id canonical from ({_NAMES}) join units using (unit_id)""", ("units",))
def d09(spark, sf):
    return _names(spark, sf).select("unit_id", "nm", fo.canonical_group(F.col("nm")).alias("canonical"))


@query("d10_timing_class", """
select stratum, case when subgroup='1-URGENT' then 'pretreatment' when subgroup in ('2-HIGH','3-MEDIUM') then 'on_treatment' else 'unverified' end timing_class,
 count(*) n_samples, count(distinct group_id) n_patients from units group by 1,2""", ("units",))
def d10(spark, sf):
    label = (
        F.when(F.col("subgroup") == "1-URGENT", " pre").when(F.col("subgroup") == "2-HIGH", "EDT ")
        .when(F.col("subgroup") == "3-MEDIUM", "on").otherwise(F.col("subgroup"))
    )
    units = views.units(spark, sf).withColumn("timing_class", fo.timing_class(label))
    return units.groupBy("stratum", "timing_class").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("group_id").alias("n_patients")
    )


@query("d11_study_source", """
select case when fold=1 then 'VanAllen' when fold=2 then 'Liu' else 'unresolved' end study_source, count(*) n from units group by 1""", ("units",))
def d11(spark, sf):
    name = (
        F.when(F.col("fold") == 1, F.concat(F.lit(" IPI_"), "group_id"))
        .when(F.col("fold") == 2, F.concat(F.lit("Patient"), "group_id")).otherwise(F.col("group_id"))
    )
    return views.units(spark, sf).groupBy(fo.study_source(name).alias("study_source")).agg(F.count(F.lit(1)).alias("n"))


def _numbered(spark, sf) -> DataFrame:
    return views.units(spark, sf).withColumn("pos", F.col("unit_id").cast("bigint"))


_POS = "u as (select *, cast(unit_id as bigint) pos from units)"


@query("d12_balanced_limit", f"""
with {_POS}, a as (select *, row_number() over (partition by outcome order by pos) r from u),
p as (select *, outcome pr from a where (outcome=0 and r<=2000) or (outcome=1 and r<=2000)),
s as (select unit_id, pr, pos from p union all select unit_id, 9, pos from u where unit_id not in (select unit_id from p))
select unit_id from s order by pr, pos limit 4000""", ("units",))
def d12(spark, sf):
    units = _numbered(spark, sf).select("unit_id", "outcome", "pos")
    return fo.balanced_limit(units, "unit_id", "pos", 4000).select("unit_id")


@query("d13_interleave_limit", f"""
with {_POS}, a as (select *, row_number() over (partition by outcome order by pos) r from u)
select unit_id, outcome from a order by r, outcome desc limit 3001""", ("units",))
def d13(spark, sf):
    units = _numbered(spark, sf).select("unit_id", "outcome", "pos")
    return fo.interleave_limit(units, "pos", 3001).select("unit_id", "outcome")


@query("d14_tertile_limit", f"""
with {_POS}, q as (select quantile_cont(duration,0.33) lo, quantile_cont(duration,0.67) hi from u),
b as (select unit_id, pos, case when event=1 and duration<=lo then 0 when event=0 and duration>=hi then 1 else 2 end b from u, q),
a as (select *, row_number() over (partition by b order by pos) r from b),
p as (select * from a where (b<2 and r<=1000) or (b=2 and r<=1001)),
s as (select unit_id, b pr, pos from p union all select unit_id, 9, pos from u where unit_id not in (select unit_id from p))
select unit_id from s order by pr, pos limit 3001""", ("units",))
def d14(spark, sf):
    units = _numbered(spark, sf).select("unit_id", "duration", "event", "pos")
    return fo.tertile_limit(units, "unit_id", "pos", 3001).select("unit_id")


@query("d15_head_limit", "select unit_id from units order by cast(unit_id as bigint) limit 500", ("units",))
def d15(spark, sf):
    return _numbered(spark, sf).orderBy("pos").limit(500).select("unit_id")
