"""Registered queries: decisions and scoring tables (m), text and JSON (n)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import formulas as fm
from ..functions.lineage import settle, work_path
from ..functions.scalars import hash32
from ..operators import decisions as dc, features as ft, rankstats as rs, textjson as tj
from ..operators.contracts import id_set_equal
from ..operators.pairs import concordance
from ..streaming import scoring
from . import views
from .q_class_rank import rounded
from .q_features import ECO_SQL, RULE_SQL, activity_sql, chem, ecology
from .q_surv import pair_sql
from .registry import query

THRESHOLD = "case event_type when 'click' then 0.04 when 'view' then 0.12 else 0.0 end"
RESIST = "least(1.0, value / 50e0)"


def _r(text: str) -> str:
    """Oracle rounding of composite scores, deciding ties in decimals."""
    return text.replace("round(round(", "cast(round(cast((").replace(", 12), 4)", ") as decimal(30,12)), 4) as double)")


_MARGIN = f"rs as (select sample_id, event_type, support_score, {RESIST} resistance, value, {THRESHOLD} thr from responses)," + fm.stages_sql(
    "rs", fm.margin_decision("support_score", "resistance", "thr"), "dec")


def responses(spark, sf) -> DataFrame:
    return views.responses(spark, sf).withColumns({"resistance": F.expr(RESIST), "thr": F.expr(THRESHOLD)})


def margin_rows(spark, sf) -> DataFrame:
    return fm.with_formulas(responses(spark, sf), fm.margin_decision("support_score", "resistance", "thr"))


@query("m01_margin_decision", f"with {_MARGIN} select sample_id, event_type, prediction, confidence, score_margin from dec", ("responses",))
def m01(spark, sf):
    return margin_rows(spark, sf).select("sample_id", "event_type", "prediction", "confidence", "score_margin")


_RISK = fm.stages_sql("responses", fm.risk_decision("support_score * 1.2 - 0.1"), "rk0")


@query("m02_risk_decision", f"with {_RISK} select sample_id, risk_group, risk_score, confidence from rk0", ("responses",))
def m02(spark, sf):
    out = fm.with_formulas(views.responses(spark, sf), fm.risk_decision("support_score * 1.2 - 0.1"))
    return out.select("sample_id", "risk_group", "risk_score", "confidence")


@query("m03_recalibration", f"with {ECO_SQL}," + fm.stages_sql("eco", fm.ECOLOGY_STATES, "st") + """,
r0 as (select *, (('0x'||substr(md5('r:'||unit_id),1,8))::bigint % 1000)/1000e0 risk0 from st),
""" + fm.stages_sql("r0", fm.RECALIBRATION, "rec") + """
select unit_id, risk0, recalibrated, tags, tags<>'' applied from rec""", ("genes",))
def m03(spark, sf):
    states = fm.with_formulas(ecology(spark, sf), fm.ECOLOGY_STATES)
    start = (hash32(F.concat(F.lit("r:"), "unit_id")) % 1000) / F.lit(1000.0)
    out = fm.with_formulas(states.withColumn("risk0", start), fm.RECALIBRATION)
    return out.select("unit_id", "risk0", "recalibrated", "tags", (F.col("tags") != "").alias("applied"))


_RULEDEC = """, rd as (select sample_id, prediction, cast(round(cast(greatest(0.5,least(0.95,0.5+0.9*abs(round(toxicity_support,4)-0.5))) as decimal(30,12)),4) as double) confidence,
 round(round(toxicity_support,4)-round(tolerance_support,4),4) score_margin, round(centered,4) calibrated_margin, dominant_side from rule)"""


def rule_decisions(spark, sf) -> DataFrame:
    profile = ft.rule_profile(settle(chem(spark, sf)))
    tox, tol = F.round("toxicity_support", 4), F.round("tolerance_support", 4)
    return profile.select(
        "sample_id", "prediction",
        ft.round4(F.greatest(F.lit(0.5), F.least(F.lit(0.95), 0.5 + 0.9 * F.abs(tox - 0.5)))).alias("confidence"),
        F.round(tox - tol, 4).alias("score_margin"), F.round("centered", 4).alias("calibrated_margin"), "dominant_side",
    )


@query("m04_rule_decision", RULE_SQL + _RULEDEC + " select * from rd", ("seqs",))
def m04(spark, sf):
    return rule_decisions(spark, sf)


@query("m05_hybrid_fallback", RULE_SQL + _RULEDEC + """,
md as (select doc_id sample_id, case when toxic=1 then 'positive' else 'negative' end prediction, case when quality=1 then 0.9 else 0.6 end::double confidence from labels)
select rd.sample_id, coalesce(md.prediction, rd.prediction) prediction, coalesce(md.confidence, rd.confidence) confidence,
 case when md.sample_id is not null then 'model' else 'hybrid_rule_fallback' end mode from rd left join md using (sample_id)""", ("seqs",))
def m05(spark, sf):
    labels = views.table(spark, sf, "labels")
    model = labels.select(
        F.col("doc_id").alias("sample_id"),
        F.when(F.col("toxic") == 1, "positive").otherwise("negative").alias("prediction"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.6).alias("confidence"),
    )
    return dc.hybrid(model, rule_decisions(spark, sf), "sample_id", ["prediction", "confidence"])


INSTRUCTION = ["Assess this sample using dual scoring.", "Weigh response-supporting evidence against resistance-supporting evidence."]
SCHEMA_TEXT = "Return a JSON object with fields: response_support_score: number; resistance_support_score: number."
_REQ = activity_sql(6) + f""",
sm as (select unit_id, to_json({{'dominant_programs': list({{'program': program, 'activity_level': "level"}} order by "rank"), 'sample_id': unit_id}}) s from act where "rank"<=5 group by 1),
rq as (select unit_id, '{chr(10).join(INSTRUCTION)}'||chr(10)||s user_prompt, '{SCHEMA_TEXT}' "schema" from sm)"""


def requests(spark, sf) -> DataFrame:
    activity = ft.program_activity_rank(views.genes(spark, sf)).where("rank <= 5")
    listed = activity.groupBy("unit_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "program", F.col("level").alias("activity_level")))).alias("p")
    )
    programs = F.transform("p", lambda x: F.struct(x["program"].alias("program"), x["activity_level"].alias("activity_level")))
    summary = F.to_json(F.struct(programs.alias("dominant_programs"), F.col("unit_id").alias("sample_id")))
    return dc.request_table(listed.withColumn("s", summary), "unit_id", INSTRUCTION, "s", SCHEMA_TEXT)


@query("m06_request_table", f"with {_REQ} select * from rq", ("genes",))
def m06(spark, sf):
    return requests(spark, sf)


_KEY = "sha256('{\"model\":\"m\",\"schema\":\"'||\"schema\"||'\",\"user_prompt\":'||to_json(user_prompt)||'}')"


def keyed(spark, sf) -> DataFrame:
    key = dc.request_key({"model": F.lit("m"), "user_prompt": F.col("user_prompt"), "schema": F.col("schema")})
    return requests(spark, sf).withColumn("request_key", key)


@query("m07_request_key", f"with {_REQ} select unit_id, {_KEY} request_key from rq", ("genes",))
def m07(spark, sf):
    return keyed(spark, sf).select("unit_id", "request_key")


@query("m08_cache_split", f"""with {_REQ}, k as (select unit_id, {_KEY} request_key from rq)
select unit_id, case when substr(request_key,1,1)<'8' then 'cached' else 'to_send' end status,
 case when substr(request_key,1,1)<'8' then substr(request_key,1,4) end answer from k""", ("genes",))
def m08(spark, sf):
    asked = settle(keyed(spark, sf).select("unit_id", "request_key"))
    cached = asked.where(F.substring("request_key", 1, 1) < "8").select(
        "request_key", F.substring("request_key", 1, 4).alias("answer")
    )
    have, send = dc.cache_split(asked, cached, "request_key")
    return have.select("unit_id", F.lit("cached").alias("status"), "answer").unionByName(
        send.select("unit_id", F.lit("to_send").alias("status"), F.lit(None).cast("string").alias("answer"))
    )


# answers in four shapes: plain, fenced, embedded in prose (twice), unusable
def answers(spark, sf) -> DataFrame:
    score = F.col("support_score")
    side = F.when(score > 0.6, "response").when(score > 0.3, "mixed").otherwise("unclear")
    body = F.to_json(F.struct(
        score.alias("response_support_score"), F.col("resistance").alias("resistance_support_score"),
        side.alias("dominant_side"), F.array(F.lit("first"), F.col("event_type")).alias("rationale"),
    ))
    shape = F.col("sample_id") % 4
    content = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Note {draft}: "), body, F.lit(" and {\"x\": 1}.")))
        .otherwise(F.lit("no object here"))
    )
    tokens = F.when(F.col("sample_id") % 10 != 0, (F.col("value") * 10).cast("int"))
    usage = F.struct(
        (F.col("sample_id") % 100).cast("int").alias("prompt_tokens"),
        (F.col("sample_id") % 7).cast("int").alias("completion_tokens"), tokens.alias("total_tokens"),
    )
    raw = F.to_json(F.struct(
        F.concat(F.lit("req-"), "sample_id").alias("custom_id"), usage.alias("usage"),
        F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
    ))
    return responses(spark, sf).withColumn("content", content).withColumn("raw", raw)


@query("m09_parse_response", f"""
select sample_id, sample_id%4<3 is_object, case when sample_id%4<3 then support_score end response_support_score,
 case when sample_id%4<3 then event_type end last_reason from responses""", ("responses",))
def m09(spark, sf):
    out = tj.parse_response(answers(spark, sf).select("sample_id", "content"), "content")
    doc = F.from_json("parsed", "response_support_score double, rationale array<string>")
    return out.withColumn("d", doc).select(
        "sample_id", F.col("parsed").isNotNull().alias("is_object"),
        F.col("d.response_support_score").alias("response_support_score"),
        F.get(F.col("d.rationale"), F.lit(1)).alias("last_reason"),
    )


@query("m10_schema_check", """
select sample_id, 'dominant_side' field, 'unknown value' problem from responses where sample_id%4<3 and support_score<=0.3
union all select sample_id, 'confidence', 'missing' from responses where sample_id%4<3""", ("responses",))
def m10(spark, sf):
    parsed = tj.parse_response(answers(spark, sf).select("sample_id", "content"), "content").where("parsed IS NOT NULL")
    return tj.schema_violations(
        parsed, "sample_id", "parsed", ["response_support_score", "resistance_support_score", "confidence"],
        {"dominant_side": ["response", "resistance", "mixed"]}, ["rationale"],
    )


@query("m11_batch_reorder", """
select sample_id, row_number() over (order by sample_id)-1 as position, sample_id%4<3 answered from responses""", ("responses",))
def m11(spark, sf):
    asked = views.responses(spark, sf).select("sample_id", F.concat(F.lit("req-"), "sample_id").alias("custom_id"))
    numbered = rs.with_average_rank(asked, [], "sample_id", "r").withColumn("position", (F.col("r") - 1).cast("bigint"))
    results = answers(spark, sf).where("sample_id % 4 < 3").select(F.get_json_object("raw", "$.custom_id").alias("custom_id"), F.lit(True).alias("ok"))
    out = dc.in_request_order(numbered.select("sample_id", "custom_id", "position"), results, "custom_id", strict=False)
    return out.select("sample_id", "position", F.coalesce("ok", F.lit(False)).alias("answered"))


def _flat(spark, sf) -> DataFrame:
    """Nested answer documents flattened to prediction rows."""
    return flat_answers(answers(spark, sf))


def flat_answers(rows: DataFrame) -> DataFrame:
    """One row for every answer, whatever its shape; without an object the decision is NULL and the usage is kept."""
    doc = F.from_json("raw", "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>, choices array<struct<message:struct<content:string>>>")
    base = rows.withColumn("d", doc).withColumn("text", F.get("d.choices", F.lit(0))["message"]["content"])
    body = F.from_json("parsed", "response_support_score double, resistance_support_score double, dominant_side string, rationale array<string>")
    flat = tj.parse_response(base, "text").withColumn("b", body).select(
        "sample_id", "event_type", "thr", F.col("parsed").isNotNull().alias("is_object"), F.col("b.response_support_score").alias("support"),
        F.col("b.resistance_support_score").alias("resist"), F.col("b.dominant_side").alias("dominant_side"),
        F.array_join("b.rationale", " | ").alias("rationale"), "d.usage.prompt_tokens", "d.usage.completion_tokens", "d.usage.total_tokens",
    )
    decided = fm.with_formulas(flat, fm.margin_decision("support", "resist", "thr"))
    decided = decided.withColumns({c: F.when(F.col("is_object"), F.col(c)) for c in ("prediction", "confidence", "score_margin")})
    return decided.withColumns({
        "call": (F.col("prediction") == "positive").cast("int"),
        "true_label": (hash32(F.concat(F.lit("t:"), F.col("sample_id").cast("string"))) % 2).cast("int"),
    })


# Three answer shapes of four hold an object; the fourth has no decision but keeps its usage.
_FLAT = f"{_MARGIN}," + """fl as (select sample_id, event_type,
 case when has then case when support_score>0.6 then 'response' when support_score>0.3 then 'mixed' else 'unclear' end end dominant_side,
 case when has then 'first | '||event_type end rationale,
 cast(sample_id%100 as int) prompt_tokens, cast(sample_id%7 as int) completion_tokens, case when sample_id%10<>0 then cast(trunc(value*10) as int) end total_tokens,
 case when has then prediction end prediction, case when has then confidence end confidence, case when has then score_margin end score_margin,
 case when has then cast(prediction='positive' as int) end "call", cast(('0x'||substr(md5('t:'||sample_id),1,8))::bigint%2 as int) true_label
 from (select *, sample_id%4<3 has from dec))"""
_FLAT_COLS = 'sample_id, event_type, dominant_side, rationale, prompt_tokens, completion_tokens, total_tokens, prediction, confidence, score_margin, "call", true_label'


@query("m12_result_rows", f"with {_FLAT} select {_FLAT_COLS} from fl", ("responses",))
def m12(spark, sf):
    return _flat(spark, sf).select(*_FLAT_COLS.replace('"', "").split(", "))


_SUMMARY = """count(*) sample_count, cast(sum("call") as bigint) positive_predictions, %s
 round(avg(("call"=true_label)::int),4) accuracy,
 round(coalesce(sum(("call"=1 and true_label=1)::int)*1.0/nullif(sum("call"),0),0),4) as precision,
 round(coalesce(sum(("call"=1 and true_label=1)::int)*1.0/nullif(sum(true_label) filter ("call" is not null),0),0),4) recall,
 round(coalesce(sum(("call"=0 and true_label=0)::int)*1.0/nullif(sum(1-true_label) filter ("call" is not null),0),0),4) specificity,
 round(coalesce(2.0*sum(("call"=1 and true_label=1)::int)/nullif(sum("call")+sum(true_label) filter ("call" is not null),0),0),4) f1,
 round(avg(confidence),4) mean_confidence, round(avg(total_tokens),2) mean_total_tokens"""
_RATES = ["accuracy", "precision", "recall", "specificity", "f1", "mean_confidence"]


@query("m13_dataset_summary", f"with {_FLAT} select event_type, " + _SUMMARY % 'cast(sum(1-"call") as bigint) negative_predictions,' + " from fl group by 1", ("responses",))
def m13(spark, sf):
    out = dc.dataset_summary(_flat(spark, sf), ["event_type"])
    return rounded(rounded(out, 4, *_RATES), 2, "mean_total_tokens")


@query("m14_report_rollup", f"with {_FLAT}, a as (select event_type, {_SUMMARY % ''} from fl group by 1), " + f"""
b as (select 'ALL_DATASETS' event_type, {_SUMMARY % ''} from fl)
select * from a union all select event_type, sample_count, positive_predictions, accuracy, null, null, null, null, mean_confidence, mean_total_tokens from b""", ("responses",))
def m14(spark, sf):
    return rounded(rounded(dc.report_rollup(_flat(spark, sf), "event_type"), 4, *_RATES), 2, "mean_total_tokens")


@query("m15_fixed_score_load", """
select doc_id sample_id, quality outcome, round(0.2+0.6*toxic,4)::double score, cast(toxic as int) "call", 'Fixed' strategy, 'prompt_v2' variant, source dataset
 from labels join documents using (doc_id) where doc_id in (select doc_id from documents)""")
def m15(spark, sf):
    labels, docs = views.table(spark, sf, "labels"), views.table(spark, sf, "documents").select("doc_id", "source")
    covered = labels.join(id_set_equal(docs, labels, ["doc_id"]).where("detail = 'extra'").select(F.col("key").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
    return covered.join(docs, "doc_id").select(
        F.col("doc_id").alias("sample_id"), F.col("quality").alias("outcome"),
        F.round(0.2 + 0.6 * F.col("toxic"), 4).alias("score"), F.col("toxic").cast("int").alias("call"),
        F.lit("Fixed").alias("strategy"), F.lit("prompt_v2").alias("variant"), F.col("source").alias("dataset"),
    )


_GRID = "(select model, stratum from (select unnest(['base','price','kimi']) model) cross join (select distinct stratum from units))"


@query("m16_prediction_union", f"""
with g as {_GRID}, f as (select model, stratum, count(*) n from predictions group by 1,2)
select g.model, g.stratum, case when n is not null then 'available_complete_prediction' else 'unavailable_source_prediction_not_found' end status,
 case when n is null then 'no saved prediction was found' end reason, coalesce(n,0) n_predictions from g left join f using (model, stratum)""", ("predictions",))
def m16(spark, sf):
    pred = views.predictions(spark, sf)
    grid = pred.select("stratum").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in ("base", "price", "kimi")])))
    return dc.availability(grid, pred, ["model", "stratum"], "no saved prediction was found")


@query("m17_incremental_append", "with " + fm.stages_sql("(select event_id sample_id, cast(json_extract(props,'$.k') as double)/100 raw from events)", fm.risk_decision("raw"), "d") + """
select cast(sample_id as varchar) sample_id, risk_group, risk_score, confidence from d""")
def m17(spark, sf):
    """Two arrivals; the second repeats the first one's requests with other answers, which must not count."""
    base = work_path(spark, "answers")
    score = F.get_json_object("props", "$.k").cast("double") / 100
    events = views.table(spark, sf, "events")
    late = F.col("event_id") % 2 == 1

    def answers(rows: DataFrame, value) -> DataFrame:
        text = F.concat(F.lit("```json\n"), F.to_json(F.struct(value.alias("risk_score"))), F.lit("\n```"))
        return rows.select(F.col("event_id").cast("string").alias("sample_id"), text.alias("content"))

    for arrival in (answers(events.where(~late), score), answers(events, F.when(late, score).otherwise(1 - score))):
        arrival.write.mode("append").json(f"{base}/in")
        scoring.append_decisions(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


@query("m18_token_usage", f"""with {_FLAT} select event_type, round(avg(prompt_tokens),4) mean_prompt, round(avg(completion_tokens),4) mean_completion,
 round(avg(total_tokens),4) mean_total, count(total_tokens) with_usage from fl group by 1""", ("responses",))
def m18(spark, sf):
    return rounded(_flat(spark, sf).groupBy("event_type").agg(
        F.avg("prompt_tokens").alias("mean_prompt"), F.avg("completion_tokens").alias("mean_completion"),
        F.avg("total_tokens").alias("mean_total"), F.count("total_tokens").alias("with_usage"),
    ), 4, "mean_prompt", "mean_completion", "mean_total")


# ---------------------------------------------------------------- text (n)
_CLIN = """select o_orderkey unit_id, o_custkey c,
 case o_orderkey%4 when 0 then null when 1 then cast(o_custkey%4 as string) when 2 then cast(o_custkey%4 as string)||';'||cast(o_orderkey%5 as string)
  else 'grade '||cast(o_custkey%3 as string)||' then '||cast(o_custkey%5 as string) end grade1,
 case o_orderkey%4 when 0 then '12' when 1 then cast(o_custkey%50-10 as string) when 2 then cast(o_custkey%50-10 as string)||'; '||cast(o_custkey%70 as string)
  else cast(o_custkey%90-20 as string)||'d' end date1,
 case o_orderkey%3 when 0 then null when 1 then '2' else '0' end grade2,
 case o_orderkey%3 when 1 then '5;'||cast(o_custkey%60-30 as string) else '7' end date2 from orders"""
PAIRS = {"skin": ("grade1", "date1"), "liver": ("grade2", "date2")}


def clinical(spark, sf) -> DataFrame:
    views.table(spark, sf, "orders").createOrReplaceTempView("orders_clinical_source")
    return spark.sql(_CLIN.replace("from orders", "from orders_clinical_source"))


def _tok(col: str, signed: bool = False) -> str:
    return f"[x::double for x in regexp_extract_all(coalesce({col},''), '{'-?' if signed else ''}\\d+(?:\\.\\d+)?')]"


def _pairs_sql(g: str, d: str) -> str:
    gg, dd = _tok(g), _tok(d, True)
    return f"""case when len({gg})=0 or len({dd})=0 then [] when len({gg})=len({dd}) then [{{'g': ({gg})[i], 'd': ({dd})[i]}} for i in range(1, len({gg})+1)]
 when len({gg})=1 then [{{'g': ({gg})[1], 'd': x}} for x in {dd}] else [{{'g': list_max({gg}), 'd': ({dd})[1]}}] end"""


_CL = f"cl as ({_CLIN.replace(' as string', ' as varchar')}), ev0 as (select *, {_pairs_sql('grade1','date1')} p1, {_pairs_sql('grade2','date2')} p2 from cl)"


@query("n01_numeric_tokens", f"""with {_CL} select unit_id, array_to_string([x::int for x in {_tok('grade1')}],',') grades,
 array_to_string([x::int for x in {_tok('date1', True)}],',') as "days" from cl""")
def n01(spark, sf):
    ints = lambda a: F.array_join(F.transform(a, lambda x: x.cast("int").cast("string")), ",")
    return clinical(spark, sf).select(
        "unit_id", ints(tj.numeric_tokens(F.col("grade1"))).alias("grades"), ints(tj.numeric_tokens(F.col("date1"), signed=True)).alias("days")
    )


@query("n02_align_grade_date", f"with {_CL} select unit_id, len(p1) n, coalesce(array_to_string([x.g::int||'@'||x.d::int for x in p1],','),'') pairs from ev0")
def n02(spark, sf):
    pairs = tj.grade_date_events(F.col("grade1"), F.col("date1"))
    text = F.transform(pairs, lambda e: F.concat(e["grade"].cast("int").cast("string"), F.lit("@"), e["day"].cast("int").cast("string")))
    return clinical(spark, sf).select("unit_id", F.size(pairs).cast("bigint").alias("n"), F.array_join(text, ",").alias("pairs"))


@query("n03_event_explode", f"""with {_CL}, e as (select unit_id, 'skin' kind, unnest(p1) x from ev0 union all select unit_id, 'liver', unnest(p2) from ev0)
select unit_id, kind, x.g grade, x.d as "day" from e where x.g>0""")
def n03(spark, sf):
    return tj.event_rows(clinical(spark, sf), "unit_id", PAIRS)


@query("n04_label_audit", f"""with {_CL}, f as (select *, [x for x in list_concat([{{'k':'skin','g':x.g,'d':x.d}} for x in p1],[{{'k':'liver','g':x.g,'d':x.d}} for x in p2]) if x.g>0] e,
 list_concat({_tok('grade1')},{_tok('grade2')}) a from ev0)
select unit_id, cast(greatest(coalesce(try_cast(grade1 as double),0),coalesce(try_cast(grade2 as double),0))>0 as int) legacy_label,
 cast(coalesce(list_max(a),0)>0 as int) corrected_label, cast(len([x for x in e if x.d>0])>0 as int) incident_label, len([x for x in e if x.d<=0])>0 has_pre_event,
 list_min([x.d for x in e]) earliest_day, list_min([x.d for x in e if x.d>0]) earliest_post_day, coalesce(list_max(a),0) max_grade, cast(len(e) as int) n_events,
 '['||coalesce(array_to_string(['{{"kind":"'||x.k||'","grade":'||x.g||',"day":'||x.d||'}}' for x in e],','),'')||']' event_detail from f""")
def n04(spark, sf):
    return tj.label_audit(clinical(spark, sf), "unit_id", PAIRS)


@query("n05_status_parse", """
select o_orderkey unit_id, cast(o_orderstatus='F' as int) event from orders""")
def n05(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "1:Deceased").when(F.col("o_orderstatus") == "O", "0:LIVING")
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"), tj.is_deceased(status).alias("event"))


def payloads(spark, sf) -> DataFrame:
    """Prompt texts that end with a JSON payload; one in five has none."""
    score, n = F.col("support_score"), F.col("sample_id") % 5
    body = F.to_json(F.struct(
        F.when(n == 1, F.col("sample_id").cast("string")).alias("sample_id"),
        F.when(n == 2, F.col("event_type")).alias("dataset"),
        F.when(n == 3, F.lit(1)).alias("fold"),
        F.struct(score.alias("response"), F.col("value").cast("int").alias("count"), F.lit("7").alias("note")).alias("evidence_balance"),
        F.struct(F.struct((score * 2).alias("net")).alias("inner"), (score > 0.5).alias("near_zero")).alias("calibration_snapshot"),
        F.array(F.struct(F.col("event_type").alias("program"), score.alias("score"), F.lit("high").alias("activity_level"))).alias("dominant_programs"),
    ))
    text = F.when(n == 4, F.lit("Only {prose} here")).otherwise(F.concat(F.lit("Use {braces} with care.\n"), body, F.lit("\n")))
    return views.responses(spark, sf).withColumn("user_prompt", text)


@query("n06_payload_suffix", "select sample_id, sample_id%5<>4 has_payload, case when sample_id%5<>4 then support_score end response from responses", ("responses",))
def n06(spark, sf):
    found = payloads(spark, sf).withColumn("payload", tj.trailing_object(F.col("user_prompt")))
    return found.select(
        "sample_id", F.col("payload").isNotNull().alias("has_payload"),
        F.get_json_object("payload", "$.evidence_balance.response").cast("double").alias("response"),
    )


@query("n07_flatten_numeric", """
with l as (select sample_id, 'evidence_balance.response' feature, support_score as value from responses union all
 select sample_id, 'evidence_balance.count', trunc(value) from responses union all
 select sample_id, 'calibration_snapshot.inner.net', support_score*2 from responses union all
 select sample_id, 'calibration_snapshot.near_zero', (support_score>0.5)::int::double from responses union all
 select sample_id, 'dominant_programs['||event_type||'].score', support_score from responses)
select sample_id, feature, round(value,9) as value from l where sample_id%5<>4 union all select sample_id, feature||'.__present', 1.0 from l where sample_id%5<>4""", ("responses",))
def n07(spark, sf):
    found = payloads(spark, sf).withColumn("payload", tj.trailing_object(F.col("user_prompt"))).where("payload IS NOT NULL")
    return rounded(tj.flatten_numeric(found, "sample_id", "payload"), 9, "value")


@query("n08_request_audit", """
select sample_id, sample_id%5=1 sample_id_in_payload, sample_id%5=2 cohort_in_payload, sample_id%5=3 outcome_field_in_payload from responses where sample_id%5<>4""", ("responses",))
def n08(spark, sf):
    found = payloads(spark, sf).withColumn("payload", tj.trailing_object(F.col("user_prompt"))).where("payload IS NOT NULL")
    return tj.request_audit(found, "sample_id", "payload")
