"""Registered queries: scans, sources and sinks (a).

Each query first writes files derived from the tables to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import work_path
from ..sources import readers as rd, sinks as sk
from . import views
from .registry import query

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("a01_wide_matrix", f"""
with b as (select unnest([{','.join("'" + b + "'" for b in BRANDS)}]) feature), c as (select distinct unit_id from expr),
y as (select group_id, min(outcome) outcome from units group by 1)
select c.unit_id, b.feature, coalesce(e.value,0.0) as value, outcome from c cross join b left join expr e on e.unit_id=c.unit_id and e.feature=b.feature join y on y.group_id=c.unit_id""",
       ("units", "expr"))
def a01(spark, sf):
    path = work_path(spark, "matrix")
    views.expr(spark, sf).groupBy("unit_id").pivot("feature", BRANDS).agg(F.first("value")).write.csv(f"{path}/x", header=True)
    y = views.units(spark, sf).groupBy(F.col("group_id").alias("unit_id")).agg(F.min("outcome").alias("outcome"))
    y.write.csv(f"{path}/y", header=True)
    long = rd.wide_matrix(spark, f"{path}/x", "unit_id", BRANDS)
    return rd.aligned(long, rd.labels(spark, f"{path}/y", {"unit_id": "string", "outcome": "int"}), "unit_id")


@query("a02_labels", "select unit_id, duration, event from units", ("units",))
def a02(spark, sf):
    path = work_path(spark, "labels")
    views.units(spark, sf).select("unit_id", "duration", "event").write.csv(path, header=True)
    return rd.labels(spark, path, {"unit_id": "string", "duration": "double", "event": "int"})


@query("a03_commented_tsv", "select cast(c_custkey as varchar) patient_id, c_mktsegment stratum, cast(c_nationkey as varchar) nation from customer where c_nationkey<>3")
def a03(spark, sf):
    path = work_path(spark, "clinical")
    marked = F.when(F.col("c_nationkey") == 3, F.concat(F.lit("#note "), "c_custkey")).otherwise(F.col("c_custkey").cast("string"))
    line = F.concat_ws("\t", marked, "c_mktsegment", F.col("c_nationkey").cast("string"))
    views.table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return rd.commented_tsv(spark, path, ["patient_id", "stratum", "nation"], header=False)


@query("a04_clinical_mapping", """
select cast(o_orderkey as varchar) sample_id, 'C'||o_custkey group_id, 'baseline' treatment_time, o_orderstatus raw_response from orders where o_orderkey%2=0
union all select cast(o_orderkey as varchar), 'P'||o_custkey, case when o_orderpriority='1-URGENT' then 'unspecified' else o_orderpriority end,
 case when o_orderstatus='P' then 'missing' else o_orderstatus end from orders where o_orderkey%2=1""")
def a04(spark, sf):
    orders = views.table(spark, sf, "orders")
    a, b = orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1")
    time = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    response = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return rd.clinical_mapping([
        (a, {"sample_id": F.col("o_orderkey"), "group_id": F.concat(F.lit("C"), "o_custkey"),
             "treatment_time": F.lit("baseline"), "raw_response": F.col("o_orderstatus")}),
        (b, {"sample_id": F.col("o_orderkey"), "group_id": F.concat(F.lit("P"), "o_custkey"),
             "treatment_time": F.coalesce(time, F.lit("unspecified")), "raw_response": F.coalesce(response, F.lit("missing"))}),
    ])


@query("a05_embeddings", """
select vec_id, row_number() over (order by vec_id desc)-1 as position, len(embedding) dims, round(list_sum([x::double for x in embedding]),4) total from embeddings""")
def a05(spark, sf):
    from ..operators.ordered import running_totals

    vectors = views.table(spark, sf, "embeddings").select("vec_id", "embedding")
    order = running_totals(vectors.select("vec_id").withColumn("_one", F.lit(1).cast("bigint")), [], "vec_id", {"rn": "_one"}, descending=True)
    requested = order.select("vec_id", (F.col("rn") - 1).alias("position"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rd.embeddings(vectors, requested, "vec_id").select(
        "vec_id", "position", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 4).alias("total")
    )


@query("a06_multi_file_scan", """
select source sample_id, count(*) n, cast(sum((lang='')::int) as bigint) empty from (select source, case when doc_id%5=0 then '' else lang end lang from documents) group by 1""")
def a06(spark, sf):
    path = work_path(spark, "repertoires")
    docs = views.table(spark, sf, "documents").select(
        F.concat("source", F.lit("_BCR")).alias("k"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang")).alias("clone"), "doc_id",
    )
    docs.write.partitionBy("k").csv(path, sep="\t", header=True)
    rows = rd.per_sample_files(spark, path, "clone", pattern=r"k=([^/_]+)_")
    return rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("clone") == "").cast("bigint")).alias("empty"))


@query("a07_jsonl", "select event_id sample_id, event_type, cast(json_extract(props,'$.k') as int) k from events")
def a07(spark, sf):
    path = work_path(spark, "documents")
    events = views.table(spark, sf, "events")
    events.select(
        F.col("event_id").alias("sample_id"),
        F.struct("event_type", F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("parsed_response")).alias("result"),
    ).write.json(path)
    schema = "sample_id bigint, result struct<event_type:string, parsed_response:struct<k:int>>"
    return rd.jsonl(spark, path, schema, "sample_id").select("sample_id", "result.event_type", "result.parsed_response.k")


@query("a08_companion_metadata", """
select 'runs/'||source||'_predictions.csv' path, count(*) n, case when source like '%1' then null else round(avg(n_chars),3) end reference_value from documents group by source""")
def a08(spark, sf):
    docs = views.table(spark, sf, "documents")
    predictions = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("runs/"), "source", F.lit("_predictions.csv")).alias("path"), "n"
    )
    value = F.when(F.col("source").endswith("1"), "bad").otherwise(F.round(F.avg("n_chars"), 3).cast("string"))
    summaries = docs.groupBy("source").agg(value.alias("c_index")).select(
        F.concat(F.lit("runs/"), "source", F.lit("_summary.json")).alias("path"), "c_index"
    )
    return rd.companion(predictions, summaries, "path", "c_index")


def _copies(spark, sf) -> str:
    """One text file per (copy, nation) folder; copy b repeats copy a for even nations."""
    path = work_path(spark, "candidates")
    nation = views.table(spark, sf, "nation")
    customers = views.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = nation.join(customers, F.col("n_nationkey") == F.col("c_nationkey")).withColumn("copy", F.explode(F.array(F.lit("a"), F.lit("b"))))
    odd = (F.col("copy") == "b") & (F.col("n_nationkey") % 2 == 1)
    line = F.concat("n_name", F.lit(":"), F.col("n").cast("string"), F.when(odd, " changed").otherwise(""))
    rows.select(F.concat_ws("_", "copy", "n_name").alias("k"), line.alias("value")).repartition("k").write.partitionBy("k").text(path)
    return path


_COPIES = """cp as (select copy||'_'||n_name k, n_nationkey%2=1 odd, copy, n_name||':'||n||case when copy='b' and n_nationkey%2=1 then ' changed' else '' end||chr(10) body
 from (select n_nationkey, n_name, count(*) n from nation join customer on c_nationkey=n_nationkey group by 1,2) cross join (select unnest(['a','b']) copy))"""
_FOLDER = r"k=([^/]+)/"


@query("a09_discover_dedupe", f"with {_COPIES} select k, sha256(body) sha256, case when copy='b' and not odd then 'duplicate_identical_content' else 'selected' end status from cp")
def a09(spark, sf):
    found = rd.file_inventory(spark, _copies(spark, sf), "part-*")
    folder = F.regexp_extract("path", _FOLDER, 1)
    return rd.drop_identical(found, F.when(folder.startswith("a_"), 0).otherwise(1)).select(folder.alias("k"), "sha256", "status")


@query("a10_identity_from_path", r"""
with p as (select distinct o_custkey%7 r, o_orderkey%4 v from orders), q as (select case r%4 when 0 then 'qwen35' when 1 then 'kimi_k26' when 2 then 'minimax' else 'other' end pr, r, v from p)
select 'results/'||case v when 0 then 'prompt_v21' when 1 then 'prompt-v221' when 2 then 'prompt_v3' else 'plain' end||'/'||pr||' Run '||r||'/task'||case when v=3 then '_v221' else '' end||'_predictions.csv' path,
 case r%4 when 0 then 'qwen' when 1 then 'kimi' when 2 then 'minimax' else 'unknown' end provider, case r%4 when 0 then 'Qwen3.5-Plus' when 1 then 'Kimi-K2.6' when 2 then 'minimax_unknown' else 'unknown_model' end model_name,
 case v when 0 then 'v2.1' when 2 then 'v3' else 'v2.2.1' end prompt_version, pr||' Run '||r run_name,
 'fixed__'||case r%4 when 0 then 'qwen__qwen3_5_plus' when 1 then 'kimi__kimi_k2_6' when 2 then 'minimax__minimax_unknown' else 'unknown__unknown_model' end||'__'||case v when 0 then 'v2.1' when 2 then 'v3' else 'v2.2.1' end||'__'||pr||'_run_'||r model_id from q""")
def a10(spark, sf):
    r, v = F.col("o_custkey") % 7, F.col("o_orderkey") % 4
    pr = F.when(r % 4 == 0, "qwen35").when(r % 4 == 1, "kimi_k26").when(r % 4 == 2, "minimax").otherwise("other")
    version = F.when(v == 0, "prompt_v21").when(v == 1, "prompt-v221").when(v == 2, "prompt_v3").otherwise("plain")
    path = F.concat(F.lit("results/"), version, F.lit("/"), pr, F.lit(" Run "), r.cast("string"), F.lit("/task"),
                    F.when(v == 3, "_v221").otherwise(""), F.lit("_predictions.csv"))
    return rd.identity_from_path(views.table(spark, sf, "orders").select(path.alias("path")).distinct(), "path")


@query("a11_feature_annotation", """
with f as (select distinct case when l_partkey%2=0 then 'gene_'||(l_partkey%3000) else cast(l_partkey%3000 as varchar) end feature_id, l_partkey%3000 k from lineitem)
select feature_id, p_name symbol, upper(trim(p_name)) normalized_symbol from f left join part on p_partkey=k""")
def a11(spark, sf):
    key = (F.col("l_partkey") % 3000).cast("string")
    features = views.table(spark, sf, "lineitem").select(
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("gene_"), key)).otherwise(key).alias("feature_id")
    ).distinct()
    dim = views.table(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.col("p_name").alias("symbol"))
    return rd.annotate_features(features, dim)


@query("a13_availability", """
with g as (select model, stratum from (select unnest(['base','Kimi-2.6','fixed__lines']) model) cross join (select distinct stratum from units)),
f as (select model, stratum, count(*) n from predictions group by 1,2)
select g.model, g.stratum, n is not null available, case when n is null then 'not_present' else 'auditable_saved_variant' end variant from g left join f using (model, stratum)""", ("predictions",))
def a13(spark, sf):
    pred = views.predictions(spark, sf)
    models = F.explode(F.array(*[F.lit(m) for m in ("base", "Kimi-2.6", "fixed__lines")]))
    expected = pred.select("stratum").distinct().withColumn("model", models)
    have = pred.groupBy("model", "stratum").agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("n").isNotNull()
    return expected.join(have, ["model", "stratum"], "left").select(
        "model", "stratum", ok.alias("available"), F.when(ok, "auditable_saved_variant").otherwise("not_present").alias("variant")
    )


@query("a20_no_overwrite_sink", "select stratum, count(*) n, true first_write, false second_write from units group by 1", ("units",))
def a20(spark, sf):
    path = work_path(spark, "publish")
    rows = views.units(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    first, second = sk.publish_new(rows, path), sk.publish_new(rows.limit(1), path)
    return spark.read.parquet(path).withColumns({"first_write": F.lit(first), "second_write": F.lit(second)})


@query("a22_file_inventory", f"with {_COPIES} select k, strlen(body) bytes, sha256(body) sha256 from cp")
def a22(spark, sf):
    found = rd.file_inventory(spark, _copies(spark, sf), "part-*")
    return found.select(F.regexp_extract("path", _FOLDER, 1).alias("k"), "bytes", "sha256")


@query("a23_ordered_digest", """
select l_orderkey, sha256(string_agg(cast(l_partkey as varchar), chr(10) order by l_linenumber, l_partkey)) digest, count(*) n from lineitem group by 1""")
def a23(spark, sf):
    lines = views.table(spark, sf, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey"))
    return sk.ordered_digest(lines, ["l_orderkey"], "pos", F.col("l_partkey"))


@query("a24_resume_by_key", """
select distinct stratum, fold from units where not ((fold<=2 and stratum<>'BUILDING'))""", ("units",))
def a24(spark, sf):
    planned = views.units(spark, sf).select("stratum", "fold").distinct().withColumn(
        "digest", F.sha2(F.concat_ws("|", "stratum", "fold"), 256)
    )
    path = work_path(spark, "checkpoints")
    bad = F.when(F.col("stratum") == "BUILDING", "stale").otherwise(F.col("digest"))
    planned.where("fold <= 2").withColumn("digest", bad).write.partitionBy("fold").parquet(path)
    return sk.pending(planned, spark.read.parquet(path), ["stratum", "fold"], "digest").select("stratum", "fold")


@query("a25_input_drift", """
with h as (select p_partkey, sha256(p_name||'|'||p_size) h, sha256(p_name||'|'||case when p_partkey%97=0 then p_size+1 else p_size end) g from part)
select cast(p_partkey as varchar) path, case when p_partkey%101=0 then null else h end stored_hash, case when p_partkey%103=0 then null else g end current_hash from h
 where case when p_partkey%101=0 then null else h end is distinct from case when p_partkey%103=0 then null else g end""")
def a25(spark, sf):
    part = views.table(spark, sf, "part").withColumn("path", F.col("p_partkey").cast("string"))
    size = F.when(F.col("p_partkey") % 97 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    digest = lambda s: F.sha2(F.concat_ws("|", "p_name", s.cast("string")), 256).alias("sha256")
    stored = part.where("p_partkey % 101 <> 0").select("path", digest(F.col("p_size")))
    current = part.where("p_partkey % 103 <> 0").select("path", digest(size))
    return sk.drift(stored, current)


@query("a26_result_export", "select unit_id, group_id, stratum, duration, event from units", ("units",))
def a26(spark, sf):
    path = work_path(spark, "export")
    columns = ["unit_id", "group_id", "stratum", "duration", "event"]
    sk.export_documents(views.units(spark, sf), path, columns)
    return spark.read.schema("unit_id string, group_id string, stratum string, duration double, event int").json(path)
