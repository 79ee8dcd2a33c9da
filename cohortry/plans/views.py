"""Canonical inputs derived from the given tables, for Spark and as SQL text.

``units``        one row per order: group, stratum, duration, event, outcome, fold
``predictions``  units x four score models aggregated from lineitem
``alter``        binary alteration list: customer x brand with a large quantity
``expr``         expression-like matrix: customer x brand quantity sums
``genes``        expression-like matrix over the program gene symbols
``seqs``         every word of whole documents in upper case, as repertoire sequences
``repeats``      repeated scores per user from the event stream
``responses``    scored responses from the event stream
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed_values import ALTERATION_PROGRAMS, ALTERATION_THEMES, EXPRESSION_PROGRAMS
from ..functions.lineage import stored
from ..functions.scalars import hash32

MODELS = ("base", "price", "disc", "fixed__lines")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    key = F.col("o_custkey").cast("string")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("unit_id"),
        key.alias("group_id"),
        F.col("c_mktsegment").alias("stratum"),
        F.col("o_orderpriority").alias("subgroup"),
        F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date"))
        .cast("double").alias("duration"),
        (F.col("o_orderstatus") == "F").cast("int").alias("event"),
        (hash32(F.concat(F.lit("y:"), key)) % 2).cast("int").alias("outcome"),
        (hash32(F.concat(F.lit("42:"), key)) % 5 + 1).cast("int").alias("fold"),
    )


def _wide_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One aggregation of lineitem gives all four scores of an order."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").alias("base"),
            F.round(F.sum("l_extendedprice") / 1000).alias("price"),
            F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("double").alias("disc"),
            F.count(F.lit(1)).cast("double").alias("fixed__lines"),
        )
        .withColumn("unit_id", F.col("l_orderkey").cast("string"))
        .drop("l_orderkey")
    )


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _wide_scores(spark, sf).unpivot("unit_id", list(MODELS), "model", "score")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores are joined wide and unpivoted after it, so the join moves and sorts one row per unit."""
    orders = units(spark, sf)
    return orders.join(_wide_scores(spark, sf), "unit_id").unpivot(orders.columns, list(MODELS), "model", "score")


def stored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`predictions` for queries that read them more than once: one stored row per unit."""
    orders = units(spark, sf)
    wide = stored(orders.join(_wide_scores(spark, sf), "unit_id"), "predictions")
    return wide.unpivot(orders.columns, list(MODELS), "model", "score")


def _customer_brand(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").cast("string").alias("unit_id"), "p_partkey", "p_brand", "l_quantity")
    )


def alter(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _customer_brand(spark, sf).where("l_quantity > 45")
        .select("unit_id", F.col("p_brand").alias("feature")).distinct()
    )


def expr(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _customer_brand(spark, sf)
        .groupBy("unit_id", F.col("p_brand").alias("feature"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")
    )
    return words.where("w <> ''").select("sample_id", F.upper("w").alias("seq"))


def repeats(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(
            F.col("user_id").alias("sample_id"),
            "event_type",
            (F.dayofmonth("ts") % 20).alias("repeat_seed"),
        )
        .agg(F.avg("value").alias("risk_score"))
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"),
        "event_type",
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("support_score"),
        "value",
    )


GENES = sorted({g for genes in EXPRESSION_PROGRAMS.values() for g in genes})


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Customer x gene values: the gene list is indexed by p_partkey modulo its length."""
    names = F.array(*[F.lit(g) for g in GENES])
    index = (F.col("p_partkey") % len(GENES) + 1).cast("int")
    return (
        _customer_brand(spark, sf)
        .groupBy("unit_id", F.element_at(names, index).alias("gene"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def _h(text: str) -> str:
    return f"('0x'||substr(md5({text}),1,8))::bigint"


_CUSTOMER_BRAND = """select cast(o_custkey as varchar) unit_id, p_partkey, p_brand, l_quantity
 from orders join lineitem on l_orderkey=o_orderkey join part on l_partkey=p_partkey"""

SQL = {
    "units": f"""select cast(o_orderkey as varchar) unit_id, cast(o_custkey as varchar) group_id,
 c_mktsegment stratum, o_orderpriority subgroup,
 cast(date_diff('day', cast(o_orderdate as date), date '2001-08-02') as double) duration,
 cast(case when o_orderstatus='F' then 1 else 0 end as int) event,
 cast({_h("'y:'||cast(o_custkey as varchar)")} % 2 as int) outcome,
 cast({_h("'42:'||cast(o_custkey as varchar)")} % 5 + 1 as int) fold
 from orders join customer on o_custkey=c_custkey""",
    "predictions": """select u.*, model, score from units u join (
 select cast(l_orderkey as varchar) k, 'base' model, sum(l_quantity) score from lineitem group by l_orderkey
 union all select cast(l_orderkey as varchar), 'price', round(sum(l_extendedprice)/1000) from lineitem group by l_orderkey
 union all select cast(l_orderkey as varchar), 'disc', cast(sum(cast(round(l_discount*100) as int)) as double) from lineitem group by l_orderkey
 union all select cast(l_orderkey as varchar), 'fixed__lines', cast(count(*) as double) from lineitem group by l_orderkey) p
 on u.unit_id=p.k""",
    "alter_v": f"select distinct unit_id, p_brand feature from ({_CUSTOMER_BRAND}) where l_quantity>45",
    "expr": f"select unit_id, p_brand feature, sum(l_quantity) as value from ({_CUSTOMER_BRAND}) group by 1,2",
    "genes": f"""select unit_id, ([{','.join("'" + g + "'" for g in GENES)}])[p_partkey % {len(GENES)} + 1] gene,
 sum(l_quantity) as value from ({_CUSTOMER_BRAND}) group by 1,2""",
    "seqs": """select doc_id sample_id, upper(replace(w,'ß','ss')) seq from
 (select doc_id, unnest(regexp_split_to_array(text,'[\\x20\\x09-\\x0D]+')) w from documents) where w<>''""",
    "repeats": """select user_id sample_id, event_type, cast(day(ts)%20 as int) repeat_seed, avg(value) risk_score
 from events group by 1,2,3""",
    "responses": """select event_id sample_id, event_type, cast(json_extract(props,'$.k') as double)/100 support_score, value from events""",
}

_NEEDS = {"predictions": ("units",)}


def with_views(query: str, *names: str, recursive: bool = False) -> str:
    """Prefix ``query`` with the CTEs it needs."""
    order: list[str] = []
    for name in names:
        for need in (*_NEEDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    ctes = ",\n".join(f"{n} as ({SQL[n]})" for n in order)
    word = "with recursive" if recursive else "with"
    body = query.strip()
    lower = body[:5].lower()
    if lower.startswith("with "):
        body = body[5:]
        return f"{word} {ctes},\n{body}"
    return f"{word} {ctes}\n{body}"


ALTERED_GENES = sorted({g for t in (ALTERATION_PROGRAMS, ALTERATION_THEMES) for genes in t.values() for g in genes})
SQL["mutations"] = f"""select distinct unit_id, ([{','.join("'" + g + "'" for g in ALTERED_GENES)}])[p_partkey % {len(ALTERED_GENES)} + 1] gene
 from ({_CUSTOMER_BRAND}) where l_quantity > 35"""


def mutations(spark: SparkSession, sf: str) -> DataFrame:
    """Binary alterations: customers x alteration genes bought in large quantity."""
    names = F.array(*[F.lit(g) for g in ALTERED_GENES])
    index = (F.col("p_partkey") % len(ALTERED_GENES) + 1).cast("int")
    return (
        _customer_brand(spark, sf).where("l_quantity > 35")
        .select("unit_id", F.element_at(names, index).alias("gene")).distinct()
    )
