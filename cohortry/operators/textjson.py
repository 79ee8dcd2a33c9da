"""Clinical text and JSON extraction."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fixed_values import FORBIDDEN_FIELDS
from ..functions.lineage import settle

UNSIGNED = r"\d+(?:\.\d+)?"
SIGNED = r"-?\d+(?:\.\d+)?"


def numeric_tokens(text: Column, signed: bool = False) -> Column:
    """All numbers in free text as an array of doubles; NULL gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIGNED if signed else UNSIGNED), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


_PAIR = "array<struct<grade:double,day:double>>"


def grade_date_events(grade: Column, date: Column) -> Column:
    """Align grade and date lists of one cell pair.

    Equal lengths pair up, one grade goes with every date, one date takes the
    maximum grade; any other shape is an error.
    """
    return _align(numeric_tokens(grade), numeric_tokens(date, signed=True), grade, date)


def _align(g: Column, d: Column, grade: Column, date: Column) -> Column:
    pair = lambda a, b: F.struct(a.alias("grade"), b.alias("day"))
    message = F.concat(F.lit("cannot align grade/date lists: "), grade, F.lit(" / "), date)
    return (
        F.when((F.size(g) == 0) | (F.size(d) == 0), F.array().cast(_PAIR))
        .when(F.size(g) == F.size(d), F.zip_with(g, d, pair))
        .when(F.size(g) == 1, F.transform(d, lambda x: pair(g[0], x)))
        .when(F.size(d) == 1, F.array(pair(F.array_max(g), d[0])))
        .otherwise(F.raise_error(message).cast(_PAIR))
    )


def _tokenized(df: DataFrame, unit: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Token arrays as columns of their own, so each cell is scanned once."""
    cells = sorted({c for pair in pairs.values() for c in pair})
    return df.select(
        unit, *cells,
        *[numeric_tokens(F.col(g)).alias(f"_g_{kind}") for kind, (g, _) in pairs.items()],
        *[numeric_tokens(F.col(d), signed=True).alias(f"_d_{kind}") for kind, (_, d) in pairs.items()],
    )


def _events(kind: str, grade: str, date: str) -> Column:
    return _align(F.col(f"_g_{kind}"), F.col(f"_d_{kind}"), F.col(grade), F.col(date))


def event_rows(df: DataFrame, unit: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(unit, kind, grade, day) for every grade/date column pair, positive grades only."""
    cells = F.array(*[
        F.struct(F.lit(kind).alias("kind"), _events(kind, g, d).alias("events")) for kind, (g, d) in pairs.items()
    ])
    long = _tokenized(df, unit, pairs).select(unit, F.explode(cells).alias("_c")).select(
        unit, "_c.kind", F.explode("_c.events").alias("_e")
    )
    return long.select(unit, "kind", "_e.grade", "_e.day").where("grade > 0")


def label_audit(df: DataFrame, unit: str, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Legacy, corrected and post-start labels per unit with the evidence behind them.

    Everything is an expression over the unit's own row, so nothing is shuffled.
    """
    all_values = F.flatten(F.array(*[F.col(f"_g_{kind}") for kind in pairs]))
    whole_cell = F.array(*[F.coalesce(F.expr(f"try_cast(`{g}` as double)"), F.lit(0.0)) for g, _ in pairs.values()])

    def named(kind: str):
        return lambda e: F.struct(F.lit(kind).alias("kind"), e["grade"].alias("grade"), e["day"].alias("day"))

    events = F.flatten(F.array(*[
        F.transform(_events(kind, g, d), named(kind)) for kind, (g, d) in pairs.items()
    ]))
    staged = _tokenized(df, unit, pairs).select(
        unit,
        F.coalesce(F.array_max(all_values), F.lit(0.0)).alias("max_grade"),
        F.array_max(whole_cell).alias("_legacy"),
        F.filter(events, lambda e: e["grade"] > 0).alias("_events"),
    )
    staged = staged.withColumn("_days", F.transform("_events", lambda e: e["day"]))
    staged = staged.withColumn("_post", F.filter("_days", lambda x: x > 0))
    return staged.select(
        unit,
        (F.col("_legacy") > 0).cast("int").alias("legacy_label"),
        (F.col("max_grade") > 0).cast("int").alias("corrected_label"),
        (F.size("_post") > 0).cast("int").alias("incident_label"),
        (F.size(F.filter("_days", lambda x: x <= 0)) > 0).alias("has_pre_event"),
        F.array_min("_days").alias("earliest_day"),
        F.array_min("_post").alias("earliest_post_day"),
        "max_grade",
        F.size("_events").alias("n_events"),
        F.to_json("_events").alias("event_detail"),
    )


def is_deceased(status: Column) -> Column:
    return F.coalesce(F.upper(status).contains("DECEASED"), F.lit(False)).cast("int")


# -------------------------------------------------------------------- JSON


def trailing_object(text: Column) -> Column:
    """The complete JSON object that ends the text, starting at the first '{' that works."""
    parts = F.split(text, r"\{")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: F.concat(F.lit("{"), F.array_join(F.slice(parts, i, F.size(parts)), "{")),
    )
    valid = F.filter(suffixes, lambda s: F.json_object_keys(s).isNotNull() & F.try_parse_json(s).isNotNull())
    return F.when(F.size(parts) > 1, F.regexp_replace(F.get(valid, F.lit(0)), r"\s+$", ""))


def strip_fences(text: Column) -> Column:
    bare = F.trim(text)
    opened = F.regexp_replace(bare, r"^```[a-zA-Z0-9_-]*\s*", "")
    closed = F.regexp_replace(opened, r"\s*```$", "")
    return F.trim(F.when(bare.startswith("```"), closed).otherwise(bare))


@F.pandas_udf(T.StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(text):
        if text is None:
            return None
        at = text.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(first)


def parse_response(df: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """JSON object text of a model answer, NULL if there is none.

    Answers that are plain or fenced JSON stay on the JVM; only the rest goes
    through the small scanner for an embedded object.
    """
    cleaned = df.withColumn("_clean", strip_fences(F.col(text)))
    cleaned = cleaned.withColumn("_kind", F.schema_of_variant(F.try_parse_json("_clean")))
    plain = F.col("_kind").isNotNull()
    # one scan: the scanner gets NULL for an answer that needs none
    embedded = cleaned.withColumn("_found", _first_object(F.when(~plain, F.col("_clean"))))
    direct = F.when(F.col("_kind").startswith("OBJECT"), F.col("_clean"))
    return embedded.withColumn(out, F.when(plain, direct).otherwise(F.col("_found"))).drop("_clean", "_kind", "_found")


TEXT_KEYS = ["program", "activity_level", "representative_genes"]
BLOCKS = ["evidence_balance", "ecology_snapshot", "calibration_snapshot", "dominant_programs"]


#: Levels opened in one job before the rest is looked at.
LEVELS = 4


def flatten_numeric(df: DataFrame, unit: str, payload: str, *, require: bool = False) -> DataFrame:
    """(unit, feature, value): numeric and boolean leaves of the feature blocks, at any depth.

    Paths are dotted; list items are keyed by their program; each leaf also gets
    a ``.__present`` indicator.  Where two leaves have one path, the later one
    counts: keys in order, list items as listed, blocks as named.  ``unit`` names one payload.
    A forbidden field inside a block or a number that is not finite is an error,
    with ``require`` also a payload without any leaf.
    """
    parsed = df.select(unit, F.parse_json(payload).alias("_p"))
    blocks = F.array(*[
        F.struct(F.lit(b).alias("path"), F.try_variant_get("_p", f"$.{b}", "variant").alias("v"), _place(F.lit(i), F.lit("")).alias("at"))
        for i, b in enumerate(BLOCKS)
    ])
    nodes = parsed.select(unit, F.explode(blocks).alias("_b")).select(unit, "_b.path", "_b.v", "_b.at").where("v IS NOT NULL")
    found = None
    while True:
        for _ in range(LEVELS):
            nodes = _open_containers(nodes, unit)
        nodes = settle(nodes.withColumn("kind", F.schema_of_variant("v")))
        inner = F.col("kind").rlike("^(OBJECT|ARRAY)")
        leaves = nodes.where(~inner)
        found = leaves if found is None else found.unionByName(leaves)
        nodes = nodes.where(inner).drop("kind")
        if nodes.isEmpty():
            break
    number = F.when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
    number = number.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("int").cast("double"))
    infinite = F.isnan("value") | (F.abs("value") == float("inf"))
    finite = F.when(infinite, F.raise_error(F.concat(F.lit("number that is not finite: "), "path"))).otherwise(F.col("value"))
    values = found.select(unit, "path", "at", number.alias("value")).where("value IS NOT NULL")
    both = F.array(
        F.struct(F.col("path").alias("feature"), finite.alias("value")),
        F.struct(F.concat("path", F.lit(".__present")).alias("feature"), F.lit(1.0).alias("value")),
    )
    out = values.select(unit, "at", F.explode(both).alias("_f")).groupBy(unit, F.col("_f.feature").alias("feature")).agg(
        F.max_by("_f.value", "at").alias("value")
    )
    if require and not df.join(out, unit, "left_anti").isEmpty():
        raise ValueError("a payload holds no numeric feature")
    return out


def _place(position: Column, key: Column) -> Column:
    return F.array(F.struct(position.cast("int").alias("pos"), key.alias("key")))


def _open_containers(nodes: DataFrame, unit: str) -> DataFrame:
    """Containers are replaced by their entries, leaves are carried along."""
    entries = nodes.lateralJoin(nodes.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    leaf, in_object = F.col("value").isNull(), F.col("key").isNotNull()
    program = F.try_variant_get("value", "$.program", "string")
    checked = F.when(
        F.col("key").isin(FORBIDDEN_FIELDS),
        F.raise_error(F.concat(F.lit("forbidden field in feature block: "), F.col("key"))),
    ).otherwise(F.concat("path", F.lit("."), F.col("key")))
    path = (
        F.when(leaf, F.col("path")).when(in_object, checked)
        .otherwise(F.concat("path", F.lit("["), program, F.lit("]")))
    )
    at = F.when(leaf, F.col("at")).otherwise(
        F.concat("at", _place(F.when(in_object, 0).otherwise(F.col("pos")), F.coalesce("key", F.lit(""))))
    )
    # an empty container has no entries and is no leaf
    empty = leaf & F.schema_of_variant(F.when(leaf, F.col("v"))).rlike("^(OBJECT|ARRAY)")
    keep = F.when(leaf, ~empty).when(in_object, ~F.col("key").isin(TEXT_KEYS)).otherwise(program.isNotNull())
    return entries.where(keep).select(
        unit, path.alias("path"), F.when(leaf, F.col("v")).otherwise(F.col("value")).alias("v"), at.alias("at")
    )


def request_audit(df: DataFrame, unit: str, payload: str) -> DataFrame:
    """Which identifier, cohort and outcome fields a request payload carries."""
    keys = F.json_object_keys(payload)
    has = lambda *names: F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))
    return df.select(
        unit,
        has("sample_id").alias("sample_id_in_payload"),
        has("dataset", "dataset_name").alias("cohort_in_payload"),
        has("duration", "survival_time", "event", "event_status", "true_label", "outcome", "label", "fold")
        .alias("outcome_field_in_payload"),
    )


def schema_violations(df: DataFrame, unit: str, parsed: str, numbers: Sequence[str],
                      enums: Mapping[str, Sequence[str]], arrays: Sequence[str]) -> DataFrame:
    """(unit, field, problem) for missing fields, wrong types and unknown enum values."""
    v = F.try_parse_json(F.col(parsed))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant"))
    checks = []
    for f in [*numbers, *enums, *arrays]:
        checks.append((f, F.try_variant_get("_v", f"$.{f}", "variant").isNull(), "missing"))
    for f in numbers:
        checks.append((f, ~kind(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "not a number"))
    for f, allowed in enums.items():
        checks.append((f, ~F.try_variant_get("_v", f"$.{f}", "string").isin(list(allowed)), "unknown value"))
    for f in arrays:
        checks.append((f, ~kind(f).startswith("ARRAY"), "not an array"))
    problems = F.filter(
        F.array(*[
            F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem")))
            for f, c, p in checks
        ]),
        lambda x: x.isNotNull(),
    )
    listed = df.withColumn("_v", v).select(unit, F.explode(problems).alias("_x"))
    return listed.select(unit, "_x.field", "_x.problem")
