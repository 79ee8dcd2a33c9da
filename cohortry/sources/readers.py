"""Reading cohort files with explicit types and contracts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.contracts import enforce, id_set_equal, unique_key


def wide_matrix(spark: SparkSession, path: str, unit: str, features: Sequence[str]) -> DataFrame:
    """Indexed CSV matrix as long rows: missing cells are 0, ids are strings and unique."""
    schema = ", ".join([f"`{unit}` string", *[f"`{f}` double" for f in features]])
    wide = spark.read.csv(path, header=True, schema=schema).fillna(0.0)
    enforce(unique_key(wide, [unit]))
    return wide.unpivot(unit, list(features), "feature", "value")


def aligned(long: DataFrame, labels: DataFrame, unit: str) -> DataFrame:
    """Features inner-aligned with their labels."""
    return long.join(labels, unit)


def labels(spark: SparkSession, path: str, types: Mapping[str, str]) -> DataFrame:
    """Label file with forced types; a value that does not cast is an error (ANSI casts)."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in types))
    return raw.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def commented_tsv(
    spark: SparkSession, path: str, columns: Sequence[str], header: bool = True
) -> DataFrame:
    """Tab-separated text with '#' comment lines, everything as strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="\t", comment="#", header=header, schema=schema)


def clinical_mapping(sources: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Heterogeneous clinical tables normalised to one layout; duplicate ids are an error."""
    layout = ("sample_id", "group_id", "treatment_time", "raw_response")
    out = None
    for frame, columns in sources:
        part = frame.select(*[columns[c].cast("string").alias(c) for c in layout])
        out = part if out is None else out.unionByName(part)
    enforce(unique_key(out, ["sample_id"]))
    return out


def embeddings(vectors: DataFrame, requested: DataFrame, unit: str, strict: bool = True) -> DataFrame:
    """Vectors for the requested ids in their declared positions; id sets must match."""
    if strict:
        enforce(id_set_equal(requested, vectors, [unit]))
    return requested.join(vectors, unit)


def per_sample_files(
    spark: SparkSession, path: str, column: str, pattern: str = r"([^/_]+)_[^/]*$", sep: str = "\t"
) -> DataFrame:
    """One file per sample: the id comes from the path, one column is read, empty strings stay."""
    raw = spark.read.option("emptyValue", "").csv(path, sep=sep, header=True, schema=f"`{column}` string")
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("sample_id"),
        F.coalesce(column, F.lit("")).alias(column),
    )


def jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One JSON document per line with an explicit schema; a repeated key is an error."""
    out = spark.read.schema(schema).json(path)
    enforce(unique_key(out, [key]))
    return out


def companion(predictions: DataFrame, summaries: DataFrame, path: str, value: str) -> DataFrame:
    """Sibling summary values joined by derived path; missing or bad values become NULL."""
    stem = lambda c: F.regexp_replace(c, r"_(predictions|summary)(\.\w+)?$", "")
    right = summaries.select(
        stem(F.col(path)).alias("_stem"), F.expr(f"try_cast(`{value}` as double)").alias("reference_value")
    )
    return predictions.withColumn("_stem", stem(F.col(path))).join(right, "_stem", "left").drop("_stem")


def _open_stream(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _open_stream(path) as source:
                while piece := source.read(PIECE_BYTES):
                    digest.update(piece)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])


#: Files up to so many bytes are read in one piece; larger ones are streamed in pieces.
WHOLE_BYTES = 64 << 20
PIECE_BYTES = 8 << 20


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, bytes, sha256) per file below ``path``, of any size; Spark's listing leaves out empty files.

    Sizes come from the listing.  Files up to ``whole_bytes`` are hashed by built-in functions, larger ones by a
    task each that holds ``PIECE_BYTES`` at a time; it opens them as local (shared) files or by their address.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(path)
    )
    size = F.col("length").alias("bytes")
    small = files.where(F.col("length") <= whole_bytes).select("path", size, F.sha2("content", 256).alias("sha256"))
    listed = files.where(F.col("length") > whole_bytes).select("path", size)
    count = listed.count()
    if not count:
        return small
    spread = listed.repartition(min(count, 10_000), "path")
    return small.unionByName(spread.mapInArrow(_streamed_digests, "path string, bytes bigint, sha256 string"))


def drop_identical(inventory: DataFrame, priority: Column) -> DataFrame:
    """Keep the first of content-identical files in (priority, path) order.

    The winner per hash is an aggregation, so a much-copied file cannot
    overload one task.
    """
    ranked = inventory.withColumn("_rank", F.struct(priority.alias("p"), "path"))
    first = ranked.groupBy("sha256").agg(F.min("_rank").alias("_first"))
    joined = ranked.join(first, "sha256")
    kept = F.col("_rank") == F.col("_first")
    return joined.select(
        "path", "bytes", "sha256",
        F.when(kept, "selected").otherwise("duplicate_identical_content").alias("status"),
        F.when(~kept, F.concat(F.lit("identical to "), F.col("_first.path"))).alias("reason"),
    )


# provider defaults (fixed values): text that selects the versioned name, names
_PROVIDERS = {
    "qwen": (r"qwen35|qwen3", "Qwen3.5-Plus", "qwen_unknown"),
    "kimi": (r"k26|k2\.6", "Kimi-K2.6", "kimi_unknown"),
    "minimax": (r"m27|m2\.7", "MiniMax-M2.7", "minimax_unknown"),
}


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def identity_from_path(df: DataFrame, path: str) -> DataFrame:
    """Provider, model, prompt version, run name and model id from a prediction path."""
    low = F.lower(path)
    provider, model = F.lit("unknown"), F.lit("unknown_model")
    for name in reversed(list(_PROVIDERS)):
        versioned, full, unknown = _PROVIDERS[name]
        provider = F.when(low.contains(name), name).otherwise(provider)
        model = F.when(low.contains(name), F.when(low.rlike(versioned), full).otherwise(unknown)).otherwise(model)
    digits = F.element_at(F.regexp_extract_all(low, F.lit(r"prompt[_-]?v(\d+)"), F.lit(1)), -1)
    digits = F.when(F.size(F.regexp_extract_all(low, F.lit(r"prompt[_-]?v(\d+)"), F.lit(1))) > 0, digits)
    dotted = F.concat(F.lit("v"), F.array_join(F.filter(F.split(digits, ""), lambda x: x != ""), "."))
    stem = F.regexp_replace(F.element_at(F.split(low, "/"), -1), r"\.[^.]*$", "")
    compact = F.regexp_extract(stem, r"(?:^|[_-])v(21|221)(?:[_-]|$)", 1)
    compact = F.when(compact == "21", "v2.1").when(compact == "221", "v2.2.1")
    version = F.when(digits == "21", "v2.1").when(digits == "221", "v2.2.1").otherwise(dotted)
    named = df.withColumns({
        "provider": provider, "model_name": model,
        "prompt_version": F.coalesce(version, compact),
        "run_name": F.element_at(F.split(path, "/"), -2),
    })
    model_id = F.concat(
        F.lit("fixed__"),
        F.concat_ws("__", "provider", slug(F.col("model_name")), "prompt_version", slug(F.col("run_name"))),
    )
    return named.withColumn("model_id", model_id)


def annotate_features(df: DataFrame, annotations: DataFrame, feature: str = "feature_id") -> DataFrame:
    """Positional feature ids (with or without the ``gene_`` prefix) to symbols."""
    position = F.regexp_replace(F.col(feature), "^gene_", "")
    dim = annotations.select(
        F.col("position").cast("string").alias("_pos"), "symbol", F.upper(F.trim("symbol")).alias("normalized_symbol")
    )
    return df.withColumn("_pos", position).join(dim, "_pos", "left").drop("_pos")
