"""Incremental decisions: the first answer to each request is parsed, decided and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import formulas as fm
from ..operators.textjson import strip_fences

ANSWER_SCHEMA = "sample_id string, content string"


def decide_stream(answers: DataFrame) -> DataFrame:
    """Row-wise: works the same on a stream and on a batch."""
    parsed = answers.withColumn("_j", F.from_json(strip_fences(F.col("content")), "risk_score double"))
    scored = parsed.select("sample_id", F.coalesce("_j.risk_score", F.lit(0.5)).alias("raw"))
    return fm.with_formulas(scored, fm.risk_decision("raw")).select(
        "sample_id", "risk_group", "risk_score", "confidence"
    )


def append_decisions(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Consume all files present under ``source`` once and append one decision a request to ``sink``.

    The checkpoint remembers the files and, as keyed state, the requests answered so far: a later call takes only
    new files, and an answer to a request that has one is dropped, also after a restart.  Of several answers that
    arrive together one stays.  Answers without an id count as one request.
    """
    answers = spark.readStream.schema(ANSWER_SCHEMA).json(source).dropDuplicates(["sample_id"])
    stream = (
        decide_stream(answers).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    )
    stream.awaitTermination()


def progress(decided: DataFrame, requests: DataFrame) -> DataFrame:
    """done / total of a scoring run."""
    done = decided.agg(F.count_distinct("sample_id").alias("completed"))
    total = requests.agg(F.count(F.lit(1)).alias("n")).scalar()
    return done.withColumn("total", total).withColumn(
        "fraction", F.round(F.col("completed") / F.col("total"), 4)
    )
