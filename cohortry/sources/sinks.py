"""Publishing tables without overwriting, manifests, digests and resuming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.lineage import settle
from ..operators.ordered import join_null_safe


def publish_new(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write a complete table, or refuse (False) if the path exists."""
    try:
        df.write.mode("errorifexists").format(fmt).save(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            return False
        raise
    return True


def ordered_digest(df: DataFrame, keys: Sequence[str], position: str, value: Column, chunk_rows: int = 100_000) -> DataFrame:
    """SHA-256 of newline-joined values in order, per key: ``digest`` and row count ``n``.

    A group of up to ``chunk_rows`` rows has the plain digest.  A larger one has a digest tree: its ordered rows are
    cut into chunks of that many, and the chunks' plain digests are the values of the next level, until one chunk is
    left.  No task holds more than one chunk of a group.  Rows of one position are ordered by value, NULLs first.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(position).alias("_p"), value.cast("string").alias("_v"))
    sized = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_rows))
    total = sized.agg(F.sum("_n")).first()[0]
    if not total:
        return _plain_digest(rows, keys)
    small = join_null_safe(rows, sized, keys, "left").where("_n IS NULL").drop("_n")
    large = join_null_safe(rows, sized, keys).withColumn("_of", F.expr(f"(_n + {chunk_rows - 1}) div {chunk_rows}"))
    chunks = _numbered(large.drop("_n"), keys, -(-total // chunk_rows))
    # _of counts the chunks of the row's group on this level, so each group ends on a level of its own
    part = [*keys, "_chunk", "_of"]
    level = _plain_digest(chunks.withColumn("_chunk", F.expr(f"_rank div {chunk_rows}")), part)
    out = _plain_digest(small, keys)
    while True:
        level = settle(level)
        out = out.unionByName(level.where("_of = 1").select(*keys, "digest", "n"))
        level = level.where("_of > 1")
        if level.isEmpty():
            return out
        up = level.select(
            *keys, F.col("_chunk").alias("_p"), F.col("digest").alias("_v"), "n",
            F.expr(f"_chunk div {chunk_rows}").alias("_chunk"), F.expr(f"(_of + {chunk_rows - 1}) div {chunk_rows}").alias("_of"),
        )
        level = _plain_digest(up, part, F.sum("n"))


def _plain_digest(rows: DataFrame, keys: Sequence[str], count: Column | None = None) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    joined = F.array_join(F.transform(listed, lambda x: x["_v"]), "\n")
    n = F.count(F.lit(1)) if count is None else count
    return rows.groupBy(*keys).agg(F.sha2(joined, 256).alias("digest"), n.cast("bigint").alias("n"))


def _numbered(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``_rank`` from 0 per key along (_p, _v): range partitions are numbered inside, their sizes carry the offsets."""
    order = [*keys, "_p", "_v"]
    ranged = settle(rows.repartitionByRange(parts, *order).withColumn("_task", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_task").orderBy("_p", "_v")
    before = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    sizes = ranged.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select(*keys, "_task", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    local = ranged.withColumn("_local", F.row_number().over(inside) - 1)
    return join_null_safe(local, offsets, [*keys, "_task"]).withColumn("_rank", F.col("_offset") + F.col("_local"))


def pending(planned: DataFrame, completed: DataFrame, keys: Sequence[str], digest: str | None = None) -> DataFrame:
    """Planned keys without a completed checkpoint; with ``digest`` it must also match."""
    on = [*keys, digest] if digest else list(keys)
    return planned.join(completed.select(*on), on, "left_anti")


def drift(stored: DataFrame, current: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """Files whose stored and current hashes differ, in either direction."""
    a = stored.select(key, F.col(digest).alias("stored_hash"))
    b = current.select(key, F.col(digest).alias("current_hash"))
    return a.join(b, key, "full").where("NOT (stored_hash <=> current_hash)")


def export_documents(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """JSON lines with a stable column order."""
    df.select(*columns).write.mode("errorifexists").json(path)
