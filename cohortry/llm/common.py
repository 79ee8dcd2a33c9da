"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space; the same class for Java, Python and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile("[^ \t-\r]+")
#: ASCII-only lower case, for ``str.translate``.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall(text) if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def id_remainder_py(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


SHARE_STEPS = 1_000_003


def hash_share(value: Column, wanted: int, n: int) -> Column:
    """Rows of the ``wanted`` of ``n`` whose hash is lowest: a fixed choice at any size, all rows while ``n`` is small.

    The remainder of the hash by ``SHARE_STEPS`` leads, 30 bits of its quotient follow, so shares far below one step
    still pick their rows.
    """
    h = F.xxhash64(value)
    rest = F.call_function("div", h, F.lit(SHARE_STEPS)).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    return F.pmod(h, F.lit(SHARE_STEPS)) + rest < F.lit(SHARE_STEPS * min(1.0, wanted / max(n, 1)))


def sampled(rows: list, n: int) -> list:
    """``rows``, the sample of ``n`` rows; an empty one of a table with rows is an error, not a model of nothing."""
    if n and not rows:
        raise ValueError(f"the sample of {n} rows is empty")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own; elsewhere it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. Survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done: it acts when the driver collects garbage,
    which a driver with little to do may not for a long time."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` are within ``limit``; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df
