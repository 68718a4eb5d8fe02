"""Pieces shared by the operators: words, shared scratch tables, salted joins."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_scratch: set[str] = set()


def release() -> None:
    """Give a Python worker's free memory back: idle workers stay beside the JVM until the executor ends."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on a session that hasn't set it sends Python batches of 4 MB; those of 10,000 texts are held twice by each task, here and in the JVM."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "4m")


def words(text: Column | str) -> Column:
    """Array of words of a text (null: none), on the JVM side."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda variable isn't inlined again."""
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only where none is set (tests) a folder of our own."""
    set_by = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_by:
        set_by = spark.conf.get("triage.scratch.dir", None)
        if not set_by:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            set_by = "file://" + tempfile.mkdtemp(prefix="triage-")
            spark.conf.set("triage.scratch.dir", set_by)
    return set_by.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared folder, deleted when the driver ends."""
    if not _scratch:
        atexit.register(_forget_all)
    path = f"{checkpoint_dir(spark)}/triage/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _scratch.add(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, a lost executor costs nothing already written."""
    path = scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._triage_path = path
    return out


def drop(spark: SparkSession, *frames) -> None:
    """Delete stored() tables (or paths) that no later step reads."""
    for x in frames:
        path = x if isinstance(x, str) else getattr(x, "_triage_path", None)
        if path:
            _delete(spark, path)
            _scratch.discard(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 the session may be gone already
            pass
    _scratch.clear()


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, n_salts: int = 32) -> DataFrame:
    """Left join of big with one row a key of small, null keys equal to each other.

    Each key of big is dealt to n_salts groups and each row of small is repeated
    for them, so that a key with a third of all rows isn't one task's work.
    """
    left = big.withColumn("__salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__salt").alias("__r_salt"), *[c for c in small.columns if c not in keys])
    on = F.col("__salt") == F.col("__r_salt")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, on, "left").drop("__salt", "__r_salt", *[f"__r_{k}" for k in keys])
