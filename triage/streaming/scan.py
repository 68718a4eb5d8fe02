"""Incremental scans: a stream of files or rows, judged once each and added to the journal.

A micro-batch is the unit of commit: it is journaled whole or, after a crash,
judged again. Batches are written under their number, so a repeated one
replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage.operators.dedup import exact

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, root: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)


def journal_of(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/batch=*")


def run(stream: DataFrame, folder: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame], key: str = "path", digest: str = "sha256"):
    """Judges a stream's new keys and journals them with duplicate_of by digest, against the journal and the batch; returns the query.

    judge adds its columns to the rows of a batch that are no copies; copies
    take their original's when the journal is read (operators.dedup.copied).
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{folder}/batch={number}"
        try:
            done = spark.read.parquet(f"{folder}/batch=*").filter(~F.input_file_name().contains(f"/batch={number}/"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            done = None
        new = batch.dropDuplicates([key])
        if done is not None:
            new = new.join(done.select(key), key, "left_anti")
        marked = exact(new, digest, key)
        if done is not None:
            heads = done.filter("duplicate_of is null").groupBy(digest).agg(F.min(key).alias("__head"))
            marked = marked.join(heads, digest, "left").withColumn("duplicate_of", F.coalesce("__head", "duplicate_of")).drop("__head")
        judged = judge(marked.filter("duplicate_of is null"))
        copies = marked.filter("duplicate_of is not null")
        judged.unionByName(copies, allowMissingColumns=True).drop("content").write.mode("overwrite").parquet(own)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restart(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """Forgets a journal and its stream's state."""
    jvm = spark.sparkContext._jvm
    for x in (folder, checkpoint):
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
