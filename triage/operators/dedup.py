"""Exact and near duplicates of items, resolved as one pass over them in order would."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import config
from triage.functions.hashing import degenerate, hamming, meeting_keys


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one a local run gets a folder of its own; a cluster's machines would not see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("triage.cut.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="triage-")
        spark.conf.set("triage.cut.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read again, so that rounds don't pile up lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exact(items: DataFrame, key: str, order: str) -> DataFrame:
    """Adds duplicate_of: the first item, by order, with the same key; null for first ones and null keys.

    The first is a grouped minimum, summed on the map side, and joins back:
    a key of many items isn't one task's sort.
    """
    first = items.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__first"))
    joined = items.join(first, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("duplicate_of", F.when(F.col("__first") < F.col(order), F.col("__first"))).drop("__k", "__first")


def near_pairs(items: DataFrame, item: str, hash_: str, budget: int = config.DHASH_BUDGET, every: bool = False) -> DataFrame:
    """(h1, h2, distance), h1 < h2, of the distinct hashes that differ in at most budget bits.

    Equal hashes are one class and paired by it; unequal ones meet at a key of
    meeting_keys. Degenerate hashes pair with nothing, unless every hash counts.
    """
    usable = F.col(hash_).isNotNull() if every else F.col(hash_).isNotNull() & ~degenerate(F.col(hash_))
    classes = items.filter(usable).select(F.col(hash_).alias("h")).distinct()
    left, right = meeting_keys(F.col("h"), budget)
    x = classes.select(F.col("h").alias("h1"), F.explode(left).alias("p1"))
    y = classes.select(F.col("h").alias("h2"), F.explode(right).alias("p2"))
    # Hashed, not sorted: a key's pairs are many and cheap to test.
    met = x.join(y.hint("shuffle_hash"), (F.col("p1") == F.col("p2")) & (F.col("h1") < F.col("h2")) & (hamming(F.col("h1"), F.col("h2")) <= budget))
    return met.select("h1", "h2").distinct().select("h1", "h2", hamming(F.col("h1"), F.col("h2")).alias("distance"))


def greedy(items: DataFrame, item: str, hash_: str, budget: int = config.DHASH_BUDGET) -> DataFrame:
    """Adds duplicate_of as a pass in order of item finds it: the closest earlier original within budget, of equals the first.

    Copies are never originals, so this is no closure. Items of one hash stand
    and fall together after their first, and rounds over the classes settle
    every class whose earlier neighbours are settled; a few rounds suffice.
    """
    spark = items.sparkSession
    usable = items.filter(F.col(hash_).isNotNull() & ~degenerate(F.col(hash_)))
    classes = usable.groupBy(F.col(hash_).alias("h")).agg(F.min(item).alias("first"))
    pairs = near_pairs(items, item, hash_, budget)
    firsts = classes.select("h", "first")
    edges = pairs.join(firsts.withColumnsRenamed({"h": "h1", "first": "f1"}), "h1").join(firsts.withColumnsRenamed({"h": "h2", "first": "f2"}), "h2")
    one, two = ([F.col(h).alias("h"), F.col(g).alias("g"), F.col(gf).alias("gf")] for h, g, gf in (("h2", "h1", "f1"), ("h1", "h2", "f2")))
    later = F.when(F.col("f1") < F.col("f2"), F.struct(*one)).otherwise(F.struct(*two))
    edges = cut(edges.select(later.alias("e"), "distance").select("e.h", "e.g", "e.gf", "distance"))
    state = cut(edges.select("h").unionByName(edges.select(F.col("g").alias("h"))).distinct().withColumn("original", F.lit(None).cast("boolean")))
    while True:
        seen = edges.join(state.withColumnsRenamed({"h": "g", "original": "g_original"}), "g")
        told = seen.groupBy("h").agg(F.max(F.coalesce("g_original", F.lit(False))).alias("beaten"), F.max(F.col("g_original").isNull()).alias("waits"))
        joined = state.join(told, "h", "left")
        now = F.coalesce(F.col("original"), F.when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True)))
        new = cut(joined.select("h", now.alias("original")))
        left = new.filter("original is null").count()
        state = new
        if not left:
            break
    # A copied class's items each copy the closest original before them, which may come after the class's first.
    heads = state.filter("original").select(F.col("h").alias("g"))
    back = classes.withColumnsRenamed({"h": "g", "first": "gf"})
    both = edges.select("h", "g", "distance").unionByName(edges.select(F.col("g").alias("h"), F.col("h").alias("g"), "distance"))
    near = both.join(heads, "g").join(back, "g").join(state.filter("not original").select("h"), "h", "left_semi")
    rows = items.select(F.col(item).alias("__i"), F.col(hash_).alias("h"))
    closest = rows.join(near, "h").filter(F.col("gf") < F.col("__i")).groupBy("__i").agg(F.min_by("gf", F.struct("distance", "gf")).alias("near"))
    decided = classes.select(F.col("h").alias("__h"), F.col("first").alias("__first"))
    out = items.join(decided, F.col(hash_) == F.col("__h"), "left").join(closest, F.col(item) == F.col("__i"), "left")
    # A later item of an original's hash is its copy at distance 0.
    verdict = F.coalesce("near", F.when(F.col("__first") < F.col(item), F.col("__first")))
    return out.withColumn("duplicate_of", verdict).drop("__h", "__first", "__i", "near")


def copied(items: DataFrame, verdicts: DataFrame, item: str) -> DataFrame:
    """Items with their own verdict, or their original's: duplicate_of names the head, never a copy."""
    heads = verdicts.select(F.col(item).alias("__head"), *[F.col(c) for c in verdicts.columns if c not in (item, "duplicate_of")])
    return items.join(heads, F.coalesce("duplicate_of", item) == F.col("__head"), "left").drop("__head")


def originals(journal: DataFrame) -> DataFrame:
    """Rows that may be found again: no errors, no copies."""
    return journal.filter("coalesce(error, '') = '' and coalesce(duplicate_of, '') = ''")


def first_by_digest(files: DataFrame, digest: str, *order: str) -> DataFrame:
    """Adds note 'duplicate-of:<first>' to all but the first file, in order, of equal bytes."""
    first = files.groupBy(F.col(digest).alias("__k")).agg(F.min(F.struct(*order, "path"))["path"].alias("__first"))
    joined = files.join(first, F.col(digest) == F.col("__k"), "left")
    note = F.when(F.col("__first") != F.col("path"), F.concat(F.lit("duplicate-of:"), "__first")).otherwise("")
    return joined.withColumn("note", note).drop("__k", "__first")
