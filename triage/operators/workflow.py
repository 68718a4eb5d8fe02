"""Audit samples, label repair and choice of originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.functions.hashing import hamming
from triage.functions.scores import wilson

#: Better formats first, all others last.
FORMAT_RANK = {"png": 0, "jpg": 0, "jpeg": 0, "tif": 1, "tiff": 1, "bmp": 1, "gif": 2, "webp": 3, "avif": 4}


def flat_name(path: Column) -> Column:
    """parent__name of a path, the bare name without a parent."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -2), F.lit("__"), F.element_at(parts, -1))).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def eligible(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to audit: negative, no copies, no errors, and not labelled under their base or flat name."""
    rows = results.filter("band = 'negative' and coalesce(duplicate_of, '') = '' and coalesce(error, '') = ''")
    known = labels.select(F.col("filename").alias("__l")).distinct()
    rows = rows.join(known, base_name(F.col("filename")) == F.col("__l"), "left_anti")
    return rows.join(known, flat_name(F.col("filename")) == F.col("__l"), "left_anti")


def near_misses(pool: DataFrame, k: int) -> DataFrame:
    return pool.orderBy(F.desc("confidence"), "filename").limit(k)


def sample(pool: DataFrame, k: int, seed: int, key: str = "filename") -> DataFrame:
    """k rows drawn by a seeded hash of their key: the same on every run and partitioning."""
    return pool.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def audit_report(manifest: DataFrame, found: DataFrame, pool: int, negatives: int, known_misses: int, confirmed: int, reviewed: int | None = None) -> DataFrame:
    """One row: hits in the sample, miss rate with Wilson's interval, both over the pool, and recall.

    A sample that isn't random has no rate: its rate columns are null.
    """
    hit = manifest.join(found.select(F.col("sample_name")).distinct(), "sample_name", "left_semi").count()
    unknown = found.join(manifest, "sample_name", "left_anti").count()
    one = manifest.agg(F.count(F.lit(1)).alias("sample"), F.coalesce(F.bool_and(F.col("mode") == "random"), F.lit(False)).alias("random"))
    one = one.select("*", F.lit(hit).cast("long").alias("hits"), F.lit(unknown).cast("long").alias("unknown"), F.lit(pool).cast("long").alias("pool"), F.lit(negatives).cast("long").alias("negatives"))
    n = F.col("sample") if reviewed is None else F.lit(reviewed)
    rate = F.when(F.col("random"), F.try_divide(F.col("hits").cast("double"), n))
    ci = wilson(F.col("hits"), n)
    missed = rate * F.col("pool")
    recall = F.try_divide(F.lit(float(confirmed)), F.lit(float(confirmed)) + missed + F.lit(float(known_misses)))
    low, high = (F.when(F.col("random"), ci[k]) for k in ("low", "high"))
    return one.select("*", rate.alias("miss_rate"), low.alias("low"), high.alias("high"), missed.alias("missed"), (low * F.col("pool")).alias("missed_low"), (high * F.col("pool")).alias("missed_high"), recall.alias("recall"))


# -- labels from crops ----------------------------------------------------


def is_crop(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "").rlike("_crop$")


def crop_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.[^.]*$", ""), "_crop$", "")


def head_of(results_name: str = "filename") -> Column:
    return F.coalesce(F.nullif(F.col("duplicate_of"), F.lit("")), F.col(results_name))


def crop_targets(crops: DataFrame, results: DataFrame) -> DataFrame:
    """Crops (crop, label, dhash) with their original: of several results of one stem the one whose own crop hashes closest.

    results: filename, duplicate_of, x (of its box) and crop_hash, the hash of
    its regenerated crop. One picture, with its copies, is the target without a
    look at it; of several only those with a box and a hash can be, and where
    none has the target is null.
    """
    own = F.when(F.col("x").isNotNull(), F.col("crop_hash")).alias("crop_hash")
    stems = results.select(F.regexp_replace(base_name(F.col("filename")), r"\.[^.]*$", "").alias("stem"), head_of().alias("target"), own).distinct()
    met = crops.filter(is_crop(F.col("crop"))).withColumn("stem", crop_stem(F.col("crop"))).join(stems, "stem")
    far = hamming(F.col("dhash"), F.col("crop_hash"))
    seen = met.groupBy("crop", "label").agg(F.count_distinct("target").alias("candidates"), F.min("target").alias("__only"), F.min(F.when(far.isNotNull(), F.struct(far.alias("bits"), F.col("target")))).alias("__b"))
    reason = F.when(F.col("candidates") == 1, "single picture").when(F.col("__b").isNotNull(), F.format_string("matched by content (%d bits)", "__b.bits")).otherwise("no candidate could be re-cropped")
    return seen.select("crop", "label", F.when(F.col("candidates") == 1, F.col("__only")).otherwise(F.col("__b.target")).alias("target"), "candidates", reason.alias("reason"))


def conflicts(targets: DataFrame) -> DataFrame:
    """Targets that crops label both ways."""
    return targets.groupBy("target").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")


def disagreements(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """Targets whose crops say other than their label."""
    known = labels.select(F.col("filename").alias("__l"), F.col("label").alias("existing"))
    return targets.join(known, base_name(F.col("target")) == F.col("__l")).filter("label <> existing").select("target", "label", "existing")


# -- choice of originals --------------------------------------------------


def classified(files: DataFrame) -> DataFrame:
    """Upload names (path, period, name_stem, ext, size) as stem, kind (0 original, 1 scaled, 2 sized), area; back-ups and other files go."""
    sized = r"^(.+)-(\d{1,5})x(\d{1,5})$"
    is_sized = F.col("name_stem").rlike(sized)
    bare = F.when(is_sized, F.regexp_extract("name_stem", sized, 1)).otherwise(F.col("name_stem"))
    scaled = bare.rlike("(?i)^.+-scaled$")
    area = F.when(is_sized, F.regexp_extract("name_stem", sized, 2).cast("long") * F.regexp_extract("name_stem", sized, 3).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = files.filter(F.col("ext").isin(*FORMAT_RANK) & ~F.lower("name_stem").endswith(".bak"))
    return rows.withColumn("stem", F.when(scaled, F.regexp_replace(bare, "(?i)-scaled$", "")).otherwise(bare)).withColumn("kind", F.when(scaled, 1).when(area > 0, 2).otherwise(0)).withColumn("area", area)


def best_variants(files: DataFrame) -> DataFrame:
    """Of each period and stem the best file, why, and how many variants it leaves.

    The best is an arg-min over one struct, summed on the map side.
    """
    rank = F.create_map(*[F.lit(x) for k, v in FORMAT_RANK.items() for x in (k, v)])
    order = F.struct("kind", (-F.col("area")).alias("a"), F.coalesce(F.try_element_at(rank, F.col("ext")), F.lit(9)).alias("f"), (-F.col("size")).alias("s"), F.col("path").alias("path"))
    best = classified(files).groupBy("period", "stem").agg(F.min(order).alias("b"), (F.count(F.lit(1)) - 1).alias("variants_ignored"))
    reason = F.when(F.col("b.kind") == 0, "original").when(F.col("b.kind") == 1, "scaled").otherwise("largest-variant")
    return best.select("period", "stem", F.col("b.path").alias("path"), reason.alias("reason"), "variants_ignored")


def fitted(folder: Column, name: Column, limit: int = 255) -> Column:
    """A name that fits under a path limit: cut, with a tag of its hash and its suffix kept."""
    room = F.lit(limit) - F.length(folder) - 1
    suffix = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    tag = F.concat(F.lit("~"), F.substring(F.sha1(name.cast("binary")), 1, 6), suffix)
    return F.when(F.length(name) <= room, name).otherwise(F.concat(F.substring(name, F.lit(1), F.greatest(F.lit(1), room - F.length(tag))), tag))


def class_sizes(files: DataFrame, label: str = "label", size: str = "size") -> DataFrame:
    """Per class: files, their share of all, megabytes (of 1,000,000), and least, upper-median and largest kilobytes (of 1,000).

    The median is found by rank in a running count of distinct sizes, so no class is gathered.
    """
    hist = files.groupBy(label, size).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(label).orderBy(size)
    run = hist.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(label)))
    kb = F.col(size) / 1000.0
    out = run.groupBy(label).agg(
        F.sum("n").alias("files"),
        F.round(F.sum(F.col(size) * F.col("n")) / 1e6, 3).alias("total_mb"),
        F.round(F.min(kb), 3).alias("min_kb"),
        F.round(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), kb)), 3).alias("median_kb"),
        F.round(F.max(kb), 3).alias("max_kb"),
    )
    everything = F.sum("files").over(Window.partitionBy())  # a row for each class
    return out.withColumn("share", F.round(F.col("files") / everything, 4))
