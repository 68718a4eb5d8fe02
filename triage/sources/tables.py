"""Readers and writers of the engine's tables: results, journal, score cache, reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage import config

RESULTS = "filename string, contains_logo boolean, band string, confidence double, x int, y int, w int, h int, method string, duplicate_of string, error string"
JOURNAL = "path string, sha256 string, dhash string, band string, confidence double, bbox array<int>, method string, duplicate_of string, error string, ts double"
CACHE = "format int, signals array<string>, images array<struct<filename:string,label:string,scores:map<string,double>>>"
CACHE_FORMAT = 1


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV; blank numbers are null, blank texts empty, a missing duplicate_of column too."""
    raw = spark.read.option("header", True).csv(path)
    fields = [x.strip().split(" ") for x in RESULTS.split(",")]
    out = []
    for name, kind in fields:
        c = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        c = F.coalesce(c, F.lit("")) if kind == "string" else F.expr(f"try_cast(nullif(trim(`{name}`), '') as {kind})") if name in raw.columns else c.cast(kind)
        out.append(c.alias(name))
    return raw.select(*out)


def write_results(rows: DataFrame, path: str) -> None:
    """Rows as CSV with the canonical header, confidence to four digits, one sorted part."""
    text = rows.select(*[F.format_string("%.4f", "confidence").alias("confidence") if c == "confidence" else F.col(c) for c, _ in (x.strip().split(" ") for x in RESULTS.split(","))])
    text.coalesce(1).sortWithinPartitions("filename").write.mode("overwrite").option("header", True).csv(path)


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("coalesce(error, '') <> ''").select("filename", "error")


def write_errors(rows: DataFrame, path: str) -> None:
    """filename, error of failed rows; the header alone if there are none."""
    errors(rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def journal_lines(lines: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """Journal entries of JSON lines: torn, blank and pathless lines are dropped, defaults filled, the last line of a path wins."""
    entry = lines.select(F.from_json(value, JOURNAL).alias("e"), F.col(seq).alias("seq")).filter("e.path is not null and e.path <> ''")
    last = entry.groupBy(F.col("e.path").alias("path")).agg(F.max_by("e", "seq").alias("e"))
    text = [F.coalesce(f"e.{c}", F.lit(d)).alias(c) for c, d in (("sha256", ""), ("dhash", ""), ("band", "negative"))]
    rest = [F.coalesce(f"e.{c}", F.lit(d)).alias(c) for c, d in (("method", "none"), ("duplicate_of", ""), ("error", ""), ("ts", 0.0))]
    return last.select("path", *text, F.coalesce("e.confidence", F.lit(0.0)).alias("confidence"), F.col("e.bbox").alias("bbox"), *rest)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal of JSON line files; lines stand in the order of their files' times, their batches and their places."""
    batch = F.coalesce(F.get_json_object("value", "$.batch").cast("long"), F.lit(0))
    seq = F.struct(F.col("_metadata.file_modification_time").alias("t"), batch.alias("n"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", seq.alias("seq"))
    return journal_lines(lines)


def append_journal(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines, confidence to four digits; files become visible together when the job commits.

    Each carries its batch, the time of the append, for files that are written in one tick of the store's clock.
    """
    entries.withColumn("confidence", F.round("confidence", 4)).withColumn("batch", F.lit(time.time_ns())).write.mode("append").json(path)


def entry_rows(journal: DataFrame) -> DataFrame:
    """Journal entries as result rows."""
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    return journal.select(F.col("path").alias("filename"), (F.col("band") == "positive").alias("contains_logo"), "band", F.round("confidence", 4).alias("confidence"), *box, "method", "duplicate_of", "error")


def error_entries(failed: DataFrame, path: str = "path", reason: str = "reason") -> DataFrame:
    """A failure is an entry: negative, method none, its reason."""
    return failed.select(F.col(path).alias("path"), F.lit("negative").alias("band"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method"), F.lit("").alias("duplicate_of"), F.col(reason).alias("error"))


def pending(files: DataFrame, journal: DataFrame, retry_errors: bool = False, key: str = "path") -> DataFrame:
    """Files that the journal doesn't have; failed ones count as had unless retry_errors."""
    known = journal.filter("error = ''") if retry_errors else journal
    return files.join(known.select(key), key, "left_anti")


def read_cache(spark: SparkSession, path: str, signals: list[str]) -> DataFrame:
    """Scored items of a cache file, none if its format or signals differ or it is no JSON; rows that lack a score are skipped."""
    raw = spark.read.schema(CACHE).json(path)
    if not raw.filter("format is not null").limit(1).count():  # one document over many lines
        raw = spark.read.schema(CACHE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    fits = raw.filter((F.col("format") == CACHE_FORMAT) & (F.col("signals") == F.array(*[F.lit(s) for s in signals])))
    rows = fits.select(F.inline("images"))
    for s in signals:
        rows = rows.filter(F.col("scores").getItem(s).isNotNull())
    return rows.filter("filename is not null")


def write_cache(rows: DataFrame, path: str, signals: list[str]) -> None:
    """Scored items (filename, label, scores) by filename, scores to six digits; each is a line, a cache of one image."""
    rounded = rows.select("filename", "label", F.transform_values("scores", lambda _, v: F.round(v, 6)).alias("scores"))
    line = F.struct(F.lit(CACHE_FORMAT).alias("format"), F.array(*[F.lit(s) for s in signals]).alias("signals"), F.array(F.struct("filename", "label", "scores")).alias("images"))
    rounded.orderBy("filename").select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)


def reuse(found: DataFrame, cached: DataFrame) -> DataFrame:
    """Found files (filename, label) with their cached scores, null where they have to be scored; the label is the file's."""
    return found.join(cached.select("filename", "scores"), "filename", "left")


def summary(rows: DataFrame, processed: int, skipped: int, seconds: float) -> DataFrame:
    """One row for a report: counts by band (zero-filled), copies, errors, rate and the time that 10,000 items take."""
    rate = processed / seconds if seconds else 0.0
    return rows.agg(
        F.count(F.lit(1)).alias("images"),
        *[F.count_if(F.col("band") == b).alias(b) for b in config.BANDS],
        F.count_if(F.coalesce("duplicate_of", F.lit("")) != "").alias("duplicates"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"),
    ).select(
        "*",
        F.lit(processed).cast("long").alias("processed"),
        F.lit(skipped).cast("long").alias("skipped"),
        F.lit(round(seconds, 3)).alias("seconds"),
        F.lit(round(rate, 3)).alias("images_per_second"),
        (F.lit(round(10000 / rate, 1)) if rate else F.lit(None).cast("double")).alias("eta_10k_seconds"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("filename")


def limited(files: DataFrame, n: int, label: str | None = None) -> DataFrame:
    """The first n files in path order, of each label if one is named."""
    if label is None:
        return files.orderBy("path").limit(n)
    w = Window.partitionBy(label).orderBy("path")
    return files.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
