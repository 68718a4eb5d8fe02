"""Operator 5: quality rules with adaptive thresholds from mergeable quantile sketches.

A sketch counts the values of a metric in buckets whose bounds grow by a fixed
ratio (a log-bucket quantile sketch): counts of equal buckets add up, so
sketches of any parts of the data merge exactly, in any order, and a quantile
is known to a relative error of ALPHA. There is one sketch for each language,
source and metric; merged over the sources it is the language's, merged over
all it is the corpus's. A group's quartiles are drawn toward those of the next
wider sketch, as if SHRINK documents of it had been seen beside its own: a group
of few documents is judged mostly by its language, a large one by itself, and
no size switches from one to the other. Thresholds are outer fences of the
quartiles, never less than a floor, so a group of clean documents loses none for
being its group's tail.

All of it is DataFrame functions; nothing is shuffled but counts and one
slim row a document.

Defined results: null or empty text has no words, fails the base rule and is
not kept; null language or source is a group of its own; equal rows are judged
alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.llm.common import let, salted_join, stored, words

#: Relative error of a quantile, and the ratio of neighbouring bucket bounds.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Documents of the wider sketch that count beside a group's own.
SHRINK = 30.0
#: Per metric: fence width in quartile ranges, and the slack that a fence has at least.
FENCES = {"symbol_ratio": (6.0, 0.05), "dup_line_ratio": (6.0, 0.40), "stutter_ratio": (6.0, 0.25), "mean_word": (6.0, 2.0)}
#: Most rows of a thresholds table that is broadcast; beyond it the join is salted.
BROADCAST_GROUPS = 20_000
WINDOW = 5


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(pairs, lambda p: F.filter(p, lambda x, j: (x["x"] == F.get(p, j - 1)["x"]) | (x["x"] == F.get(p, j + 1)["x"])))
        where = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(where, lambda q: F.transform(q, lambda x, j: F.coalesce(F.least(F.get(q, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The base columns of every document, from its whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(*keep, words(F.col("text")).alias("__w"), lines.alias("__l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"))
    out = out.select(
        *keep,
        "n_symbols",
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        let(F.col("__w"), lambda w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1)))).cast("bigint").alias("n_stutter"),
        F.size("__l").cast("bigint").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        let(F.transform("__w", lambda x: F.xxhash64(x)), lambda h: repeated_words(h, F.size(h))).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def metrics() -> dict[str, Column]:
    """The adaptive rules' metrics; null where a document has no words."""

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b))

    return {
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "stutter_ratio": ratio("n_stutter", "n_words"),
        "mean_word": ratio("word_chars", "n_words"),
    }


def bucket_of(value: Column) -> Column:
    """0 for 0; else the number, from 1, of the bucket that holds the value (values under 1e-6 share one)."""
    return F.when(value <= 0, 0).otherwise(F.greatest(F.lit(1), (F.ceil(F.ln(value / 1e-6) / F.ln(F.lit(GAMMA))) + 1).cast("int")))


def value_of(bucket: Column) -> Column:
    return F.when(bucket == 0, 0.0).otherwise(F.lit(1e-6) * F.pow(F.lit(GAMMA), bucket - 1) * F.lit(2 / (1 + GAMMA)))


def sketch(measured: DataFrame) -> DataFrame:
    """Sketch rows: lang, source, metric, bucket, n."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket_of(v).alias("bucket")) for k, v in metrics().items()])
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("__m")).select("lang", "source", "__m.metric", "__m.bucket")
    return rows.filter("bucket is not null").groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merges sketches to groups by `by`: docs and the quartiles of each metric."""
    merged = sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("docs", F.sum("n").over(w))

    def quantile(q: float) -> Column:
        return value_of(F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("bucket"))))

    return ranked.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))


def thresholds(sketches: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """A row for each language and source: low_<metric> and high_<metric>."""
    group = quartiles(sketches, ["lang", "source"])
    lang = quartiles(sketches, ["lang"]).withColumnsRenamed({"docs": "l_docs", "q1": "l_q1", "q3": "l_q3", "lang": "l_lang", "metric": "l_metric"})
    every = quartiles(sketches, []).withColumnsRenamed({"q1": "e_q1", "q3": "e_q3", "metric": "e_metric"}).drop("docs")
    all_three = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric"))).join(every, F.col("metric") == F.col("e_metric"))

    def pick(q: str) -> Column:
        wider = (F.col("l_docs") * F.col(f"l_{q}") + F.lit(shrink) * F.col(f"e_{q}")) / (F.col("l_docs") + F.lit(shrink))
        return (F.col("docs") * F.col(q) + F.lit(shrink) * wider) / (F.col("docs") + F.lit(shrink))

    width = F.create_map(*[F.lit(x) for k, v in FENCES.items() for x in (k, v[0])])
    slack = F.create_map(*[F.lit(x) for k, v in FENCES.items() for x in (k, v[1])])
    reach = F.greatest(width[F.col("metric")] * (pick("q3") - pick("q1")), slack[F.col("metric")])
    fenced = all_three.select("lang", "source", "metric", (pick("q1") - reach).alias("low"), (pick("q3") + reach).alias("high"))
    return fenced.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.col(b))).alias(f"{b}_{k}") for k in FENCES for b in ("low", "high")])


def judge(measured: DataFrame, fences: DataFrame, small: bool = False) -> DataFrame:
    """Joins every document to its group's thresholds and adds kept. small: fences has BROADCAST_GROUPS rows at most."""
    if small:
        right = fences.withColumnsRenamed({"lang": "__lang", "source": "__source"})
        joined = measured.join(F.broadcast(right), F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    else:
        joined = salted_join(measured, fences, ["lang", "source"], F.xxhash64("doc_id"))
    odd = F.lit(False)
    for k, v in metrics().items():
        # Only an unusually high symbol, line or word repetition is a fault; words may be too long or too short.
        odd = odd | F.coalesce(v > F.col(f"high_{k}"), F.lit(False))
        if k == "mean_word":
            odd = odd | F.coalesce(v < F.col(f"low_{k}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~odd).drop(*fences.drop("lang", "source").columns)


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Every document's measures and verdict; measures are written once and read by both passes."""
    measured = stored(measure(docs, keep), "quality")
    return judge(measured, thresholds(sketch(measured)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of docs that the rules keep, with these columns (pipeline stage).

    Texts are measured twice, for the thresholds and for the verdicts, so none
    is written or shuffled between.
    """
    fences = stored(thresholds(sketch(measure(docs, keep=("lang", "source")))), "quality-fences")
    small = fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    measured = measure(docs, keep=tuple(columns))
    # One condition on both sides of the join: a part on the measures alone would be pushed below them and measure again.
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("kept"))
    return judge(measured, fences, small).filter(kept).select(*columns)
