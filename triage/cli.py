"""Command line: version, scan, benchmark, calibrate. Exit codes: 0, or 2 for unknown signals and missing folders."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import config, reports
from triage.functions.scores import decide
from triage.operators import dedup, evaluation, recognisers, signals
from triage.sources import files, tables

VERSION = "1.0"
_DONE = "path string, sha256 string, dhash bigint, band string, confidence double, bbox struct<x:int,y:int,w:int,h:int>, method string, duplicate_of string, error string"


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = reports._fs(spark, path)
    return fs.exists(p)


def _scored(pictures: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """(key, signals) of decoded pictures, dealt out evenly, as a listing is not."""
    rows = pictures.select(key, "d.height", "d.width", "d.data").repartition(int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return signals.score_all(rows, key, signals.build_all(names))


def scan(spark: SparkSession, source: str, out: str, names: tuple[str, ...], settings: config.Settings, limit: int | None = None, restart: bool = False) -> dict:
    """Judges the pictures below source that the journal lacks; writes results, errors and a summary of all it knows.

    The cheap tests come first: bytes, then the small hash, then the signals.
    """
    began, journal = time.time(), f"{out}/journal"
    if restart:
        reports.delete(spark, journal)
    known = spark.read.schema(_DONE).parquet(journal) if _exists(spark, journal) else spark.createDataFrame([], _DONE)
    listed = files.images(spark, source)
    if limit:
        listed = listed.orderBy(files.walk_order("relative")).limit(limit)
    new = tables.pending(listed.withColumnRenamed("path", "file").withColumnRenamed("relative", "path"), known)
    skipped = known.count()
    hashed = dedup.cut(files.decoded(spark, source, new).withColumn("dhash", files.picture_hash(F.col("d"))))
    before = dedup.originals(known).select("path", "sha256", "dhash")
    ranked = before.withColumn("turn", F.lit(0)).unionByName(hashed.filter("d.error is null").select("path", "sha256", "dhash").withColumn("turn", F.lit(1)))
    # Known originals come before all new files, whatever their names.
    named = ranked.withColumn("at", F.concat(F.col("turn").cast("string"), F.lit(":"), "path"))
    exact = dedup.exact(named, "sha256", "at").withColumnRenamed("duplicate_of", "twin")
    near = dedup.greedy(dedup.cut(exact.filter("twin is null")), "at", "dhash")
    bare = lambda c: F.substring(c, 3, 1 << 20)
    copies = near.filter("duplicate_of is not null").select("at", "duplicate_of").unionByName(exact.filter("twin is not null").select("at", F.col("twin").alias("duplicate_of")))
    # A copy of a copy names the head.
    heads = near.select(F.col("at").alias("__t"), F.coalesce("duplicate_of", "at").alias("__head"))
    copies = dedup.cut(copies.join(heads, F.col("duplicate_of") == F.col("__t"), "left").filter("at like '1:%'").select(bare(F.col("at")).alias("path"), bare(F.coalesce("__head", "duplicate_of")).alias("duplicate_of")))
    fresh = hashed.filter("d.error is null").join(copies, "path", "left_anti")
    judged = _scored(fresh, "path", names).withColumn("v", decide(F.col("signals"), settings))
    none = F.lit("")
    done = judged.join(hashed.select("path", "sha256", "dhash"), "path").select("path", "sha256", "dhash", "v.band", "v.confidence", "v.bbox", "v.method", none.alias("duplicate_of"), none.alias("error"))
    done = dedup.cut(done)
    verdicts = done.unionByName(known).select("path", "band", "confidence", "bbox", "method")
    copied = copies.join(hashed.select("path", "sha256", "dhash"), "path").join(verdicts.withColumnRenamed("path", "__head"), F.col("duplicate_of") == F.col("__head")).withColumn("error", none)
    failed = hashed.filter("d.error is not null").select("path", "sha256", "dhash", F.lit("negative").alias("band"), F.lit(0.0).alias("confidence"), F.lit(None).cast("struct<x:int,y:int,w:int,h:int>").alias("bbox"), F.lit("none").alias("method"), none.alias("duplicate_of"), F.col("d.error").alias("error"))
    columns = done.columns
    done.unionByName(copied.select(*columns)).unionByName(failed).write.mode("append").parquet(journal)
    known = spark.read.schema(_DONE).parquet(journal)
    rows = known.withColumn("bbox", F.when(F.col("bbox").isNotNull(), F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h")))
    rows = tables.entry_rows(rows)
    tables.write_results(rows, f"{out}/results.csv")
    tables.write_errors(rows, f"{out}/errors.csv")
    total = known.count()
    summary = tables.summary(rows, total - skipped, skipped, time.time() - began).collect()[0].asDict() | {"input": source, "output": out, "signals": list(names)}
    reports.write_text(spark, f"{out}/summary.json", json.dumps(summary, indent=2) + "\n")
    return summary


def score_labelled(spark: SparkSession, root: str, names: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """(item, label, signals) of a labelled folder's readable pictures."""
    found = files.labelled(spark, root, limit).select(F.concat_ws("/", "label", "relative").alias("path"), F.col("path").alias("file"), "content", "length")
    good = dedup.cut(files.decoded(spark, root, found).filter("d.error is null").select(F.col("path").alias("item"), F.substring_index("path", "/", 1).alias("label"), "d"))
    return dedup.cut(_scored(good, "item", names).join(good.select("item", "label"), "item"))


def benchmark(spark: SparkSession, root: str, names: tuple[str, ...], report: str | None = None, limit: int | None = None) -> list[str]:
    began = time.time()
    scored = score_labelled(spark, root, names, limit)
    images = scored.count()
    rows = evaluation.long_scores(scored)
    if len(names) > 1:
        rows = rows.unionByName(evaluation.combined(scored))
    points = evaluation.best_point(evaluation.sweep(rows)).orderBy("signal").collect()
    out = [reports.benchmark_row(p.signal, p, images, time.time() - began) for p in points]
    if report:
        reports.append_rows(spark, report, out)
    return out


def calibrate(spark: SparkSession, root: str, names: tuple[str, ...], out: str, limit: int | None = None) -> bool:
    """Finds, publishes and gates thresholds; returns whether the gate passed."""
    scored = score_labelled(spark, root, names, limit)
    if not scored.limit(1).count():
        raise ValueError(f"no readable picture below {root}")
    settings = evaluation.apply(spark, evaluation.search(scored, list(names)), list(names))
    judged = evaluation.judged(scored, settings)
    measured = evaluation.metrics(judged).collect()[0].asDict()
    gate = evaluation.gate(evaluation.metrics(judged)).collect()[0].asDict()
    reports.publish(spark, f"{out}/thresholds.json", settings, measured, gate)
    reports.gate_failures(spark, f"{out}/gate-failures.txt", judged, settings, gate["passed"])
    print(reports.metrics_text(judged))
    return gate["passed"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="triage")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("scan", "benchmark", "calibrate"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("--output", default="out")
        p.add_argument("--signals")
        p.add_argument("--limit", type=int)
        p.add_argument("--thresholds")
        if name == "scan":
            p.add_argument("--restart", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    recognisers.install()
    names = config.signal_list(args.signals, tuple(signals.available()))
    if unknown := [n for n in names if n not in signals.available()]:
        print(f"no signal {', '.join(unknown)}; there are {', '.join(signals.available()) or 'none'}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("triage").getOrCreate()
    if not _exists(spark, args.input):
        print(f"no folder {args.input}", file=sys.stderr)
        return 2
    if args.command == "scan":
        settings = reports.load_settings(spark, args.thresholds) if args.thresholds else config.Settings()
        print(json.dumps(scan(spark, args.input, args.output, names, settings, args.limit, args.restart), indent=2))
    elif args.command == "benchmark":
        print("\n".join(benchmark(spark, args.input, names, f"{args.output}/benchmarks.md", args.limit)))
    else:
        calibrate(spark, args.input, names, args.output, args.limit)
    return 0


if __name__ == "__main__":
    sys.exit(main())
