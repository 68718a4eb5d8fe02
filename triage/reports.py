"""Texts and files that a person reads: metric tables, benchmark rows, thresholds, gate failures."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from triage import config
from triage.operators import evaluation


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(p) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on any file system that Spark knows."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def metrics_text(judged: DataFrame) -> str:
    """The confusion table, the ratios, the wins and the names of what went wrong."""
    m = evaluation.metrics(judged).collect()[0]
    n = {(r.label, r.band): r.n for r in evaluation.counts(judged).collect()}
    lines = [f"{m.images} images: {m.positives} positive, {m.negatives} negative", " " * 10 + "".join(f"{b:>10}" for b in config.BANDS)]
    lines += [f"{lab:<10}" + "".join(f"{n[lab, b]:>10}" for b in config.BANDS) for lab in ("positive", "negative")]
    lines.append(f"precision {m.precision:.3f}  catch recall {m.catch_recall:.3f}  review {m.review_share:.1%}")
    lines.append("wins: " + (", ".join(f"{r.signal} {r.wins}" for r in evaluation.wins(judged).orderBy("signal").collect()) or "none"))
    return "\n".join(lines)


def benchmark_row(name: str, point, images: int, seconds: float) -> str:
    rate = images / seconds if seconds else 0.0
    return f"| {date.today().isoformat()} | {name} | {images} | {point.precision:.3f} | {point.catch_recall:.3f} | {point.review_share:.1%} | {point.review_t:.2f}/{point.positive_t:.2f} | {rate:.2f} |"


def append_rows(spark: SparkSession, path: str, rows: list[str]) -> None:
    """Adds rows to a markdown table, making its head first; what is there stays."""
    head = "| date | signal | images | precision | catch recall | review | thresholds | images a second |\n|-|-|-|-|-|-|-|-|"
    write_text(spark, path, "\n".join([(read_text(spark, path) or head).rstrip("\n"), *rows]) + "\n")


def publish(spark: SparkSession, path: str, settings: config.Settings, measured: dict, gate: dict) -> None:
    """Thresholds as versioned data, with what they were worth."""
    old = read_text(spark, path)
    version = json.loads(old)["version"] + 1 if old else 1
    doc = {"version": version, "date": date.today().isoformat(), "thresholds": {k: list(v) for k, v in sorted(settings.thresholds.items())}, "metrics": measured, "gate": gate}
    write_text(spark, path, json.dumps(doc, indent=2) + "\n")


def load_settings(spark: SparkSession, path: str) -> config.Settings:
    doc = json.loads(read_text(spark, path) or "{}")
    if "thresholds" not in doc:
        raise ValueError(f"no thresholds in {path}")
    return config.Settings(thresholds={k: tuple(v) for k, v in doc["thresholds"].items()}, version=doc["version"])


def gate_failures(spark: SparkSession, path: str, judged: DataFrame, settings: config.Settings, passed: bool) -> None:
    """The missed positives and why, sorted; no file once the gate passes."""
    if passed:
        delete(spark, path)
        return
    missed = judged.filter("label = 'positive' and band = 'negative'")
    rows = missed.select("item", evaluation.miss_reason(missed.signals, settings).alias("reason")).orderBy("item")
    write_text(spark, path, "".join(f"{r.item}\t{r.reason}\n" for r in rows.toLocalIterator()))
