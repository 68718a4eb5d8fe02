"""Review files, audit samples, collected originals and synthetic pictures."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.functions import boxes
from triage.sources import artifacts, files


def test_generate_scan_and_save(spark, tmp_path):
    made = artifacts.generate(spark, str(tmp_path / "in"), 6, 0.5, (60, 90), seed=3)
    assert {r.label for r in made.collect()} == {"positive", "negative"}
    first = (tmp_path / "in/positive/000000.png").read_bytes()
    artifacts.generate(spark, str(tmp_path / "again"), 6, 0.5, (60, 90), seed=3).collect()
    assert (tmp_path / "again/positive/000000.png").read_bytes() == first
    rows = files.images(spark, str(tmp_path / "in")).select("relative", "content", files.decode(F.col("content")).alias("d"))
    band = F.when(F.col("relative").startswith("positive/000000"), "positive").when(F.col("relative").startswith("positive"), "review").otherwise("negative")
    rows = rows.withColumn("band", band).withColumn("bbox", F.when(band == "positive", boxes.box(F.lit(10), F.lit(10), F.lit(20), F.lit(10))))
    got = artifacts.save(rows, str(tmp_path / "out")).collect()
    assert len(got) == 3 and {r.problem for r in got} == {""}
    crop = files.png((tmp_path / "out/crops/positive/000000_crop.png").read_bytes())
    assert crop.shape == (12, 24, 3) and (tmp_path / "out/detected/positive/000000.png").read_bytes() == first
    assert len(os.listdir(tmp_path / "out/review/positive")) == 2
    with pytest.raises(ValueError):
        artifacts.generate(spark, str(tmp_path), 2, 1.5)


def test_audit_folder_and_collect(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    for i in range(4):
        (tmp_path / f"in/a/{i}.png").write_bytes(bytes([i]))
    pool = spark.createDataFrame([(f"a/{i}.png", i / 10) for i in range(4)] + [("a/gone.png", 0.9)], "filename string, confidence double")
    done = artifacts.prepare_audit(pool, str(tmp_path / "in"), str(tmp_path / "audit"), 3)
    problems = {r.sample_name: r.problem for r in done.collect()}
    assert problems["a__3.png"] == "" and problems["a__gone.png"].startswith("copy failed") and (tmp_path / "audit/a__3.png").read_bytes() == b"\x03"
    with pytest.raises(FileExistsError):
        artifacts.prepare_audit(pool, str(tmp_path / "in"), str(tmp_path / "audit"), 3, seed=1)
    best = spark.createDataFrame([(f"{tmp_path}/in/a/1.png", "2020-01", ""), (f"{tmp_path}/in/a/2.png", "2020-01", "duplicate-of:x")], "path string, period string, note string")
    assert [r.dest_relpath for r in artifacts.collect(best, str(tmp_path / "kept")).collect()] == ["2020-01/1.png"]
    assert os.listdir(tmp_path / "kept/2020-01") == ["1.png"]


def test_png_round_trip():
    p = np.random.default_rng(0).integers(0, 255, (7, 5, 3), np.uint8)
    assert (files.png(artifacts.encode_png(p)) == p[:, :, ::-1]).all()
