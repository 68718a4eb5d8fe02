"""The commands over small folders of pictures, with a signal that reads brightness."""

import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

from triage import cli, reports
from triage.operators import signals


def png(seed, level, size=24):
    raw = np.clip(np.kron(np.random.default_rng(seed).normal(level, 40, (size // 3, size // 3, 3)), np.ones((3, 3, 1))), 0, 255).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, size, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in raw))) + chunk(b"IEND", b"")


@pytest.fixture
def bright():
    class Bright:
        name = "bright"

        def score(self, batch):
            return pd.DataFrame({"score": [np.frombuffer(d, np.uint8).mean() / 255 for d in batch["data"]], "bbox": [None] * len(batch), "detail": ["light"] * len(batch)})

    signals.register("bright", Bright)
    yield
    signals.unregister("bright")


def test_scan_and_resume(spark, tmp_path, bright):
    source, out = tmp_path / "in", str(tmp_path / "out")
    (source / "sub").mkdir(parents=True)
    for n, d in (("a.png", png(1, 230)), ("b.png", png(1, 230)), ("sub/c.png", png(2, 60)), ("bad.png", b"junk")):
        (source / n).write_bytes(d)
    assert cli.main(["scan", str(source), "--output", out, "--signals", "bright"], spark) == 0
    s = json.loads(reports.read_text(spark, f"{out}/summary.json"))
    assert (s["images"], s["duplicates"], s["errors"], s["positive"]) == (4, 1, 1, 2)
    first = {r.filename: tuple(r) for r in cli.tables.read_results(spark, f"{out}/results.csv").collect()}
    assert first["b.png"][9] == "a.png" and first["b.png"][2] == first["a.png"][2] == "positive" and first["bad.png"][10]
    (source / "0.png").write_bytes(png(1, 230))
    assert cli.main(["scan", str(source), "--output", out, "--signals", "bright"], spark) == 0
    again = {r.filename: tuple(r) for r in cli.tables.read_results(spark, f"{out}/results.csv").collect()}
    assert {k: v for k, v in again.items() if k != "0.png"} == first and again["0.png"][9] == "a.png"


def test_benchmark_and_calibrate(spark, tmp_path, bright):
    for label, level in (("positive", 210), ("negative", 60)):
        (tmp_path / "set" / label).mkdir(parents=True)
        for i in range(6):
            (tmp_path / "set" / label / f"{i}.png").write_bytes(png(i + level, level))
    out = str(tmp_path / "out")
    assert cli.main(["benchmark", str(tmp_path / "set"), "--output", out, "--signals", "bright"], spark) == 0
    assert "| bright | 12 | 1.000 | 1.000 |" in reports.read_text(spark, f"{out}/benchmarks.md")
    assert cli.main(["calibrate", str(tmp_path / "set"), "--output", out, "--signals", "bright"], spark) == 0
    doc = json.loads(reports.read_text(spark, f"{out}/thresholds.json"))
    assert doc["gate"]["passed"] and doc["version"] == 1 and doc["metrics"]["precision"] == 1
    assert reports.load_settings(spark, f"{out}/thresholds.json").thresholds["bright"][0] <= 0.8
    assert reports.read_text(spark, f"{out}/gate-failures.txt") is None


def test_exit_codes(spark, tmp_path):
    assert cli.main(["version"]) == 0 and cli.main(["scan", str(tmp_path), "--signals", "nope"], spark) == 2
    assert cli.main(["scan", str(tmp_path / "missing"), "--signals", ""], spark) == 2
