"""Journal, results, cache, audit, labels, collect, boxes, text, files and the stream."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triage.functions import boxes, text
from triage.operators import signals, workflow
from triage.sources import files, tables
from triage.streaming import scan


def test_journal(spark):
    lines = [
        json.dumps({"path": "a", "band": "positive", "confidence": 0.5}),
        '{"path": "half-writ',
        "",
        "[1,2,3]",
        '{"band":"positive"}',
        json.dumps({"path": "a", "band": "review", "confidence": 0.87654, "bbox": [1, 2, 3, 4], "dhash": "0f1e2d3c4b5a6978"}),
        json.dumps({"path": "b", "error": "decode failed"}),
    ]
    got = {r.path: r for r in tables.journal_lines(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].band == "review" and got["a"].dhash == "0f1e2d3c4b5a6978"
    assert (got["b"].band, got["b"].method, got["b"].error, got["b"].duplicate_of) == ("negative", "none", "decode failed", "")


def test_journal_append_and_resume(spark, tmp_path):
    one = spark.createDataFrame([("a", "positive", 0.87654, ""), ("b", "negative", 0.0, "bad")], "path string, band string, confidence double, error string")
    tables.append_journal(one, str(tmp_path / "j"))
    tables.append_journal(one.limit(1), str(tmp_path / "j"))
    journal = tables.read_journal(spark, str(tmp_path / "j"))
    assert {r.path: r.confidence for r in journal.collect()} == {"a": 0.8765, "b": 0.0}
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert [r.path for r in tables.pending(found, journal).collect()] == ["c"]
    assert sorted(r.path for r in tables.pending(found, journal, retry_errors=True).collect()) == ["b", "c"]


def test_results_round_trip(spark, tmp_path):
    rows = [("sub/b.jpg", False, "review", 0.5, None, None, None, None, "ocr", "", ""), ("a.png", True, "positive", 0.9123, 10, 20, 30, 40, "template", "", ""), ("bad.png", False, "negative", 0.0, None, None, None, None, "none", "", "decode failed")]
    df = spark.createDataFrame(rows, tables.RESULTS)
    tables.write_results(df, str(tmp_path / "r"))
    assert sorted(map(tuple, tables.read_results(spark, str(tmp_path / "r")).collect())) == sorted(rows)
    s = tables.summary(df, 3, 0, 2.0).collect()[0]
    assert (s.images, s.positive, s.review, s.negative, s.errors, s.images_per_second, s.eta_10k_seconds) == (3, 1, 1, 1, 1, 1.5, 6666.7)
    tables.write_errors(df.filter("error = ''"), str(tmp_path / "e"))
    part = next(p for p in os.listdir(tmp_path / "e") if p.endswith(".csv"))
    assert (tmp_path / "e" / part).read_text().strip() == "filename,error"


def test_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", "positive", {"s": 0.12345678}), ("b", "negative", {"s": 0.0})], "filename string, label string, scores map<string,double>")
    path = str(tmp_path / "c")
    tables.write_cache(rows, path, ["s"])
    back = tables.read_cache(spark, path, ["s"])
    assert {r.filename: r.scores["s"] for r in back.collect()} == {"a": 0.123457, "b": 0.0}
    assert tables.read_cache(spark, path, ["t"]).count() == 0
    (tmp_path / "bad").write_text("{nope")
    assert tables.read_cache(spark, str(tmp_path / "bad"), ["s"]).count() == 0


def test_audit(spark):
    rows = [("keep.png", "negative", 0.3, "", ""), ("flagged.png", "positive", 0.9, "", ""), ("copy.png", "negative", 0.1, "keep.png", ""), ("broken.png", "negative", 0.0, "", "x"), ("2020-08/already.png", "negative", 0.2, "", ""), ("d/other.png", "negative", 0.2, "", "")]
    results = spark.createDataFrame(rows, "filename string, band string, confidence double, duplicate_of string, error string")
    labels = spark.createDataFrame([("2020-08__already.png",), ("other.png",)], "filename string")
    assert [r.filename for r in workflow.eligible(results, labels).collect()] == ["keep.png"]
    pool = spark.createDataFrame([(f"{i}.png", i / 10) for i in range(9)], "filename string, confidence double")
    assert [r.filename for r in workflow.near_misses(pool, 2).collect()] == ["8.png", "7.png"]
    first = [r.filename for r in workflow.sample(pool, 4, 7).collect()]
    assert first == [r.filename for r in workflow.sample(pool.repartition(5), 4, 7).collect()] and len(set(first)) == 4
    manifest = spark.createDataFrame([(f"{i}", "random") for i in range(10)], "sample_name string, mode string")
    found = spark.createDataFrame([("3",), ("zz",)], "sample_name string")
    r = workflow.audit_report(manifest, found, pool=18, negatives=18, known_misses=1, confirmed=2).collect()[0]
    assert (r.hits, r.unknown) == (1, 1) and r.recall == pytest.approx(2 / (2 + 1.8 + 1), abs=1e-9) and round(100 * r.recall, 1) == 41.7
    near = workflow.audit_report(manifest.withColumn("mode", F.lit("near")), found, 18, 18, 1, 2).collect()[0]
    assert near.miss_rate is None and near.recall is None


def test_crops(spark):
    crops = spark.createDataFrame([("logo/pic_crop.jpg", "positive", 5), ("cropped-x.jpg", "negative", 0), ("logo/one_crop.jpg", "negative", 9)], "crop string, label string, dhash long")
    results = spark.createDataFrame([("2020-01/pic.png", "", 1, 4), ("2020-02/pic.png", "", 1, 1 << 40), ("2020-03/one.png", "2020-01/pic.png", 1, 9)], "filename string, duplicate_of string, x int, crop_hash long")
    got = workflow.crop_targets(crops, results)
    assert {r.crop: r.target for r in got.collect()} == {"logo/pic_crop.jpg": "2020-01/pic.png", "logo/one_crop.jpg": "2020-01/pic.png"}
    assert [r.target for r in workflow.conflicts(got).collect()] == ["2020-01/pic.png"]
    labels = spark.createDataFrame([("pic.png", "positive")], "filename string, label string")
    assert [(r.label, r.existing) for r in workflow.disagreements(got, labels).collect()] == [("negative", "positive")]


def best(spark, names, size=1):
    df = spark.createDataFrame([(f"u/2020/{m}/{n}", size) for m, n in names], "path string, size long")
    return {(r.period, r.stem): (r.path.split("/")[-1], r.variants_ignored) for r in workflow.best_variants(files.uploads(df, 2019, 2021)).collect()}


def test_collect(spark):
    assert best(spark, [("01", "photo.jpg"), ("01", "photo-150x150.jpg"), ("01", "photo-1024x768.jpg")]) == {("2020-01", "photo"): ("photo.jpg", 2)}
    assert best(spark, [("01", "a-150x150.jpg"), ("01", "a-1024x768.jpg")]) == {("2020-01", "a"): ("a-1024x768.jpg", 1)}
    assert best(spark, [("01", "a-150x150.jpg"), ("01", "a-scaled.jpg")]) == {("2020-01", "a"): ("a-scaled.jpg", 1)}
    assert best(spark, [("1", "128T-300x150-1.png")]) == {("2020-01", "128T-300x150-1"): ("128T-300x150-1.png", 0)}
    assert best(spark, [("01", "x.webp"), ("01", "x.avif"), ("01", "x.png"), ("01", "x.bak.png"), ("01", "x.txt"), ("02", "x.png")]) == {("2020-01", "x"): ("x.png", 2), ("2020-02", "x"): ("x.png", 0)}
    old = spark.createDataFrame([("u/1999/01/x.png", 1)], "path string, size long")
    assert files.uploads(old, 2019, 2021).count() == 0
    name = spark.range(1).select(workflow.fitted(F.lit("f" * 245), F.lit("long-name.png"))).collect()[0][0]
    assert len(name) <= 12 and name.endswith(".png") and "~" in name


def one(spark, column):
    r = spark.range(1).select(column.alias("v")).collect()[0].v
    return tuple(r) if r is not None else None


def B(*v):
    return boxes.box(*map(F.lit, v))


def test_boxes(spark):
    w, h = F.lit(600), F.lit(400)
    assert one(spark, boxes.clip(B(-20, -10, 100, 50), w, h)) == (0, 0, 80, 40) and one(spark, boxes.clip(B(700, 10, 5, 5), w, h)) is None
    assert one(spark, boxes.pad(B(100, 100, 200, 100), w, h, 0.10)) == (80, 90, 240, 120)
    assert one(spark, boxes.crop_pad(B(100, 100, 50, 40), F.lit(300), F.lit(200))) == (95, 96, 60, 48)
    assert one(spark, boxes.union(B(10, 10, 20, 20), B(50, 40, 10, 10))) == (10, 10, 50, 40)
    assert spark.range(1).select(boxes.iou(B(0, 0, 100, 100), B(50, 0, 100, 100))).collect()[0][0] == pytest.approx(1 / 3)
    hints = F.array(*[F.struct(b.alias("bbox"), F.lit(s).alias("source")) for b, s in ((B(105, 105, 100, 100), "mser"), (B(100, 100, 100, 100), "text"))])
    got = spark.range(1).select(boxes.merged(hints).alias("m")).collect()[0].m
    assert [(tuple(r.bbox), r.source) for r in got] == [((100, 100, 105, 105), "text")]
    assert spark.range(1).select(F.size(boxes.tiles(w, h))).collect()[0][0] == 17
    found = spark.range(1).select(boxes.propose(hints, w, h).alias("m")).collect()[0].m
    assert found[0].source == "text" and len(found) <= 24 and found[-1].source == "full"


def quad(spark, *points):
    q = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])
    return spark.range(1).select(boxes.quad_ok(q, F.lit(600), F.lit(400))).collect()[0][0]


def test_quads(spark):
    assert quad(spark, (10, 10), (110, 10), (110, 60), (10, 60))
    assert not quad(spark, (10, 10), (110, 60), (110, 10), (10, 60))  # crossed
    assert not quad(spark, (10, 10), (12, 10), (12, 12), (10, 12))  # tiny
    assert not quad(spark, (10, 10), (float("nan"), 10), (110, 60), (10, 60))
    assert not quad(spark, (900, 900), (1100, 900), (1100, 960), (900, 960))  # outside


def test_brand_text(spark):
    terms = ("ACME", "Blue Harbor")

    def best(t, terms=terms):
        return tuple(text.best_terms([t], text.term_table(terms)).loc[t])

    for t in ("ACME", "acme", "A.C.M.E.", "the ACME shop", "BlueHarbor", "visit blue harbor today"):
        assert best(t)[0] >= 90, t
    assert best("blue harb0r")[0] >= 80 and best("bl") == (0.0, "") and best("harb")[0] == 0
    # By hand: "acne" shares a, c, e with "acme", 2 x 3 of 8 letters; a search gives "blu harbor" 10 of its 10 with one letter apart.
    assert text.ratio("acme", "acne") == 75 and best("acne") == (0.0, "") and best("blu harbor")[0] == pytest.approx(200 * 10 / 21)
    assert text.best_terms(["x"], text.term_table(())).loc["x", "score"] == 0 and best("acme", ("ACME", "acme"))[1] == "ACME" 
    df = spark.createDataFrame([("ACME",), (None,)], "t string").select(text.brand_match(F.col("t"), terms).alias("m"))
    assert [(r.m.score, r.m.term) for r in df.collect()] == [(100.0, "ACME"), (0.0, "")]
    assert [r.v for r in spark.createDataFrame([("Straße-7 ",), (None,)], "t string").select(text.normalized(F.col("t")).alias("v")).collect()] == ["strasse 7", ""]


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for a, b in (("abcde", "ace"), ("", "x"), ("banana", "atana"), ("x" * 70 + "y", "yx" * 40)):
        assert text.lcs(a, b) == slow(a, b)


def picture(w, h, seed):
    raw = np.random.default_rng(seed).integers(0, 255, (h, w, 3), np.uint8)
    body = b"".join(b"\0" + raw[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n, d in (("a.png", picture(20, 10, 1)), ("sub/b.PNG", picture(30, 30, 2)), ("bad.png", b"junk"), ("empty.png", b""), ("note.txt", b"x"), (".hidden.png", b"x"), ("Thumbs.db", b"x")):
        (tmp_path / n).write_bytes(d)
    df = files.images(spark, str(tmp_path)).select("relative", files.decode(F.col("content"), 15).alias("d"))
    got = {r.relative: r.d for r in df.select("relative", "d").collect()}
    assert set(got) == {"a.png", "sub/b.PNG", "bad.png", "empty.png"}
    assert (got["a.png"].width, got["a.png"].height, got["sub/b.PNG"].width) == (15, 8, 15)
    assert got["empty.png"].error == "empty file" and got["bad.png"].error.startswith("decode failed")
    assert {r.relative: r.h is None for r in df.select("relative", files.picture_hash(F.col("d")).alias("h")).collect()}["bad.png"]


def test_registry_and_signals(spark):
    import pandas as pd

    class Loud:
        name = "loud"

        def score(self, batch):
            return pd.DataFrame({"score": [2.0] * len(batch), "bbox": [None] * len(batch), "detail": ["x"] * len(batch)})

    class Broken:
        name = "broken"

        def score(self, batch):
            raise OSError("no engine")

    signals.register("loud", Loud)
    try:
        with pytest.raises(ValueError):
            signals.register("loud", Loud)
        with pytest.raises(KeyError):
            signals.build("nope")
        assert [s.name for s in signals.build_all(["loud", Broken()])] == ["loud", "broken"]
        with pytest.raises(ValueError):
            signals.build_all([Loud(), Loud()])
    finally:
        signals.unregister("loud")
    class Const:
        def __init__(self, v):
            self.name, self.v = f"const{v}", v

        def score(self, batch):
            return pd.DataFrame({"score": [self.v] * len(batch), "bbox": [None] * len(batch), "detail": [""] * len(batch)})

    out = signals.score_all(spark.range(2).withColumnRenamed("id", "item"), "item", [Const(0.4), Const(1.5)]).collect()
    assert [s.score for s in out[0].signals] == [0.4, 1.0]
    lines = spark.createDataFrame([(1, 0, "the acme", 0.5), (1, 1, "acme", 0.5), (1, 2, "zz", 1.0)], "item long, nth int, text string, conf double").withColumn("bbox", B(1, 2, 3, 4))
    got = signals.text_signal(lines, "item", ("acme",)).collect()[0].signal
    assert got.score == 0.5 and got.detail == "acme: the acme"


def test_keypoints():
    rng = np.random.default_rng(2)
    points, desc = rng.uniform(0, 100, (40, 2)), rng.normal(size=(40, 32))
    turned = points @ np.array([[0.9, 0.3], [-0.3, 0.9]]).T * 1.2 + (50, 30)
    noise = rng.normal(size=(60, 32)) * 3
    image = {"points": np.r_[turned, rng.uniform(0, 300, (60, 2))], "desc": np.r_[desc + rng.normal(size=desc.shape) * 0.01, noise]}
    score, corners = signals.keypoint_score({"points": points, "desc": desc, "w": 100, "h": 100}, image, lambda c: True)
    assert score == 1.0 and np.allclose(corners[0], (50, 30), atol=0.5)
    assert signals.keypoint_score({"points": points, "desc": desc + 9, "w": 1, "h": 1}, {"points": turned[:5], "desc": desc[:5]}, lambda c: True) == (0.0, None)


def test_boxes_of_groups_and_views():
    got = signals.group_boxes([(0, 0, 20, 10), (25, 0, 20, 10), (200, 200, 20, 10)], 400, 400)
    assert len(got) == 5 and got[2:] == [(0, 0, 20, 10), (25, 0, 20, 10), (200, 200, 20, 10)] and signals.group_boxes([], 1, 1) == []
    assert signals.letterbox(np.zeros((10, 20, 3), np.uint8), 40).shape == (40, 40, 3) and signals.prepared(np.zeros((10, 20, 3), np.uint8)).shape == (3, 126, 126)
    assert [n for n, _ in signals.variants("a", np.zeros((2, 2, 4), np.uint8))] == ["a", "a#1"]
    assert signals.crop(np.zeros((5, 5)), (9, 9, 2, 2)) is None


def test_stream(spark, tmp_path):
    source, journal, state = (str(tmp_path / x) for x in ("in", "journal", "state"))
    seen = []

    def judge(rows):
        seen.append(rows.count())
        return rows.withColumn("band", F.lit("positive"))

    def add(rows):
        spark.createDataFrame(rows, "path string, sha256 string").coalesce(1).write.mode("append").parquet(source)

    def go():
        scan.run(spark.readStream.schema("path string, sha256 string").parquet(source), journal, state, judge).awaitTermination()
        return {r.path: (r.duplicate_of, r.band) for r in spark.read.parquet(f"{journal}/batch=*").collect()}

    add([("a", "1"), ("b", "1"), ("c", "2")])
    assert go() == {"a": (None, "positive"), "b": ("a", None), "c": (None, "positive")}
    add([("d", "2"), ("a", "1"), ("e", "3")])
    assert go()["d"] == ("c", None) and sum(seen) == 3
    scan.restart(spark, journal, state)
    assert not os.path.exists(journal)


def test_journal_order_over_appends(spark, tmp_path):
    """The last append of a path wins, whatever its files are called."""
    path = str(tmp_path / "j")
    kind = "path string, band string, confidence double"
    for turn in range(6):
        rows = [(f"p{i}", ("negative", "review", "positive")[(turn + i) % 3], turn / 10) for i in range(20)]
        tables.append_journal(spark.createDataFrame(rows, kind).repartition(3), path)
    got = {r.path: (r.band, r.confidence) for r in tables.read_journal(spark, path).collect()}
    assert got == {f"p{i}": (("negative", "review", "positive")[(5 + i) % 3], 0.5) for i in range(20)}


def test_tiles_and_pads_by_hand(spark):
    """Places and sizes are rounded, half to even, from fractions; both are cut at the frame."""
    for w, h in ((101, 77), (800, 601), (2, 2), (1, 50)):
        got = [(*r.t.bbox, r.t.source) for r in spark.range(1).select(F.explode(boxes.tiles(F.lit(w), F.lit(h))).alias("t")).collect()]
        want = [(0, 0, w, h, "full")]
        for r in range(4):
            for c in range(4):
                x, y, tw, th = round(c * w / 4), round(r * h / 4), round(w / 3), round(h / 3)
                if min(w, x + tw) > x and min(h, y + th) > y:
                    want.append((x, y, min(w, x + tw) - x, min(h, y + th) - y, "tile"))
        assert got == (want if min(w, h) >= 2 else want[:1])
    # 33 wide, 15 %: 4.95 each side; place 10 - 4.95 = 5.05 and size 42.9.
    assert one(spark, boxes.pad(B(10, 10, 33, 11), F.lit(200), F.lit(200), 0.15)) == (5, 8, 43, 14)


def test_upload_names_by_hand(spark):
    names = ["photo-scaled-150x150.jpg", "photo-1024x768.jpg", "Big-SCALED.png", "Big-2000x2000.jpg", "x.bakery.png", "y.bak.png", "icon.gif", "icon.webp", "pic.jpg", "pic.png", "zero-0x0.jpg", "zero-scaled.jpg"]
    df = spark.createDataFrame([(f"u/2020/01/{n}", 500 if n == "pic.jpg" else 100) for n in names], "path string, size long")
    got = {r.stem: (r.path.split("/")[-1], r.reason, r.variants_ignored) for r in workflow.best_variants(files.uploads(df, 2019, 2021)).collect()}
    assert got == {
        "photo": ("photo-scaled-150x150.jpg", "scaled", 1),
        "Big": ("Big-SCALED.png", "scaled", 1),
        "x.bakery": ("x.bakery.png", "original", 0),
        "icon": ("icon.gif", "original", 1),
        "pic": ("pic.jpg", "original", 1),
        "zero": ("zero-0x0.jpg", "original", 1),
    }


def test_durations_and_sizes_by_hand(spark):
    from triage.functions import scores

    got = [r.t for r in spark.createDataFrame([(0, 3723.0), (1, 61.5), (2, 0.5), (3, None), (4, 3600.0)], "i int, s double").orderBy("i").select(scores.duration(F.col("s")).alias("t")).collect()]
    assert got == ["1h 02m 03s", "1m 02s", "0s", "n/a", "1h 00m 00s"]
    rows = [("a", x) for x in (1000, 2000, 3000, 4000)] + [("b", 1_500_000)]
    got = {r.label: r for r in workflow.class_sizes(spark.createDataFrame(rows, "label string, size long")).collect()}
    assert (got["a"].median_kb, got["a"].total_mb, got["a"].share, got["b"].max_kb, got["b"].share) == (3.0, 0.01, 0.8, 1500.0, 0.2)


def test_unresolved_crops(spark):
    results = spark.createDataFrame([("m1/a.png", "", 1, 5), ("m2/a.png", "", 1, None), ("m1/b.png", "", None, None), ("m2/b.png", "", 1, None), ("m1/c.png", "", None, None)], "filename string, duplicate_of string, x int, crop_hash long")
    crops = spark.createDataFrame([(f"{n}_crop.png", "positive", 7) for n in "abc"], "crop string, label string, dhash long")
    got = {r.crop[0]: (r.target, r.reason) for r in workflow.crop_targets(crops, results).collect()}
    assert got == {"a": ("m1/a.png", "matched by content (1 bits)"), "b": (None, "no candidate could be re-cropped"), "c": ("m1/c.png", "single picture")}
