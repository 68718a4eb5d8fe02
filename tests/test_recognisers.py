import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triage import cli
from triage.functions import boxes
from triage.operators import recognisers, signals
from triage.sources import artifacts, files


@pytest.fixture
def plugs():
    before = dict(recognisers._plugs)
    yield recognisers.plug
    recognisers._plugs.update(before)
    recognisers._said.clear()


def batch(*pictures):
    return pd.DataFrame([(p.shape[0], p.shape[1], p.tobytes()) for p in pictures], columns=["height", "width", "data"])


def test_missing_recognisers_score_zero_and_warn_once(plugs):
    recognisers.install()
    recognisers.install()
    assert {"ocr", "sift", "emb"} <= set(signals.available())
    for name in ("ocr", "sift", "emb"):
        with pytest.warns(UserWarning, match=name):
            got = signals.build(name).score(batch(np.zeros((4, 5, 3), np.uint8)))
        assert list(got["score"]) == [0.0] and got["detail"][0].startswith("no ")
    for name in ("ocr", "sift", "emb"):
        signals.unregister(name)


def test_text_signal(plugs):
    reads = []

    def reader(bgr):
        reads.append(1)
        return [("nothing here", 0.9, [(0, 0), (9, 0), (9, 5), (0, 5)]), ("BLUE HARBOR", 0.8, [(10, 20), (50.4, 20), (50.4, 30), (10, 30)])]

    plugs(reader=reader, terms=("Blue Harbor",))
    got = recognisers.TextSignal().score(batch(np.full((40, 60, 3), 7, np.uint8)))
    assert got["score"][0] == pytest.approx(0.8) and got["bbox"][0] == {"x": 10, "y": 20, "w": 40, "h": 10} and got["detail"][0] == "Blue Harbor: BLUE HARBOR"
    recognisers.TextSignal().score(batch(np.full((40, 60, 3), 7, np.uint8)))
    assert len(reads) == 1


def test_embedding_signal_finds_the_mark(spark, plugs, tmp_path):
    mark = np.zeros((30, 30, 3), np.uint8)
    mark[:, :, 2] = 255  # red, in BGR
    (tmp_path / "mark.png").write_bytes(artifacts.encode_png(mark))
    sizes = []

    def embedder(x):
        sizes.append(len(x))
        return x[:, :, 50:76, 20:106].mean((2, 3)) + 1e-3  # the middle, clear of the letterbox

    plugs(embedder=embedder, templates=str(tmp_path))
    picture = np.full((120, 160, 3), 200, np.uint8)
    picture[0:40, 0:53, :] = (0, 0, 255)
    got = recognisers.EmbeddingSignal().score(batch(picture))
    assert got["score"][0] > 0.99 and got["bbox"][0] == {"x": 0, "y": 0, "w": 53, "h": 40} and got["detail"][0] == "mark" and max(sizes) <= recognisers.BATCH


def test_regions_agree_with_the_columns(spark):
    hints = [((10, 10, 60, 30), "text"), ((12, 11, 58, 30), "mser"), ((100, 50, 20, 20), "mser"), ((0, 0, 1, 1), "text")]
    column = F.array(*[F.struct(boxes.box(*map(F.lit, b)).alias("bbox"), F.lit(s).alias("source")) for b, s in hints])
    want = [tuple(r.r.bbox) for r in spark.range(1).select(F.explode(boxes.propose(column, F.lit(201), F.lit(131))).alias("r")).collect()]
    assert recognisers.regions(hints, 201, 131) == want


def test_jvm_formats(spark, tmp_path):
    """JPEG and TIFF pictures are decoded by Spark's image source; damaged and empty files are reasons."""
    io, image = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.awt.image.BufferedImage(40, 30, 1)
    for x in range(40):
        for y in range(30):
            image.setRGB(x, y, 0xC86432)
    for kind in ("jpg", "tiff"):
        assert io.write(image, kind, spark._jvm.java.io.File(str(tmp_path / f"a+b.{kind}")))
    (tmp_path / "bad.JPG").write_bytes(b"\xff\xd8 no picture")
    (tmp_path / "none.jpeg").write_bytes(b"")
    (tmp_path / "p.png").write_bytes(artifacts.encode_png(np.full((8, 9, 3), 50, np.uint8)))
    listed = files.images(spark, str(tmp_path)).withColumnRenamed("path", "file").withColumnRenamed("relative", "path")
    got = {r.path: r.d for r in files.decoded(spark, str(tmp_path), listed).collect()}
    assert set(got) == {"a+b.jpg", "a+b.tiff", "bad.JPG", "none.jpeg", "p.png"}
    for name in ("a+b.jpg", "a+b.tiff"):
        pixels = np.frombuffer(got[name].data, np.uint8).reshape(30, 40, 3).astype(int)
        assert got[name].error is None and np.abs(pixels - (0x32, 0x64, 0xC8)).max() <= 4
    assert got["bad.JPG"].error.startswith("decode failed") and got["none.jpeg"].error == "empty file" and got["p.png"].height == 8
    assert cli.VERSION
