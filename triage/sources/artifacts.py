"""Files for reviewers: crops, copies, audit samples and collected originals; and synthetic pictures.

Writers run on the executors, on any file system that pyarrow opens. A file
that cannot be written is a reason in its row; the job goes on.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import config
from triage.operators import workflow

#: The folders of a scan's review files.
FOLDERS = {"positive": "detected", "review": "review"}


def system_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    system, path = system_of(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def get(uri: str) -> bytes:
    system, path = system_of(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.readall()


def encode_png(bgr: np.ndarray) -> bytes:
    """A picture of BGR or BGRA pixels as PNG."""
    h, w, n = bgr.shape
    raw = np.zeros((h, 1 + w * n), np.uint8)
    raw[:, 1:] = bgr[:, :, [2, 1, 0, *range(3, n)]].reshape(h, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 6 if n == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def crop_path(relative: Column) -> Column:
    """crops/<folders>/<stem>_crop.png of a picture."""
    return F.concat(F.lit("crops/"), F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit("_crop.png"))


def copy_path(band: Column, relative: Column) -> Column:
    """Where a picture of a band is copied, null for negatives."""
    folder = F.lit(None).cast("string")
    for k, v in FOLDERS.items():
        folder = F.when(band == k, F.lit(v)).otherwise(folder)
    return F.concat(folder, F.lit("/"), relative)


def save(judged: DataFrame, out: str) -> DataFrame:
    """Writes crop and copy of flagged rows (relative, band, bbox, content, d: decoded); returns (relative, problem)."""
    from triage.functions.boxes import crop_pad

    box = F.when(F.col("bbox").isNotNull(), crop_pad(F.col("bbox"), F.col("d.width"), F.col("d.height"), config.CROP_PAD))
    rows = judged.filter(F.col("band").isin(*FOLDERS)).select("relative", box.alias("b"), "d.height", "d.width", "d.data", "content", crop_path(F.col("relative")).alias("crop"), copy_path(F.col("band"), F.col("relative")).alias("copy"))

    def write(batches):
        for batch in batches:
            problems = []
            for r in batch.itertuples(index=False):
                said = []
                if r.b is not None:
                    try:
                        pixels = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), 3)
                        put(f"{out}/{r.crop}", encode_png(pixels[r.b["y"] : r.b["y"] + r.b["h"], r.b["x"] : r.b["x"] + r.b["w"]]))
                    except Exception as e:  # noqa: BLE001 a reason, not a failure
                        said.append(f"crop failed: {e}")
                try:
                    put(f"{out}/{r.copy}", r.content)
                except Exception as e:  # noqa: BLE001
                    said.append(f"copy failed: {e}")
                problems.append("; ".join(said))
            yield pd.DataFrame({"relative": batch["relative"], "problem": problems})

    return rows.mapInPandas(write, "relative string, problem string")


def copy(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Copies files (columns source and target name URIs); returns the rows with problem, empty where it worked."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                put(y, get(x))
                out.append("")
            except Exception as e:  # noqa: BLE001
                out.append(f"copy failed: {e}")
        return pd.Series(out, dtype="object")

    return rows.withColumn("problem", run(F.col(source), F.col(target)))


def prepare_audit(pool: DataFrame, root: str, out: str, k: int, seed: int | None = None) -> DataFrame:
    """Copies a sample of the pool (random with a seed, else the nearest misses) to out; returns its manifest.

    Refuses a folder that already holds files.
    """
    system, path = system_of(out)
    if system.get_file_info(path).type != fs.FileType.NotFound and system.get_file_info(fs.FileSelector(path)):
        raise FileExistsError(f"{out} is not empty")
    taken = workflow.near_misses(pool, k) if seed is None else workflow.sample(pool, k, seed)
    rows = taken.select(workflow.flat_name(F.col("filename")).alias("sample_name"), F.col("filename").alias("source"), F.lit("near-miss" if seed is None else "random").alias("mode"))
    rows = rows.withColumn("__a", F.concat(F.lit(f"{root}/"), "source")).withColumn("__b", F.concat(F.lit(f"{out}/"), "sample_name"))
    done = pool.sparkSession.createDataFrame(copy(rows, "__a", "__b").drop("__a", "__b").toPandas(), "sample_name string, source string, mode string, problem string")
    done.select("sample_name", "source", "mode").coalesce(1).write.option("header", True).csv(f"{out}/manifest")
    return done


def collect(best: DataFrame, out: str) -> DataFrame:
    """Copies chosen originals (path, period, note) to out/<period>/<name>, copies of others left out; returns the manifest."""
    name = workflow.fitted(F.concat(F.lit(f"{out}/"), "period"), workflow.base_name(F.col("path")))
    rows = best.filter("coalesce(note, '') = ''").withColumn("dest_relpath", F.concat_ws("/", "period", name)).withColumn("__to", F.concat(F.lit(f"{out}/"), "dest_relpath"))
    return copy(rows, "path", "__to").drop("__to")


# -- synthetic pictures -----------------------------------------------------


def background(rng: np.random.Generator, h: int, w: int) -> np.ndarray:
    """One of: plain, a ramp, noise, rectangles, rows of marks like text."""
    kind, base = rng.integers(5), rng.integers(0, 256, 3)
    if kind == 1:
        ramp = np.linspace(0, 1, w)[None, :, None]
        return np.broadcast_to(base * (1 - ramp) + rng.integers(0, 256, 3) * ramp, (h, w, 3)).astype(np.uint8)
    if kind == 2:
        return rng.integers(0, 256, (h, w, 3), np.uint8)
    out = np.broadcast_to(base, (h, w, 3)).astype(np.uint8).copy()
    for _ in range(0 if kind == 0 else int(rng.integers(4, 12))):
        y, x = int(rng.integers(0, h)), int(rng.integers(0, w))
        if kind == 3:
            out[y : y + int(rng.integers(5, h)), x : x + int(rng.integers(5, w))] = rng.integers(0, 256, 3)
        else:
            for at in range(x, min(w, x + 90), 9):
                out[y : y + 12, at : at + int(rng.integers(2, 7))] = 255 - base
    return out


def paste(rng: np.random.Generator, picture: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """An RGBA mark, resized to 15 to 45 % of the width, laid on a picture at random; with its box."""
    from triage.functions.hashing import area_resize

    h, w = picture.shape[:2]
    mw = max(2, int(w * rng.uniform(0.15, 0.45)))
    mh = max(1, min(h, round(mark.shape[0] * mw / mark.shape[1])))
    small = area_resize(mark, mh, mw)
    y, x = int(rng.integers(0, h - mh + 1)), int(rng.integers(0, w - mw + 1))
    alpha = small[:, :, 3:] / 255
    out = picture.astype(float)
    out[y : y + mh, x : x + mw] = small[:, :, 2::-1] * alpha + out[y : y + mh, x : x + mw] * (1 - alpha)
    return np.rint(out).astype(np.uint8), (x, y, mw, mh)


def dummy_mark(h: int = 240, w: int = 720) -> np.ndarray:
    """An RGBA mark of a ring and bars on clear ground."""
    y, x = np.mgrid[0:h, 0:w]
    r = np.hypot(y - h / 2, x - h / 2)
    ink = ((r > h * 0.28) & (r < h * 0.42)) | ((x > h) & (x < w - 20) & ((x // 30) % 2 == 0) & (abs(y - h / 2) < h * 0.3))
    out = np.zeros((h, w, 4), np.uint8)
    out[ink] = (20, 60, 160, 255)
    return out


def generate(spark: SparkSession, out: str, n: int, positive_share: float = 0.5, size: tuple[int, int] = (600, 800), seed: int = 0) -> DataFrame:
    """Writes n pictures to out/positive and out/negative, each made from its number alone; returns (path, label)."""
    if not 0 <= positive_share <= 1:
        raise ValueError("positive_share must lie between 0 and 1")
    first = round(n * positive_share)
    label = F.when(F.col("id") < first, "positive").otherwise("negative")
    rows = spark.range(n).select("id", label.alias("label"), F.concat(F.lit(f"{out}/"), label, F.lit("/"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".png")).alias("path"))

    def write(batches):
        mark = dummy_mark()
        for batch in batches:
            for r in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, r.id])
                picture = background(rng, *size)
                if r.label == "positive":
                    picture, _ = paste(rng, picture, mark)
                put(r.path, encode_png(picture))
            yield batch[["path", "label"]]

    return rows.mapInPandas(write, "path string, label string")
