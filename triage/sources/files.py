"""File sources: image walks, upload trees, decoding."""

from __future__ import annotations

import re
import struct
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import config
from triage.functions.hashing import area_resize, dhash

DECODED = "height int, width int, data binary, scale double, error string"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_image(path: Column) -> Column:
    """Whether a path is a picture by its suffix, and neither hidden nor system junk."""
    name = F.lower(name_of(path))
    return name.rlike(r"\.(" + "|".join(config.IMAGE_EXTENSIONS) + ")$") & ~name.startswith(".") & ~name.isin(*config.JUNK_NAMES)


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of no bytes below a folder, which Spark's file sources leave out, in the binaryFile schema."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listing, found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True), []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0:
            found.append((f.getPath().toString(), datetime.fromtimestamp(f.getModificationTime() / 1000), 0, bytearray()))
    return spark.createDataFrame(found, "path string, modificationTime timestamp, length long, content binary")


def images(spark: SparkSession, root: str, with_empty: bool = True) -> DataFrame:
    """Pictures below a folder: path, relative, length, content. Content is read only where it is selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if with_empty:
        found = found.unionByName(empty_files(spark, root))
    found = found.filter(is_image(F.col("path")))
    prefix = re.sub(r"^\w+:/+", "/", root).rstrip("/") + "/"
    relative = F.substr("path", F.instr("path", prefix) + F.lit(len(prefix)))
    return found.select("path", relative.alias("relative"), "length", "modificationTime", "content")


def walk_order(path: str = "path") -> Column:
    """Sort key of a walk: folder by folder, which is not the order of the path's text."""
    return F.split(path, "/")


def labelled(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """Pictures of root/positive and root/negative with their label; limit counts for each label."""
    from triage.sources.tables import limited

    both = None
    for label in ("positive", "negative"):
        part = images(spark, f"{root}/{label}").withColumn("label", F.lit(label))
        both = part if both is None else both.unionByName(part)
    return limited(both, limit, "label") if limit else both


def uploads(paths: DataFrame, first: int, last: int) -> DataFrame:
    """Files of <year>/<month>/ trees within years, with period, name, stem and ext."""
    at = F.regexp_extract("path", r"(?:^|/)(\d{4})/(\d{1,2})/(?:.*/)?[^/]+$", 1), F.regexp_extract("path", r"(?:^|/)(\d{4})/(\d{1,2})/(?:.*/)?[^/]+$", 2)
    name = name_of(F.col("path"))
    rows = paths.withColumn("year", at[0]).withColumn("month", at[1]).filter("year <> ''")
    rows = rows.filter(F.col("year").cast("int").between(first, last))
    return rows.select("*", F.concat_ws("-", "year", F.lpad("month", 2, "0")).alias("period"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("name_stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))


def png(data: bytes) -> np.ndarray | None:
    """Pixels (h, w, channels) of an 8-bit, not interlaced PNG; None for others."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, body, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    width, height, n = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.int32)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above & 255
        elif kind in (1, 3, 4):
            for x in range(width * n):
                a, c = (line[x - n], above[x - n]) if x >= n else (0, 0)
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + above[x]) // 2
                else:
                    p = a + above[x] - c
                    da, db, dc = abs(p - a), abs(p - above[x]), abs(p - c)
                    guess = a if da <= db and da <= dc else above[x] if db <= dc else c
                line[x] = line[x] + guess & 255
        out[y], above = line, line
    out = out.reshape(height, width, n)
    return palette[out[:, :, 0]] if palette is not None else out


def bmp(data: bytes) -> np.ndarray | None:
    """Pixels of an uncompressed 24 or 32-bit BMP; None for others."""
    if data[:2] != b"BM" or len(data) < 54:
        return None
    start, _, width, height, _, depth, packed = struct.unpack("<IIiiHHI", data[10:34])
    if depth not in (24, 32) or packed:
        return None
    n, rows = depth // 8, abs(height)
    stride = (width * n + 3) // 4 * 4
    a = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * n].reshape(rows, width, n)
    return (a[::-1] if height > 0 else a)[:, :, [2, 1, 0, *range(3, n)]]


DECODERS = [png, bmp]


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Three channels of any: gray is repeated, alpha laid on white."""
    n = pixels.shape[2]
    color = np.repeat(pixels[:, :, :1], 3, axis=2) if n <= 2 else pixels[:, :, :3]
    if n in (2, 4):
        alpha = pixels[:, :, -1:].astype(float) / 255
        color = np.rint(color * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return color


def downscale(pixels: np.ndarray, most: int = config.MAX_SIDE) -> np.ndarray:
    """The longest side brought to `most`, never up."""
    h, w = pixels.shape[:2]
    if max(h, w) <= most:
        return pixels
    k = most / max(h, w)
    return np.rint(area_resize(pixels, max(1, round(h * k)), max(1, round(w * k)))).astype(np.uint8)


def pixels_of(data: bytes) -> np.ndarray | None:
    """Pixels of a file by the first decoder that reads it, None where none does."""
    try:
        return next((p for p in (f(bytes(data)) for f in DECODERS) if p is not None), None)
    except Exception:  # noqa: BLE001 any damage is a reason, not a failure
        return None


#: Formats that Spark's image source reads on the JVM.
ON_JVM = ("jpg", "jpeg", "tif", "tiff")


def decoded(spark: SparkSession, root: str, pictures: DataFrame, most: int = config.MAX_SIDE) -> DataFrame:
    """pictures (file, path, content) as path, sha256 and d, the struct of `decode`: some formats by Spark's image source, others here.

    The image source gives pixels without the file's bytes, so its rows meet
    the bytes' digests by file, once their pixels are brought to size.
    """
    jvm = F.lower("file").rlike(r"\.(" + "|".join(ON_JVM) + ")$")
    digest = F.sha2("content", 256).alias("sha256")
    here = pictures.filter(~jvm).select("path", digest, decode(F.col("content"), most).alias("d"))

    @F.pandas_udf(DECODED)
    def brought(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, n, raw in zip(height, width, channels, data, strict=True):
            if h <= 0 or w <= 0:
                out.append((None, None, None, None, "decode failed (corrupt or unsupported format)"))
                continue
            bgr = np.frombuffer(raw, np.uint8).reshape(h, w, n)
            small = downscale(rgb(np.dstack([bgr[:, :, 2::-1], bgr[:, :, 3:]]) if n > 2 else bgr), most)
            out.append((small.shape[0], small.shape[1], small[:, :, ::-1].tobytes(), small.shape[0] / h, None))
        return pd.DataFrame(out, columns=["height", "width", "data", "scale", "error"]).astype({"height": "Int32", "width": "Int32"})

    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in ON_JVM) + "}"
    read = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    one_slash = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    there = read.select(one_slash(F.col("image.origin")).alias("__origin"), brought("image.height", "image.width", "image.nChannels", "image.data").alias("d"))
    named = pictures.filter(jvm).select("path", digest, one_slash(F.col("file")).alias("__file"), F.col("length").alias("__length"))
    empty = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("height", "int"), ("width", "int"), ("data", "binary"), ("scale", "double"))], F.when(F.col("__length") == 0, "empty file").otherwise("decode failed (corrupt or unsupported format)").alias("error"))
    return here.unionByName(named.join(there, F.col("__file") == F.col("__origin"), "left").select("path", "sha256", F.coalesce("d", empty).alias("d")))


def decode(content: Column, most: int = config.MAX_SIDE) -> Column:
    """struct of DECODED: BGR pixels brought to size and their scale, or a reason; a bad file never fails a job."""

    @F.pandas_udf(DECODED)
    def run(values: pd.Series) -> pd.DataFrame:
        out = []
        for data in values:
            if not data:
                out.append((None, None, None, None, "empty file"))
                continue
            pixels = pixels_of(data)
            if pixels is None or pixels.size == 0:
                out.append((None, None, None, None, "decode failed (corrupt or unsupported format)"))
                continue
            small = downscale(rgb(pixels), most)
            out.append((small.shape[0], small.shape[1], small[:, :, ::-1].tobytes(), small.shape[0] / pixels.shape[0], None))
        return pd.DataFrame(out, columns=["height", "width", "data", "scale", "error"]).astype({"height": "Int32", "width": "Int32"})

    return run(content)


def picture_hash(image: Column) -> Column:
    """dHash of a decoded image struct, null where there is none."""

    @F.pandas_udf("long")
    def run(values: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, data in zip(values["height"], values["width"], values["data"], strict=True):
            if data is None:
                out.append(None)
                continue
            bgr = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3).astype(float)
            out.append(dhash(np.rint(bgr @ np.array([0.114, 0.587, 0.299]))))
        return pd.Series(out, dtype="Int64")

    return run(image)
