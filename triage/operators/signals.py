"""Signals: the registry, and the scoring of recognised text, vectors and keypoints.

A signal scores a batch of items. The recognisers that read pixels are
plugins: where one is missing its signal scores 0.0 and says so once.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage import config
from triage.functions.boxes import BOX
from triage.functions.scores import clamp
from triage.functions.text import brand_match


class Signal(Protocol):
    """A named score of items; score() gives rows (score, bbox, detail) for a batch of rows."""

    name: str

    def score(self, batch: pd.DataFrame) -> pd.DataFrame: ...


_registry: dict[str, Callable[[], Signal]] = {}
_warned: set[str] = set()


def register(name: str, factory: Callable[[], Signal]) -> None:
    if name in _registry:
        raise ValueError(f"a signal named {name!r} is there already")
    _registry[name] = factory


def unregister(name: str) -> None:
    _registry.pop(name, None)


def available() -> list[str]:
    return sorted(_registry)


def build(name: str) -> Signal:
    if name not in _registry:
        raise KeyError(f"no signal {name!r}; there are {', '.join(available()) or 'none'}")
    return _registry[name]()


def build_all(names: Iterable[str | Signal]) -> list[Signal]:
    """Signals by name; ready ones pass through. Names must differ."""
    out = [build(x) if isinstance(x, str) else x for x in names]
    if len({s.name for s in out}) < len(out):
        raise ValueError("two signals have one name")
    return out


def score_all(items: DataFrame, key: str, signals: list[Signal]) -> DataFrame:
    """(key, signals): all signals over each batch of items in one pass, failures scoring 0 with their error."""
    fields = items.schema
    kind = next(f.dataType.simpleString() for f in fields if f.name == key)

    def run(batches):
        for batch in batches:
            parts = []
            for s in signals:
                try:
                    got = s.score(batch)
                    rows = list(zip(got["score"].clip(0, 1), got["bbox"], got["detail"], strict=True))
                except Exception as e:  # noqa: BLE001 one signal's failure costs its score alone
                    rows = [(0.0, None, f"error: {e}")] * len(batch)
                parts.append([{"name": s.name, "score": float(a), "bbox": b, "detail": d} for a, b, d in rows])
            yield pd.DataFrame({key: batch[key], "signals": [list(x) for x in zip(*parts, strict=True)] if parts else [[] for _ in range(len(batch))]})

    return items.mapInPandas(run, f"`{key}` {kind}, signals array<struct<name:string,score:double,bbox:{BOX},detail:string>>")


def missing(name: str, why: str) -> Column:
    """The score of a signal whose plugin or templates are missing: 0, with one warning a driver."""
    if name not in _warned:
        _warned.add(name)
        warnings.warn(f"signal {name!r} scores 0: {why}", stacklevel=2)
    return signal_struct(name, F.lit(0.0), None, F.lit(why))


def signal_struct(name: str, score: Column, bbox: Column | None, detail: Column) -> Column:
    box = F.lit(None).cast(BOX) if bbox is None else bbox.cast(BOX)
    return F.struct(F.lit(name).alias("name"), clamp(score).alias("score"), box.alias("bbox"), detail.alias("detail"))


def text_signal(lines: DataFrame, key: str, terms: Iterable[str]) -> DataFrame:
    """(key, signal) of recognised lines (key, nth, text, conf, bbox): the best of match x confidence, of equals the first line."""
    scored = lines.withColumn("m", brand_match(F.col("text"), terms)).withColumn("s", F.col("m.score") / 100 * F.col("conf"))
    top = scored.groupBy(key).agg(F.max_by(F.struct("s", "bbox", "m", "text"), F.struct("s", -F.col("nth"))).alias("t"))
    return top.select(key, signal_struct("ocr", F.col("t.s"), F.when(F.col("t.s") > 0, F.col("t.bbox")), F.when(F.col("t.s") > 0, F.concat(F.col("t.m.term"), F.lit(": "), F.col("t.text"))).otherwise("")).alias("signal"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, added in order of the components; null for zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def unit(v: Column) -> Column:
    """A vector scaled to length 1; zero stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12))))[0]


def top_templates(vectors: DataFrame, templates: DataFrame, key: str = "vec_id", most: int = 4096) -> DataFrame:
    """(key, template, cosine): each vector's best template, of equals the first by name.

    templates (template, vec) are a person's choice, a handful; beyond `most` of
    them this refuses rather than compare everything with everything.
    """
    if templates.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} templates; use a nearest-neighbour index")
    met = vectors.crossJoin(F.broadcast(templates)).select(key, "template", cosine(F.col("embedding"), F.col("vec")).alias("cosine"))
    best = met.groupBy(key).agg(F.min(F.struct((-F.col("cosine")).alias("o"), F.col("template"))).alias("b"))
    return best.select(key, F.col("b.template").alias("template"), (-F.col("b.o")).alias("cosine"))


def floored(score: Column, floor: float = config.EMBEDDING_FLOOR) -> Column:
    """struct<score, detail>: a cosine under the floor counts as nothing."""
    low = F.coalesce(score, F.lit(0.0)) < floor
    return F.struct(F.when(low, 0.0).otherwise(score).alias("score"), F.when(low, "below floor").otherwise("").alias("detail"))


# -- keypoints ------------------------------------------------------------


def good_matches(template: np.ndarray, image: np.ndarray, points: np.ndarray, ratio: float = config.SIFT_RATIO) -> np.ndarray:
    """(template row, image row) pairs whose nearest descriptor clearly beats the second, the closest one a pixel."""
    if len(image) < 2 or not len(template):
        return np.zeros((0, 2), int)
    d = np.sqrt(np.maximum(0, (template**2).sum(1)[:, None] + (image**2).sum(1)[None] - 2 * template @ image.T))
    two = np.argpartition(d, 1, axis=1)[:, :2]
    near = np.take_along_axis(d, two, 1)
    first = np.where(near[:, 0] <= near[:, 1], two[:, 0], two[:, 1])
    d1, d2 = near.min(1), near.max(1)
    keep = np.flatnonzero(d1 < ratio * d2)
    spots: dict[tuple, tuple] = {}
    for t in keep[np.argsort(d1[keep], kind="stable")]:
        spot = tuple(np.rint(points[first[t]]).astype(int))
        spots.setdefault(spot, (t, first[t]))
    return np.array(sorted(spots.values()), int).reshape(-1, 2)


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The projective map of points a onto b by least squares on four or more pairs."""

    def conditioned(p):
        c = p.mean(0)
        k = np.sqrt(2) / max(1e-9, np.sqrt(((p - c) ** 2).sum(1)).mean())
        return np.array([[k, 0, -k * c[0]], [0, k, -k * c[1]], [0, 0, 1]])

    ta, tb = conditioned(a), conditioned(b)
    pa, pb = (np.c_[p, np.ones(len(p))] @ t.T for p, t in ((a, ta), (b, tb)))
    zero = np.zeros_like(pa)
    rows = np.r_[np.c_[zero, -pa, pb[:, 1:2] * pa], np.c_[pa, zero, -pb[:, :1] * pa]]
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def ransac(a: np.ndarray, b: np.ndarray, reach: float = config.SIFT_REPROJECTION, rounds: int = 500, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """A homography that most pairs agree on, and which do."""
    rng, best = np.random.default_rng(seed), np.zeros(len(a), bool)
    for _ in range(rounds if len(a) >= 4 else 0):
        pick = rng.choice(len(a), 4, replace=False)
        h = homography(a[pick], b[pick])
        if h is None:
            continue
        err = np.sqrt(((project(h, a) - b) ** 2).sum(1))
        inside = np.nan_to_num(err, nan=np.inf) < reach
        if inside.sum() > best.sum():
            best = inside
    return (homography(a[best], b[best]), best) if best.sum() >= 4 else (None, best)


def keypoint_score(template: dict, image: dict, plausible: Callable[[np.ndarray], bool]) -> tuple[float, np.ndarray | None]:
    """(score, corners) of a template in a picture, both with points and desc; the template with its h and w."""
    pairs = good_matches(template["desc"], image["desc"], image["points"])
    if len(pairs) < config.SIFT_MIN_GOOD:
        return 0.0, None
    h, inside = ransac(template["points"][pairs[:, 0]], image["points"][pairs[:, 1]])
    if h is None or inside.sum() < config.SIFT_MIN_INLIERS:
        return 0.0, None
    corners = project(h, np.array([[0, 0], [template["w"], 0], [template["w"], template["h"]], [0, template["h"]]], float))
    return (min(1.0, inside.sum() / config.SIFT_NORM), corners) if plausible(corners) else (0.0, None)


def by_item(long: DataFrame, key: str) -> DataFrame:
    """(key, signals) of long signal rows (key, signal struct)."""
    w = Window.partitionBy(key, F.col("signal.name")).orderBy(F.desc("signal.score"))
    one = long.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return one.groupBy(key).agg(F.sort_array(F.collect_list("signal")).alias("signals"))


def group_boxes(boxes: list[tuple[int, int, int, int]], width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Boxes that touch once grown by shares of their median height, as one box a group, and the boxes themselves."""
    if not boxes:
        return []
    mid = max(1, sorted(b[3] for b in boxes)[len(boxes) // 2])  # the upper median
    kw, kh = max(3, int(mid * 1.2)), max(1, int(mid * 0.4))
    # A box fills its far edges; it grows by half of kw and kh, the odd pixel to the right and below.
    edges = [(x - (kw - 1 - kw // 2), y - (kh - 1 - kh // 2), x + w + kw // 2, y + h + kh // 2) for x, y, w, h in boxes]
    grown = [(max(0, a), max(0, b), min(width - 1, c), min(height - 1, d)) for a, b, c, d in edges]
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(grown)), key=lambda i: grown[i][0])
    active: list[int] = []
    for i in order:  # a sweep over x: only boxes that reach it can touch, corners included
        active = [j for j in active if grown[j][2] + 1 >= grown[i][0]]
        for j in active:
            if grown[j][1] <= grown[i][3] + 1 and grown[i][1] <= grown[j][3] + 1:
                parent[root(j)] = root(i)
        active.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(grown)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        x0, y0 = min(grown[i][0] for i in members), min(grown[i][1] for i in members)
        x1, y1 = max(grown[i][2] for i in members), max(grown[i][3] for i in members)
        out.append((x0, y0, x1 - x0 + 1, y1 - y0 + 1))
    return sorted(out) + list(boxes)


def letterbox(pixels: np.ndarray, side: int, fill: int = 255) -> np.ndarray:
    """A picture in the middle of a square, its longest side as long as the square's."""
    from triage.functions.hashing import area_resize

    h, w = pixels.shape[:2]
    k = side / max(h, w)
    small = np.rint(area_resize(pixels, max(1, round(h * k)), max(1, round(w * k))))
    out = np.full((side, side, 3), fill, np.uint8)
    y, x = (side - small.shape[0]) // 2, (side - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


#: The means and deviations of the common image-net preparation.
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def prepared(bgr: np.ndarray, side: int = 126) -> np.ndarray:
    """Channels-first model input of a BGR picture."""
    rgb = letterbox(bgr, side)[:, :, ::-1] / 255.0
    return ((rgb - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def crop(pixels: np.ndarray, b: tuple[int, int, int, int]) -> np.ndarray | None:
    """The part of a picture in a box with three channels, None if empty."""
    x, y, w, h = b
    part = pixels[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    if part.size == 0:
        return None
    return np.repeat(part[:, :, None], 3, 2) if part.ndim == 2 else part[:, :, :3]


def variants(name: str, rgba: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Views of a template: with alpha on white and on black, else itself."""
    if rgba.ndim == 2 or rgba.shape[2] < 4:
        return [(name, rgba)]
    a = rgba[:, :, 3:].astype(float) / 255
    return [(n, np.rint(rgba[:, :, :3] * a + back * (1 - a)).astype(np.uint8)) for n, back in ((name, 255), (f"{name}#1", 0))]
