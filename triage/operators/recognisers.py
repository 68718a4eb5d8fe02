"""The built-in signals: recognised text, keypoints and embeddings, over plugin recognisers.

A recogniser reads pixels and is not part of the engine:

    reader(bgr)      -> [(text, confidence, corner points)]
    extractor(gray)  -> (points (n, 2), descriptors (n, d))
    embedder(inputs) -> vectors (n, d) of prepared crops (n, 3, side, side)

`plug` sets them, and the folder of the mark's pictures. A signal that lacks
its recogniser or its templates scores 0.0, and says why once a process.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd

from triage import config
from triage.functions.text import best_terms, term_table
from triage.operators import signals
from triage.sources import files

#: Crops that an embedder gets at once, and the least side to which a small mark's picture is brought.
BATCH, LEAST_SIDE = 32, 256
_GRAY = np.array([0.114, 0.587, 0.299])
_plugs: dict[str, object] = {"reader": None, "extractor": None, "embedder": None, "templates": None, "terms": ()}
_said: set[str] = set()


def plug(**parts) -> None:
    """Sets reader, extractor, embedder, templates (a folder) or terms."""
    if unknown := set(parts) - set(_plugs):
        raise KeyError(f"no part {', '.join(sorted(unknown))}")
    _plugs.update(parts)


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr[:, :, :3].astype(float) @ _GRAY).astype(np.uint8)


def template_pictures(folder: str | None) -> list[tuple[str, np.ndarray]]:
    """(name, BGR) of the pictures of a folder in order of their names: with alpha on white and on black; unreadable ones are left out."""
    out = []
    for path in sorted(Path(folder).iterdir()) if folder and Path(folder).is_dir() else []:
        pixels = files.pixels_of(path.read_bytes())
        if pixels is not None:
            rgba = np.dstack([pixels[:, :, 2::-1], pixels[:, :, 3:]]) if pixels.shape[2] > 3 else files.rgb(pixels)[:, :, ::-1]
            out += signals.variants(path.stem, rgba)
    return out


def upscaled(pixels: np.ndarray, least: int = LEAST_SIDE) -> np.ndarray:
    """A small picture's longest side brought up to `least` by whole steps."""
    k = -(-least // max(pixels.shape[:2]))
    return pixels if k < 2 else pixels.repeat(k, 0).repeat(k, 1)


def inside(x: float, y: float, w: float, h: float, width: int, height: int) -> tuple[int, int, int, int] | None:
    """A box with place and size rounded half to even, cut at the frame; None if nothing is left."""
    left, upper = round(x), round(y)
    x0, y0, x1, y1 = max(0, left), max(0, upper), min(width, left + max(0, round(w))), min(height, upper + max(0, round(h)))
    return (x0, y0, x1 - x0, y1 - y0) if x1 > x0 and y1 > y0 else None


def regions(hints: list[tuple[tuple[int, int, int, int], str]], width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Boxes to look at: padded, fair and merged hints within the budget, then the frame and its tiles merged in (functions.boxes.propose, for one picture)."""

    def overlap(a, b):
        both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    def merged(found):
        kept: list[list] = []
        for b, source in sorted(found, key=lambda r: (config.SOURCE_PRIORITY[r[1]], -r[0][2] * r[0][3])):
            near = next((k for k in kept if overlap(k[0], b) > config.PROPOSAL_IOU), None)
            if near is None:
                kept.append([b, source])
            else:
                a = near[0]
                x, y = min(a[0], b[0]), min(a[1], b[1])
                near[0] = (x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y)
        return [tuple(k) for k in kept]

    share, n = config.PROPOSAL_PAD, config.PROPOSAL_GRID
    padded = [(inside(x - w * share, y - h * share, w + 2 * (w * share), h + 2 * (h * share), width, height), s) for (x, y, w, h), s in hints]
    low, high = config.PROPOSAL_AREA
    fair = [(b, s) for b, s in padded if b and low <= b[2] * b[3] / (width * height) <= high]
    rest = [((0, 0, width, height), "full")]
    if min(width, height) >= 2:
        tiles = [inside(c * (width / (n + 1)), r * (height / (n + 1)), width / n, height / n, width, height) for r in range(n + 1) for c in range(n + 1)]
        rest += [(b, "tile") for b in tiles if b]
    return [b for b, _ in merged(merged(fair)[: max(0, config.PROPOSAL_BUDGET - len(rest))] + rest)]


class _Signal:
    """Scores one decoded picture at a time; what it needs is made once."""

    name, needs = "", ""

    def ready(self) -> str:
        """Makes what scoring needs; says what is missing."""
        return "" if _plugs[self.needs] else f"no {self.needs}"

    def one(self, bgr: np.ndarray) -> tuple[float, tuple | None, str]:
        raise NotImplementedError

    def score(self, batch: pd.DataFrame) -> pd.DataFrame:
        why, rows = self.ready(), []
        if why and self.name not in _said:
            _said.add(self.name)
            warnings.warn(f"signal {self.name!r} scores 0: {why}", stacklevel=2)
        for h, w, data in zip(batch["height"], batch["width"], batch["data"], strict=True):
            rows.append((0.0, None, why) if why else self.one(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)))
        boxes = [None if b is None else dict(zip("xywh", map(int, b), strict=True)) for _, b, _ in rows]
        return pd.DataFrame({"score": [r[0] for r in rows], "bbox": pd.Series(boxes, dtype=object), "detail": [r[2] for r in rows]})


_read: dict[bytes, list] = {}


def read_text(bgr: np.ndarray) -> list:
    """The lines of a picture; the last picture's are remembered, so text and region signals read it once."""
    key = bgr.tobytes()
    if key not in _read:
        _read.clear()
        _read[key] = list(_plugs["reader"](bgr))
    return _read[key]


def around(points) -> tuple[int, int, int, int]:
    """The box of corner points: a whole corner, sides of at least 1."""
    x, y = np.asarray(points, float).T
    return int(x.min()), int(y.min()), max(1, round(x.max() - x.min())), max(1, round(y.max() - y.min()))


class TextSignal(_Signal):
    name, needs = "ocr", "reader"

    def ready(self) -> str:
        return super().ready() or ("" if _plugs["terms"] else "no terms")

    def one(self, bgr):
        lines = read_text(bgr)
        if not lines:
            return 0.0, None, ""
        found = best_terms([t or "" for t, _, _ in lines], term_table(_plugs["terms"]))
        scores = [found.loc[t or "", "score"] / 100 * conf for t, conf, _ in lines]
        k = int(np.argmax(scores))
        if scores[k] <= 0:
            return 0.0, None, ""
        return min(1.0, float(scores[k])), around(lines[k][2]), f"{found.loc[lines[k][0] or '', 'term']}: {lines[k][0]}"


class KeypointSignal(_Signal):
    name, needs = "sift", "extractor"

    def __init__(self):
        self.templates = None

    def ready(self) -> str:
        if why := super().ready():
            return why
        if self.templates is None:
            self.templates = []
            for name, bgr in template_pictures(_plugs["templates"]):
                g = gray(upscaled(bgr))
                points, desc = _plugs["extractor"](g)
                if len(points) >= config.SIFT_MIN_GOOD:
                    self.templates.append({"name": name, "points": np.asarray(points, float), "desc": np.asarray(desc, float), "h": g.shape[0], "w": g.shape[1]})
        return "" if self.templates else "no templates"

    def one(self, bgr):
        points, desc = _plugs["extractor"](gray(bgr))
        if len(points) < 2:
            return 0.0, None, ""
        image, (height, width) = {"points": np.asarray(points, float), "desc": np.asarray(desc, float)}, bgr.shape[:2]

        def plausible(q: np.ndarray) -> bool:
            if q.shape != (4, 2) or not np.isfinite(q).all():
                return False
            side = np.roll(q, -1, 0) - q
            turn = side[:, 0] * np.roll(side, -1, 0)[:, 1] - side[:, 1] * np.roll(side, -1, 0)[:, 0]
            area = abs((q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1]).sum()) / 2
            edge, (cx, cy) = np.sqrt((side**2).sum(1)), q.mean(0)
            low, high = config.QUAD_AREA
            fair = low <= area / (width * height) <= high and edge.min() >= config.QUAD_EDGE and edge.max() <= config.QUAD_EDGE_RATIO * edge.min()
            return bool(((turn >= 0).all() or (turn <= 0).all()) and fair and 0 <= cx < width and 0 <= cy < height)

        scored = [(*signals.keypoint_score(t, image, plausible), t["name"]) for t in self.templates]
        score, corners, name = max(scored, key=lambda r: r[0])
        if corners is None:
            return 0.0, None, ""
        (x0, y0), (x1, y1) = np.floor(corners.min(0)).clip(0), np.minimum(np.ceil(corners.max(0)), (width, height))
        return float(score), (x0, y0, max(1, x1 - x0), max(1, y1 - y0)), name


class EmbeddingSignal(_Signal):
    name, needs = "emb", "embedder"

    def __init__(self):
        self.vectors = None

    def embed(self, crops: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of crops, BATCH at a time."""
        parts = [np.asarray(_plugs["embedder"](np.stack([signals.prepared(c) for c in crops[i : i + BATCH]])), float) for i in range(0, len(crops), BATCH)]
        v = np.concatenate(parts)
        return v / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]

    def ready(self) -> str:
        if why := super().ready():
            return why
        if self.vectors is None:
            pictures = template_pictures(_plugs["templates"])
            self.names = [n for n, _ in pictures]
            self.vectors = self.embed([p for _, p in pictures]) if pictures else np.zeros((0, 1))
        return "" if len(self.vectors) else "no templates"

    def one(self, bgr):
        height, width = bgr.shape[:2]
        hints = [(around(p), "text") for _, _, p in read_text(bgr)] if _plugs["reader"] else []
        found = regions(hints, width, height)
        cosines = self.embed([signals.crop(bgr, b) for b in found]) @ self.vectors.T
        k, t = np.unravel_index(int(np.argmax(cosines)), cosines.shape)
        best = float(cosines[k, t])
        return (0.0, None, "below floor") if best < config.EMBEDDING_FLOOR else (min(1.0, best), found[k], self.names[t])


def install() -> None:
    """Registers the three signals, where their names are free."""
    kinds: tuple[Callable[[], _Signal], ...] = (TextSignal, KeypointSignal, EmbeddingSignal)
    for kind in kinds:
        if kind.name not in signals.available():
            signals.register(kind.name, kind)
