"""Settings of the engine: thresholds are data, passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# The published defaults that results have to agree with.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "avif")
JUNK_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
MAX_SIDE = 1600
BANDS = ("positive", "review", "negative")
ANCHOR_WEAK, ANCHOR_STRONG = 0.50, 0.85
THRESHOLDS = {"emb": (0.85, 0.90), "ocr": (0.65, 0.75), "sift": (0.30, 0.30)}
FALLBACK = (0.60, 0.85)
TARGET_RECALL, TARGET_REVIEW = 0.97, 0.10
EPSILON = 1e-9
CALIBRATION_GRID = tuple(round(0.05 * i, 2) for i in range(1, 21))
SWEEP_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
DHASH_SIZE, DHASH_BUDGET = 8, 4
DEGENERATE_HASHES = (0, -1)  # all bits clear, all bits set
MIN_FUZZ, MIN_TEXT = 80.0, 3
EMBEDDING_FLOOR = 0.30
PROPOSAL_BUDGET, PROPOSAL_PAD, PROPOSAL_IOU, PROPOSAL_GRID = 24, 0.15, 0.55, 3
PROPOSAL_AREA = (0.0004, 0.90)
SOURCE_PRIORITY = {"text": 0, "sift": 1, "mser": 2, "tile": 3, "full": 4}
CROP_PAD = 0.10
SIFT_RATIO, SIFT_MIN_GOOD, SIFT_MIN_INLIERS, SIFT_REPROJECTION, SIFT_NORM = 0.75, 8, 8, 5.0, 25
QUAD_AREA, QUAD_EDGE, QUAD_EDGE_RATIO = (0.0002, 4.0), 8.0, 12.0
WILSON_Z = 1.96


@dataclass(frozen=True)
class Settings:
    """What a scan or calibration runs with."""

    thresholds: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(THRESHOLDS))
    fallback: tuple[float, float] = FALLBACK
    signals: tuple[str, ...] = ("ocr", "sift", "emb")
    version: int = 1

    def of(self, signal: str) -> tuple[float, float]:
        return self.thresholds.get(signal, self.fallback)


def signal_list(text: str | None, default: tuple[str, ...] = ("ocr", "sift", "emb")) -> tuple[str, ...]:
    """Names of a comma-separated option; None is the default, an empty text none."""
    if text is None:
        return default
    return tuple(x for x in (part.strip() for part in text.split(",")) if x)
