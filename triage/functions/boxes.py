"""Box expressions over struct<x, y, w, h> columns of whole pixels; rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import config

BOX = "struct<x:int,y:int,w:int,h:int>"


def box(x, y, w, h) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip((x, y, w, h), "xywh", strict=True)])


def whole(x: Column) -> Column:
    return F.bround(x.cast("double"), 0).cast("int")


def between(low: Column, high: Column, left: Column, upper: Column, width: Column, height: Column) -> Column:
    """Box of two corners within a frame, null if nothing of it is."""
    x0, y0 = F.greatest(F.lit(0), left), F.greatest(F.lit(0), upper)
    x1, y1 = F.least(width, low), F.least(height, high)
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1 - x0, y1 - y0))


def placed(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The part inside a frame of a box whose place and size are rounded to whole pixels, null if none."""
    left, upper = whole(x), whole(y)
    return between(left + F.greatest(F.lit(0), whole(w)), upper + F.greatest(F.lit(0), whole(h)), left, upper, width, height)


def clip(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside a frame, null if none."""
    return placed(b["x"], b["y"], b["w"], b["h"], width, height)


def pad(b: Column, width: Column, height: Column, share: float = config.PROPOSAL_PAD) -> Column:
    """A proposal's box grown by a share of its sides on each side; its place and its grown size are rounded."""
    dx, dy = b["w"] * F.lit(share), b["h"] * F.lit(share)
    return placed(b["x"] - dx, b["y"] - dy, b["w"] + 2 * dx, b["h"] + 2 * dy, width, height)


def crop_pad(b: Column, width: Column, height: Column, share: float = config.CROP_PAD) -> Column:
    """A crop's box grown by a share of its sides; the growth is rounded, not the edges."""
    dx, dy = whole(b["w"] * F.lit(share)), whole(b["h"] * F.lit(share))
    return between(b["x"] + b["w"] + dx, b["y"] + b["h"] + dy, b["x"] - dx, b["y"] - dy, width, height)


def area_ok(b: Column, width: Column, height: Column, limits=config.PROPOSAL_AREA) -> Column:
    share = (b["w"].cast("double") * b["h"]) / (width.cast("double") * height)
    return share.between(*limits)


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = a["w"].cast("double") * a["h"] + b["w"].cast("double") * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def of_points(points: Column) -> Column:
    """Box around an array of struct<x, y> points: whole corner, sides of at least 1."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, y0 = F.array_min(x).cast("int"), F.array_min(y).cast("int")
    return box(x0, y0, F.greatest(F.lit(1), whole(F.array_max(x) - F.array_min(x))), F.greatest(F.lit(1), whole(F.array_max(y) - F.array_min(y))))


def quad_box(points: Column, scale: Column, width: Column, height: Column) -> Column:
    """Box of a quad's corners, taken back by a scale: outward to whole pixels, inside the frame, sides of at least 1."""
    x, y = F.transform(points, lambda p: p["x"] / scale), F.transform(points, lambda p: p["y"] / scale)
    x0, y0 = F.greatest(F.lit(0), F.floor(F.array_min(x))), F.greatest(F.lit(0), F.floor(F.array_min(y)))
    x1, y1 = F.least(width, F.ceil(F.array_max(x))), F.least(height, F.ceil(F.array_max(y)))
    return box(x0, y0, F.greatest(F.lit(1), x1 - x0), F.greatest(F.lit(1), y1 - y0))


def quad_ok(points: Column, width: Column, height: Column) -> Column:
    """Whether four corners are a plausible view: finite, convex, of fair area and edges, centred in the frame."""
    p = [F.get(points, F.lit(i)) for i in range(4)]
    finite = F.forall(points, lambda q: ~F.isnan(q["x"]) & ~F.isnan(q["y"]) & (F.abs(q["x"]) < 1e9) & (F.abs(q["y"]) < 1e9))
    whole_ = [(q["x"].cast("long"), q["y"].cast("long")) for q in p]
    turns = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = (whole_[(i + k) % 4] for k in range(3))
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    convex = F.least(*turns) >= 0
    convex = convex | (F.greatest(*turns) <= 0)
    area = F.abs(sum((p[i]["x"] * p[(i + 1) % 4]["y"] - p[(i + 1) % 4]["x"] * p[i]["y"] for i in range(4)), F.lit(0.0))) / 2
    share = area / (width.cast("double") * height)
    edges = [F.sqrt((p[i]["x"] - p[(i + 1) % 4]["x"]) ** 2 + (p[i]["y"] - p[(i + 1) % 4]["y"]) ** 2) for i in range(4)]
    shortest, longest = F.least(*edges), F.greatest(*edges)
    cx, cy = sum((q["x"] for q in p), F.lit(0.0)) / 4, sum((q["y"] for q in p), F.lit(0.0)) / 4
    inside = (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
    fair = (shortest >= config.QUAD_EDGE) & (longest <= config.QUAD_EDGE_RATIO * shortest)
    return F.coalesce((F.size(points) == 4) & finite & convex & share.between(*config.QUAD_AREA) & fair & inside, F.lit(False))


def tiles(width: Column, height: Column, grid: int = config.PROPOSAL_GRID) -> Column:
    """Array of struct<bbox, source>: the frame, then (grid + 1)^2 tiles of a grid-th of its sides at steps of a (grid + 1)-th.

    Steps and sizes are fractions until a tile is placed. A frame under 2 pixels has no tiles.
    """
    frame = F.array(F.struct(box(F.lit(0), F.lit(0), width, height).alias("bbox"), F.lit("full").alias("source")))
    if grid < 1:
        return frame
    w, h = width / grid, height / grid
    sx, sy = width / (grid + 1), height / (grid + 1)
    steps = F.sequence(F.lit(0), F.lit(grid))

    def tile(r: Column, c: Column) -> Column:
        b = placed(c * sx, r * sy, w, h, width, height)
        return F.struct(b.alias("bbox"), F.lit("tile").alias("source"))

    all_ = F.filter(F.flatten(F.transform(steps, lambda r: F.transform(steps, lambda c: tile(r, c)))), lambda t: t["bbox"].isNotNull())
    return F.when((width < 2) | (height < 2), frame).otherwise(F.concat(frame, all_))


def merged(regions: Column, limit: float = config.PROPOSAL_IOU) -> Column:
    """Regions (bbox, source) by priority and falling area, each joined to the first kept one that it overlaps enough.

    One pass: a kept box grows with what joins it, and later regions meet the grown box.
    """
    rank = F.create_map(*[F.lit(x) for k, v in config.SOURCE_PRIORITY.items() for x in (k, v)])
    keyed = F.transform(
        regions, lambda r, i: F.struct(rank[r["source"]].alias("p"), (-(r["bbox"]["w"] * r["bbox"]["h"])).alias("a"), i.alias("i"), r["bbox"].alias("bbox"), r["source"].alias("source"))
    )
    ordered = F.transform(F.sort_array(keyed), lambda r: F.struct(r["bbox"].alias("bbox"), r["source"].alias("source")))
    empty = F.array().cast(f"array<struct<bbox:{BOX},source:string>>")

    def step(kept: Column, r: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: iou(k["bbox"], r["bbox"]) > limit), True)
        grown = F.transform(kept, lambda k, i: F.when(i + 1 == at, F.struct(union(k["bbox"], r["bbox"]).alias("bbox"), k["source"].alias("source"))).otherwise(k))
        return F.when(at > 0, grown).otherwise(F.concat(kept, F.array(r)))

    return F.aggregate(ordered, empty, step)


def propose(hints: Column, width: Column, height: Column, budget: int = config.PROPOSAL_BUDGET) -> Column:
    """Regions of a picture: padded and merged hints within the budget, then the frame and tiles merged in."""
    padded = F.transform(hints, lambda r: F.struct(pad(r["bbox"], width, height).alias("bbox"), r["source"].alias("source")))
    fair = F.filter(padded, lambda r: r["bbox"].isNotNull() & area_ok(r["bbox"], width, height))
    rest = tiles(width, height)
    top = F.slice(merged(fair), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - F.size(rest)))
    return merged(F.concat(top, rest))
