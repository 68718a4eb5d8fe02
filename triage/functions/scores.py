"""Score expressions: bands, normalised confidence, decisions over arrays of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triage import config

SIGNAL = "array<struct<name:string,score:double,bbox:struct<x:int,y:int,w:int,h:int>,detail:string>>"


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def band_rank(score: Column, weak, strong) -> Column:
    """2 positive, 1 review, 0 negative; thresholds are met, not passed."""
    return F.when(score >= strong, 2).when(score >= weak, 1).otherwise(0)


def band_name(rank: Column) -> Column:
    return F.when(rank == 2, "positive").when(rank == 1, "review").otherwise("negative")


def band_of(score: Column, weak, strong) -> Column:
    return band_name(band_rank(score, weak, strong))


def band_for(confidence: Column) -> Column:
    """Band of a normalised confidence, by the anchors."""
    return band_of(confidence, F.lit(config.ANCHOR_WEAK), F.lit(config.ANCHOR_STRONG))


def normalize(score: Column, weak, strong) -> Column:
    """Piecewise linear through (0, 0), (weak, .50), (strong, .85), (1, 1); an empty span is its upper anchor."""
    weak, strong = (x if isinstance(x, Column) else F.lit(float(x)) for x in (weak, strong))

    def line(low: Column, high: Column, from_: float, to: float) -> Column:
        share = F.try_divide(score - low, high - low)
        return F.when(high > low, F.lit(from_) + share * F.lit(to - from_))

    top = F.coalesce(line(strong, F.lit(1.0), config.ANCHOR_STRONG, 1.0), F.lit(config.ANCHOR_STRONG))
    middle = F.coalesce(line(weak, strong, config.ANCHOR_WEAK, config.ANCHOR_STRONG), F.lit(config.ANCHOR_WEAK))
    bottom = F.coalesce(line(F.lit(0.0), weak, 0.0, config.ANCHOR_WEAK), F.lit(0.0))
    return clamp(F.when(score >= strong, top).when(score >= weak, middle).otherwise(bottom))


def limits(name: Column, settings: config.Settings) -> tuple[Column, Column]:
    """(weak, strong) of a signal's name."""
    weak, strong = F.lit(settings.fallback[0]), F.lit(settings.fallback[1])
    for k, (w, s) in settings.thresholds.items():
        weak, strong = F.when(name == k, F.lit(float(w))).otherwise(weak), F.when(name == k, F.lit(float(s))).otherwise(strong)
    return weak, strong


def decide(signals: Column, settings: config.Settings) -> Column:
    """struct<band, confidence, method, bbox, detail> of an array of signal structs, without a shuffle.

    The best band that any signal claims wins. Its signals stand by falling
    normalised score, then name; the first is the confidence and detail, and
    the first of them that has a box gives the box. Negatives have none.
    """
    ranked = F.transform(
        signals,
        lambda s: F.struct(
            (-normalize(s["score"], *limits(s["name"], settings))).alias("order"),
            s["name"].alias("name"),
            band_rank(s["score"], *limits(s["name"], settings)).alias("rank"),
            s["bbox"].alias("bbox"),
            s["detail"].alias("detail"),
        ),
    )

    def verdict(r: Column) -> Column:
        top = F.array_max(F.transform(r, lambda s: s["rank"]))
        winners = F.sort_array(F.filter(r, lambda s: s["rank"] == top))
        first = F.get(winners, F.lit(0))
        negative = F.coalesce(top, F.lit(0)) == 0
        with_box = F.get(F.filter(winners, lambda s: s["bbox"].isNotNull()), F.lit(0))
        return F.struct(
            band_name(F.coalesce(top, F.lit(0))).alias("band"),
            F.coalesce(-first["order"], F.lit(0.0)).alias("confidence"),
            F.when(negative, "none").otherwise(F.array_join(F.transform(winners, lambda s: s["name"]), "+")).alias("method"),
            F.when(~negative, with_box["bbox"]).alias("bbox"),
            F.when(F.size(r) == 0, "no signals enabled").otherwise(first["detail"]).alias("detail"),
        )

    return F.transform(F.array(ranked), verdict)[0]


def wilson(successes: Column, total: Column, z: float = config.WILSON_Z) -> Column:
    """struct<low, high>: Wilson's interval of a share, (0, 1) without trials."""
    n = total.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    bottom = 1 + F.try_divide(F.lit(z * z), n)
    middle = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n), bottom)
    reach = F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), bottom)
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), middle - reach), F.lit(0.0)).alias("low"), F.coalesce(F.least(F.lit(1.0), middle + reach), F.lit(1.0)).alias("high"))


def duration(seconds: Column) -> Column:
    """Seconds, rounded half to even, as h/m/s text; n/a where there are none."""
    s = F.bround(seconds.cast("double"), 0).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(s.isNull(), "n/a").when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
