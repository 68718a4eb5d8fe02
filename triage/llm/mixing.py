"""Operator 2: mixing sources to target weights with a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], piecewise
linear between knots. Its integral, scaled to the source's target, is the
source's cumulative token demand. Documents of a source stand in hash order;
the words before a document (over one or two passes) are a point of that
demand, and the inverse of the integral there is the document's training
position. A range sort by position gives the training order. All of it is
DataFrame functions.

Defined results: null text has size 0 and is never taken; null source is one
source, after all others; equal rows are mixed as separate documents; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.llm.common import WORD, salted_join, stored

#: Weights of the sources by code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Schedules dealt to the sources in turn: (time, relative weight) knots.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.6), (0.3, 1.0), (1.0, 0.7)),
)
SHARE, CAP = 1.5, 2.0
#: Documents of one prefix-sum bucket, about.
BUCKET_ROWS = 256


def text_size(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def integral(knots) -> list[tuple[float, float, float, float, float]]:
    """Segments (t0, t1, w0, w1, area before), areas scaled to 1 in all."""
    raw = [(a[0], b[0], a[1], b[1], (a[1] + b[1]) / 2 * (b[0] - a[0])) for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(x[4] for x in raw), 0.0, []
    for t0, t1, w0, w1, area in raw:
        out.append((t0, t1, w0 / total, w1 / total, done))
        done += area / total
    return out


def inverse(knots, share: Column) -> Column:
    """The time at which the integral of the schedule reaches share (0 to 1)."""
    out = F.lit(1.0)
    for t0, t1, w0, w1, before in reversed(integral(knots)):
        slope, rest = (w1 - w0) / (t1 - t0), share - F.lit(before)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + rest / F.lit(w0)
        else:  # w0 x + slope x^2 / 2 = rest
            t = F.lit(t0) + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * rest)) - F.lit(w0)) / F.lit(slope)
        after = before + (w0 + w1) / 2 * (t1 - t0)
        out = F.when(share < F.lit(after), F.least(F.lit(t1), F.greatest(F.lit(t0), t))).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source (source, source_size): rank, weight and target, stopped at cap times its size.

    Sources stand by cap/weight; the water level of the first prefix that can
    be capped whole is the level of all others, which is where resharing ends.
    The table has a row for each source, already summed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("nth"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("most") >= F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("nth"), F.col("level")))).over(everything)
    # None free: rounding left a hair above all caps, so every source stands at its cap.
    return leveled.withColumn("water", F.coalesce(first["level"], F.lit(float("inf")))).select(
        "source", "nth", "source_size", F.least(F.col("most"), F.col("water") * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, size: Column, carry: tuple[str, ...] = (), seed: int = 17, weights=WEIGHTS, schedules=SCHEDULES, share=SHARE, cap=CAP) -> DataFrame:
    """Every document with size, source_size, target, taken and its training positions.

    positions holds a time for each time that the document is taken: pass p of
    a source takes it if the middle of its words lies below the target.
    """
    names = list(dict.fromkeys(("doc_id", *carry)))
    rows = docs.select(*names, *([] if "source" in names else ["source"]), size.alias("__size"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = rows.withColumn("__h", order)
    most = docs.groupBy("source").count().agg(F.max("count")).collect()[0][0] or 1
    bits = max(1, min(40, (most // BUCKET_ROWS).bit_length()))
    # Prefix sums in two steps: over the buckets of a source (few rows), then inside a bucket.
    bucket = F.shiftrightunsigned(order, 64 - bits)
    buckets = stored(docs.select("source", bucket.alias("__b"), size.alias("__size")).groupBy("source", "__b").agg(F.sum("__size").alias("__sum")), "mix-sums")
    goal = targets(buckets.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, share, cap)
    rows = rows.withColumn("__b", F.shiftrightunsigned("__h", 64 - bits)).withColumn("__o", F.col("__h").bitwiseAND(F.lit((1 << (64 - bits)) - 1)))
    blocks = _prefix(buckets, bits)
    inside = Window.partitionBy("source", "__b").orderBy("__o", "doc_id", "__size", *[c for c in carry if c not in ("doc_id", "source")]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__upto", F.sum("__size").over(inside))
    rows = rows.join(blocks.withColumnsRenamed({"source": "__bs", "__b": "__bb"}), F.col("source").eqNullSafe(F.col("__bs")) & (F.col("__b") == F.col("__bb")), "left").drop("__bs", "__bb")
    rows = salted_join(rows, goal, ["source"], F.col("__b"))
    middle = F.col("__before") + F.col("__upto") - F.col("__size") / 2
    passes = F.array(*[F.lit(float(p)) for p in range(int(-(-cap // 1)))])
    due = F.filter(F.transform(passes, lambda p: p * F.col("source_size") + middle), lambda x: (x < F.col("target")) & (F.col("__size") > 0))

    def position(x: Column) -> Column:
        done, out = x / F.col("target"), F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            out = F.when(F.pmod(F.col("nth"), F.lit(len(schedules))) == i, inverse(knots, done)).otherwise(out)
        return out

    return rows.withColumn("positions", F.transform(due, position)).select(
        *names, F.col("__size").alias("size"), "source_size", "target", (F.size("positions") * F.col("__size")).cast("long").alias("taken"), "positions"
    )


def _prefix(buckets: DataFrame, bits: int) -> DataFrame:
    """Words of a source before each of its buckets; buckets of buckets keep every window short."""
    if bits <= 12:
        w = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        return buckets.select("source", "__b", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    top = buckets.withColumn("__t", F.shiftright("__b", 12))
    above = top.groupBy("source", "__t").agg(F.sum("__sum").alias("__sum"))
    before = _prefix(above.withColumnRenamed("__t", "__b"), bits - 12).select(F.col("source").alias("__ts"), F.col("__b").alias("__tt"), F.col("__before").alias("__above"))
    w = Window.partitionBy("source", "__t").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inner = top.withColumn("__in", F.coalesce(F.sum("__sum").over(w), F.lit(0)))
    return inner.join(before, F.col("source").eqNullSafe(F.col("__ts")) & (F.col("__t") == F.col("__tt"))).select("source", "__b", (F.col("__above") + F.col("__in")).alias("__before"))


def training_order(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: each taken document once a time it is taken, range-sorted by position.

    Ties stand by id, then by a hash of the text: bounds of ranges are sampled
    on the driver, which must not get whole texts.
    """
    taken = mix(docs, text_size(), carry=tuple(columns)).withColumn("__position", F.explode("positions"))
    return taken.orderBy("__position", "doc_id", F.xxhash64("text")).select(*columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them, in order of their first training position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, text_size())
    out = mixed.withColumn("position", F.get("positions", F.lit(0))).drop("positions")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
