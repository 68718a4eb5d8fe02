"""Labelled evaluation: metrics, sweeps, calibration, gate.

Scores come as rows (item, label, signals array) or long (item, label, signal, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage import config
from triage.functions.scores import band_rank, decide, limits, normalize


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def judged(scored: DataFrame, settings: config.Settings) -> DataFrame:
    """Adds band, confidence, method, bbox and detail to rows with a signals array."""
    return scored.withColumn("__d", decide(F.col("signals"), settings)).select(*scored.columns, "__d.*")


def counts(rows: DataFrame) -> DataFrame:
    """Label x band counts, zero-filled."""
    one = rows.agg(*[F.count_if((F.col("label") == lab) & (F.col("band") == b)).alias(f"{lab}_{b}") for lab in ("positive", "negative") for b in config.BANDS])
    each = [F.struct(F.lit(lab).alias("label"), F.lit(b).alias("band"), F.col(f"{lab}_{b}").alias("n")) for lab in ("positive", "negative") for b in config.BANDS]
    return one.select(F.inline(F.array(*each)))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of what the bands are worth against the labels, ratios rounded to 4."""
    pos, flagged = F.col("label") == "positive", F.col("band") == "positive"
    caught = F.col("band") != "negative"
    sums = rows.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(pos).alias("positives"),
        F.count_if(~pos).alias("negatives"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged & pos).alias("hits"),
        F.count_if(caught & pos).alias("caught"),
        F.count_if(F.col("band") == "review").alias("in_review"),
    )
    return sums.select(
        "images",
        "positives",
        "negatives",
        "flagged",
        "caught",
        "in_review",
        (F.col("positives") - F.col("caught")).alias("missed"),
        F.round(share(F.col("hits"), F.col("flagged")), 4).alias("precision"),
        F.round(share(F.col("caught"), F.col("positives")), 4).alias("catch_recall"),
        F.round(share(F.col("in_review"), F.col("images")), 4).alias("review_share"),
    )


def wins(rows: DataFrame) -> DataFrame:
    """How often each signal is the first winner, of items that aren't negative."""
    first = F.get(F.split("method", r"\+"), F.lit(0))
    return rows.filter("band <> 'negative'").groupBy(first.alias("signal")).agg(F.count(F.lit(1)).alias("wins"))


def misses(rows: DataFrame, item: str = "item") -> DataFrame:
    return rows.filter("label = 'positive' and band = 'negative'").select(item)


def false_alarms(rows: DataFrame, item: str = "item") -> DataFrame:
    return rows.filter("label = 'negative' and band = 'positive'").select(item)


def miss_reason(signals: Column, settings: config.Settings) -> Column:
    """Why a positive was missed: invisible to all, or the loudest signal and how far it is from its weak threshold."""
    named = F.transform(signals, lambda s: F.struct((-s["score"]).alias("order"), s["name"].alias("name"), limits(s["name"], settings)[0].alias("weak")))

    def say(n: Column) -> Column:
        top = F.get(n, F.lit(0))
        quiet = F.size(n) == 0
        return F.when(quiet | (-top["order"] <= 0), "invisible to every signal").otherwise(
            F.concat(top["name"], F.lit(" reached "), F.format_string("%.2f", -top["order"]), F.lit(", needs "), F.format_string("%.2f", top["weak"]))
        )

    return F.transform(F.array(F.sort_array(named)), say)[0]


# -- sweeps ---------------------------------------------------------------


def long_scores(scored: DataFrame) -> DataFrame:
    """(signal, label, score), missing scores as 0."""
    return scored.select("label", F.explode("signals").alias("s")).select(F.col("s.name").alias("signal"), "label", F.coalesce("s.score", F.lit(0.0)).alias("score"))


def combined(scored: DataFrame, name: str = "all") -> DataFrame:
    """The naive OR: each item's largest raw score as a signal of its own (not what decide() does)."""
    best = F.coalesce(F.array_max(F.transform("signals", lambda s: s["score"])), F.lit(0.0))
    return scored.select(F.lit(name).alias("signal"), "label", best.alias("score"))


def levels(rows: DataFrame, grid=config.SWEEP_GRID) -> DataFrame:
    """Per signal: at each grid threshold, positives and items that reach it.

    Items are counted once by the highest level that they reach; running sums
    from above give every threshold. Only grid-sized tables go further.
    """
    level = sum((F.when(F.col("score") >= F.lit(g), 1).otherwise(0) for g in grid), F.lit(0))
    hist = rows.groupBy("signal", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "positive").alias("p"))
    grid_rows = F.array(*[F.struct(F.lit(i + 1).alias("level"), F.lit(float(g)).alias("threshold")) for i, g in enumerate(grid)])
    every = hist.groupBy("signal").agg(F.sum("n").alias("items"), F.sum("p").alias("positives")).select("*", F.inline(grid_rows))
    reached = every.alias("e").join(hist.alias("h"), (F.col("e.signal") == F.col("h.signal")) & (F.col("h.level") >= F.col("e.level")), "left")
    return reached.groupBy("e.signal", "e.level", "threshold", "items", "positives").agg(F.coalesce(F.sum("h.n"), F.lit(0)).alias("reach"), F.coalesce(F.sum("h.p"), F.lit(0)).alias("reach_positive"))


def curve(rows: DataFrame, grid=config.SWEEP_GRID) -> DataFrame:
    """Recall and precision of one threshold a signal, over the grid."""
    at = levels(rows, grid)
    return at.select("signal", "threshold", F.round(share(F.col("reach_positive"), F.col("positives")), 4).alias("recall"), F.round(share(F.col("reach_positive"), F.col("reach")), 4).alias("precision"))


def sweep(rows: DataFrame, grid=config.SWEEP_GRID) -> DataFrame:
    """All pairs review <= positive of the grid a signal, with what each is worth."""
    at = levels(rows, grid)
    low = at.select("signal", "items", "positives", F.col("threshold").alias("review_t"), F.col("reach").alias("low"), F.col("reach_positive").alias("low_positive"))
    high = at.select(F.col("signal").alias("__s"), F.col("threshold").alias("positive_t"), F.col("reach").alias("high"), F.col("reach_positive").alias("high_positive"))
    pairs = low.join(high, (F.col("signal") == F.col("__s")) & (F.col("review_t") <= F.col("positive_t")))
    return pairs.select(
        "signal",
        "review_t",
        "positive_t",
        share(F.col("high_positive"), F.col("high")).alias("precision"),
        share(F.col("low_positive"), F.col("positives")).alias("catch_recall"),
        share(F.col("low") - F.col("high"), F.col("items")).alias("review_share"),
        (F.col("positives") - F.col("low_positive")).alias("missed"),
    )


def best_point(points: DataFrame) -> DataFrame:
    """Per signal the point of most recall, then precision, then least review; of equals the smallest thresholds."""
    w = Window.partitionBy("signal").orderBy(F.desc("catch_recall"), F.desc("precision"), "review_share", "review_t", "positive_t")
    return points.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


# -- calibration ----------------------------------------------------------


def cube(scored: DataFrame, names: list[str], grid=config.CALIBRATION_GRID) -> DataFrame:
    """Cells (t1 .. tk) with the items, and positives, that lie below every t: running sums of a histogram.

    One pass over the items, then at most (len(grid) + 1)^k cells.
    """
    by_name = F.map_from_entries(F.transform("signals", lambda s: F.struct(s["name"], F.coalesce(s["score"], F.lit(0.0)))))
    score = [F.coalesce(F.element_at(by_name, F.lit(n)), F.lit(0.0)) for n in names]
    axes = [f"t{i}" for i in range(len(names))]
    # An item is below grid[j] if it reaches j of the thresholds at most.
    level = [sum((F.when(s >= F.lit(g - config.EPSILON), 1).otherwise(0) for g in grid), F.lit(0)).alias(a) for s, a in zip(score, axes, strict=True)]
    hist = scored.select("label", *level).groupBy(*axes).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "positive").alias("p"))
    cells = scored.sparkSession.range(1)
    for a in axes:
        cells = cells.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(len(grid)))))
    cells = cells.drop("id").join(F.broadcast(hist), axes, "left").fillna(0, ["n", "p"])
    for a in axes:
        w = Window.partitionBy(*[x for x in axes if x != a]).orderBy(a).rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("n", F.sum("n").over(w)).withColumn("p", F.sum("p").over(w))
    # Level j is "below grid[j]", so the last is everything, which no threshold pair uses.
    return cells


def combinations(scored: DataFrame, names: list[str], grid=config.CALIBRATION_GRID) -> DataFrame:
    """Every choice of weak <= strong a signal with precision, catch_recall and review_share under the OR rule."""
    c = cube(scored, names, grid)
    axes = [f"t{i}" for i in range(len(names))]
    full = len(grid)
    total = c.filter(" and ".join(f"{a} = {full}" for a in axes)).select(F.col("n").alias("items"), F.col("p").alias("positives"))
    inner = c.filter(" and ".join(f"{a} < {full}" for a in axes))
    weak = inner.select(*[F.col(a).alias(f"w{i}") for i, a in enumerate(axes)], F.col("n").alias("wn"), F.col("p").alias("wp"))
    strong = inner.select(*[F.col(a).alias(f"s{i}") for i, a in enumerate(axes)], F.col("n").alias("sn"), F.col("p").alias("sp"))
    pairs = weak
    on = F.lit(True)
    for i in range(len(axes)):
        on = on & (F.col(f"w{i}") <= F.col(f"s{i}"))
    pairs = weak.join(F.broadcast(strong), on).crossJoin(F.broadcast(total))
    names_out = []
    for i, n in enumerate(names):
        names_out += [_grid_value(f"w{i}", grid).alias(f"{n}_weak"), _grid_value(f"s{i}", grid).alias(f"{n}_strong")]
    return pairs.select(
        *names_out,
        (F.col("items") - F.col("sn")).alias("flagged"),
        (F.col("positives") - F.col("sp")).alias("tp"),
        share(F.col("positives") - F.col("sp"), F.col("items") - F.col("sn")).alias("precision"),
        share(F.col("positives") - F.col("wp"), F.col("positives")).alias("catch_recall"),
        share(F.col("sn") - F.col("wn"), F.col("items")).alias("review_share"),
    )


def _grid_value(column: str, grid) -> Column:
    return F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col(column) + 1)


def feasible(recall: float = config.TARGET_RECALL, review: float = config.TARGET_REVIEW) -> Column:
    return (F.col("catch_recall") >= recall - config.EPSILON) & (F.col("review_share") <= review + config.EPSILON)


def relaxed_target(combos: DataFrame, recall: float, review: float) -> DataFrame:
    """(feasible, attainable, target): the recall that can be asked for under the review cap, or at all if the cap cannot be met."""
    under = F.col("review_share") <= review + config.EPSILON
    out = combos.agg(
        F.count_if(feasible(recall, review)).alias("feasible"),
        F.max(F.when(under, F.col("catch_recall"))).alias("attainable_under"),
        F.max("catch_recall").alias("attainable_any"),
    )
    any_under = F.col("attainable_under").isNotNull()
    return out.select(
        "feasible",
        F.coalesce("attainable_under", "attainable_any").alias("attainable"),
        F.when(F.col("feasible") > 0, F.lit(recall)).otherwise(F.coalesce("attainable_under", "attainable_any")).alias("target"),
        F.when((F.col("feasible") > 0) | any_under, F.lit(review)).otherwise(F.lit(1.0)).alias("cap"),
    )


def search(scored: DataFrame, names: list[str], recall: float = config.TARGET_RECALL, review: float = config.TARGET_REVIEW, grid=config.CALIBRATION_GRID) -> DataFrame:
    """The choice of most precision, then recall, then least review that meets the targets (relaxed if none does); of equals the largest thresholds."""
    combos = combinations(scored, names, grid)
    want = relaxed_target(combos, recall, review)
    fits = combos.crossJoin(F.broadcast(want)).filter((F.col("catch_recall") >= F.col("target") - config.EPSILON) & (F.col("review_share") <= F.col("cap") + config.EPSILON))
    last = [F.desc(f"{n}_{k}") for n in names for k in ("weak", "strong")]
    return fits.orderBy(F.desc("precision"), F.desc("catch_recall"), "review_share", *last).limit(1)


def gate(measured: DataFrame, recall: float = config.TARGET_RECALL, review: float = config.TARGET_REVIEW) -> DataFrame:
    """passed and the named failures of one row of metrics."""
    fails = F.array_compact(
        F.array(
            F.when(F.col("catch_recall") < recall - config.EPSILON, F.format_string("catch recall %.3f is under %.2f", F.col("catch_recall"), F.lit(recall))),
            F.when(F.col("review_share") > review + config.EPSILON, F.format_string("review share %.3f is over %.2f", F.col("review_share"), F.lit(review))),
        )
    )
    return measured.select((F.size(fails) == 0).alias("passed"), F.array_join(fails, "; ").alias("failures"))


def apply(spark: SparkSession, found: DataFrame, names: list[str]) -> config.Settings:
    """Settings of a search's one row."""
    row = found.collect()[0]
    return config.Settings(thresholds={n: (row[f"{n}_weak"], row[f"{n}_strong"]) for n in names}, signals=tuple(names))


def confidence(score: Column, name: Column, settings: config.Settings) -> Column:
    return normalize(score, *limits(name, settings))


def band(score: Column, name: Column, settings: config.Settings) -> Column:
    return band_rank(score, *limits(name, settings))
