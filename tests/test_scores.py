"""Bands, normalised confidence, decisions, metrics, sweeps and calibration on hand-checked sets."""

import pytest
from pyspark.sql import functions as F

from triage import config
from triage.functions import scores
from triage.operators import evaluation

SET = config.Settings(thresholds={"ocr": (0.60, 0.95), "sift": (0.05, 0.65)})
MINI = [
    ("p1", "positive", 0.98, 0.0, "positive"),
    ("p2", "positive", 0.0, 0.80, "positive"),
    ("p3", "positive", 0.70, 0.0, "review"),
    ("p4", "positive", 0.0, 0.20, "review"),
    ("p5", "positive", 0.10, 0.02, "negative"),
    ("n1", "negative", 0.96, 0.0, "positive"),
    ("n2", "negative", 0.65, 0.0, "review"),
    ("n3", "negative", 0.0, 0.0, "negative"),
    ("n4", "negative", 0.30, 0.0, "negative"),
    ("n5", "negative", 0.0, 0.04, "negative"),
]


def rows(spark, data):
    """(item, label, {signal: score}) as scored rows."""
    flat = [(i, lab, [(n, float(s), None, f"by {n}") for n, s in sc.items()]) for i, lab, sc in data]
    return spark.createDataFrame(flat, f"item string, label string, signals {scores.SIGNAL}")


@pytest.fixture(scope="module")
def mini(spark):
    return evaluation.judged(rows(spark, [(i, lab, {"ocr": a, "sift": b}) for i, lab, a, b, _ in MINI]), SET)


def test_bands(mini):
    assert {r.item: r.band for r in mini.collect()} == {i: b for i, *_, b in MINI}


def test_metrics(mini):
    m = evaluation.metrics(mini).collect()[0]
    assert (m.precision, m.catch_recall, m.review_share) == (0.6667, 0.8, 0.3)
    assert {r.signal: r.wins for r in evaluation.wins(mini).collect()} == {"ocr": 4, "sift": 2}
    n = {(r.label, r.band): r.n for r in evaluation.counts(mini).collect()}
    assert [n["positive", b] for b in config.BANDS] == [2, 2, 1] and [n["negative", b] for b in config.BANDS] == [1, 1, 3]
    assert [r.item for r in evaluation.misses(mini).collect()] == ["p5"] and [r.item for r in evaluation.false_alarms(mini).collect()] == ["n1"]


def test_winners_and_details(spark):
    got = evaluation.judged(
        rows(spark, [("a", "positive", {"ocr": 0.90, "sift": 0.70}), ("b", "positive", {"ocr": 0.96, "sift": 1.0}), ("c", "positive", {"new": 0.7}), ("d", "positive", {})]), SET
    )
    by = {r.item: r for r in got.collect()}
    assert (by["a"].band, by["a"].method) == ("positive", "sift")
    assert by["b"].method == "sift+ocr" and by["b"].confidence == 1.0 and by["b"].detail == "by sift"
    assert by["c"].band == "review"  # the fallback thresholds
    assert (by["d"].band, by["d"].confidence, by["d"].method, by["d"].detail) == ("negative", 0.0, "none", "no signals enabled")


def test_first_winner_with_a_box(spark):
    data = [("x", "positive", [("ocr", 0.99, None, ""), ("sift", 0.7, (1, 2, 3, 4), "")])]
    got = evaluation.judged(spark.createDataFrame(data, f"item string, label string, signals {scores.SIGNAL}"), SET).collect()[0]
    assert got.method == "ocr+sift" and tuple(got.bbox) == (1, 2, 3, 4)


@pytest.mark.parametrize(("score", "weak", "strong", "want"), [(0, 0.6, 0.95, 0), (0.6, 0.6, 0.95, 0.5), (0.95, 0.6, 0.95, 0.85), (1, 0.6, 0.95, 1), (0, 0, 0, 0.85), (1, 1, 1, 0.85), (0, 0, 1, 0.5), (0.3, 0.6, 0.95, 0.25)])
def test_normalize(spark, score, weak, strong, want):
    assert spark.range(1).select(scores.normalize(F.lit(float(score)), weak, strong)).collect()[0][0] == pytest.approx(want)


def test_sweep_point(spark):
    data = [(f"p{i}", "positive", {"s": x}) for i, x in enumerate((0.9, 0.85, 0.5, 0.1))] + [(f"n{i}", "negative", {"s": x}) for i, x in enumerate((0.9, 0.3, 0.2, 0.0))]
    points = evaluation.sweep(evaluation.long_scores(rows(spark, data)))
    assert points.count() == 190
    p = points.filter("review_t = 0.4 and positive_t = 0.8").collect()[0]
    assert (p.precision, p.catch_recall, p.review_share, p.missed) == (pytest.approx(2 / 3), 0.75, 0.125, 1)


GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def separable(n):
    return [(f"p{i}", "positive", {"ocr": 0.9, "sift": 0.0}) for i in range(n)] + [(f"n{i}", "negative", {"ocr": 0.1, "sift": 0.0}) for i in range(10)]


def test_search_separable(spark):
    r = evaluation.search(rows(spark, separable(10)), ["ocr", "sift"], grid=GRID).collect()[0]
    assert (r.precision, r.catch_recall, r.review_share) == (1, 1, 0) and r.feasible > 0
    assert evaluation.combinations(rows(spark, separable(10)), ["ocr", "sift"], GRID).count() == 15**2


def test_search_loud_negative(spark):
    data = [*separable(10), ("loud", "negative", {"ocr": 0.6, "sift": 0.0})]
    assert evaluation.search(rows(spark, data), ["ocr", "sift"], grid=GRID).collect()[0].ocr_strong > 0.6


def test_search_relaxes(spark):
    data = [*separable(9), ("blind", "positive", {"ocr": 0.0, "sift": 0.0})]
    r = evaluation.search(rows(spark, data), ["ocr", "sift"], grid=GRID).collect()[0]
    assert r.feasible == 0 and r.attainable == pytest.approx(0.9) and r.target == pytest.approx(0.9)


def test_cube_against_brute_force(spark):
    import itertools
    import random

    rng = random.Random(4)
    names = ["x", "y", "z"]
    data = [(str(i), rng.choice(["positive", "negative"]), {n: rng.choice([0, 0.1, 0.25, 0.5, 0.5000000001, 0.72, 0.9, 1.0]) for n in names}) for i in range(60)]
    got = {tuple(r[f"{n}_{k}"] for n in names for k in ("weak", "strong")): (r.precision, r.catch_recall, r.review_share) for r in evaluation.combinations(rows(spark, data), names, GRID[1:4]).collect()}
    pairs = [(a, b) for a in GRID[1:4] for b in GRID[1:4] if a <= b]
    assert len(got) == len(pairs) ** 3
    for combo in itertools.product(pairs, repeat=3):
        def over(sc, k, combo=combo):
            return any(sc[n] >= combo[i][k] - 1e-9 for i, n in enumerate(names))

        flagged = [lab for _, lab, sc in data if over(sc, 1)]
        caught = sum(over(sc, 0) for _, lab, sc in data if lab == "positive")
        total = sum(lab == "positive" for _, lab, _ in data)
        review = sum(over(sc, 0) and not over(sc, 1) for *_, sc in data)
        want = (flagged.count("positive") / len(flagged) if flagged else 0, caught / total, review / len(data))
        assert got[tuple(x for c in combo for x in c)] == pytest.approx(want)


def test_gate(spark):
    df = spark.createDataFrame([(0.98, 0.05), (0.5, 0.2)], "catch_recall double, review_share double")
    a, b = evaluation.gate(df).collect()
    assert a.passed and a.failures == "" and not b.passed and b.failures.count(";") == 1


def test_wilson(spark):
    df = spark.createDataFrame([(0, 100), (0, 0)], "h long, n long").select(scores.wilson(F.col("h"), F.col("n")).alias("w"))
    a, b = (r.w for r in df.collect())
    assert a.low == 0 and 0 < a.high < 0.05 and (b.low, b.high) == (0, 1)


def test_settings():
    assert config.signal_list(None) == ("ocr", "sift", "emb") and config.signal_list("") == () and config.signal_list("a, b") == ("a", "b")
