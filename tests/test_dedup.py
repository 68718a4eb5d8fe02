"""Exact and greedy near duplicates against a sequential pass."""

import random

import pytest
from pyspark.sql import functions as F

from triage.functions import hashing
from triage.operators import dedup


def sequential(items, budget=4):
    kept, out = [], {}
    for i, h in items:
        best = None
        if h is not None and h not in (0, -1):
            for j, g in kept:
                d = ((h ^ g) & (2**64 - 1)).bit_count()
                if d <= budget and (best is None or d < best[0]):
                    best = (d, j)
            if best is None:
                kept.append((i, h))
        out[i] = best[1] if best else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_is_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    items, base = [(0, None), (1, 0), (2, 0), (3, -1)], [rng.getrandbits(64) - 2**63 for _ in range(6)]
    for i in range(4, 90):
        h = rng.choice(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            b = rng.randrange(64)
            h ^= -(1 << 63) if b == 63 else 1 << b
        items.append((i, h))
    got = dedup.greedy(spark.createDataFrame(items, "item long, h long"), "item", "h").collect()
    assert {r.item: r.duplicate_of for r in got} == sequential(items)


def test_exact(spark):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "a")]
    got = dedup.exact(spark.createDataFrame(rows, "item long, k string"), "k", "item").collect()
    assert {r.item: r.duplicate_of for r in got} == {1: None, 2: None, 3: 1, 4: None, 5: None, 6: 1}


def test_hex(spark):
    values = [0, -1, 0x0F1E2D3C4B5A6978, -(2**63), 7]
    df = spark.createDataFrame([(v,) for v in values], "h long").select("h", hashing.to_hex(F.col("h")).alias("t"))
    assert df.filter(hashing.from_hex(F.col("t")) == F.col("h")).count() == len(values)
    assert "0f1e2d3c4b5a6978" in {r.t for r in df.collect()}
    bad = spark.createDataFrame([("",), ("xyz",), ("12345678901234567",), (None,)], "t string").select(hashing.from_hex(F.col("t")).alias("h"))
    assert all(r.h is None for r in bad.collect())


def test_pieces_share_one_within_the_budget(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(50):
        a = rng.getrandbits(64) - 2**63
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= -(1 << 63) if bit == 63 else 1 << bit
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.filter(F.arrays_overlap(hashing.pieces(F.col("a")), hashing.pieces(F.col("b")))).count() == len(rows)


def test_dhash_of_pictures():
    import numpy as np

    rng = np.random.default_rng(0)
    big = np.kron(rng.integers(0, 255, (8, 9)), np.ones((16, 16)))
    assert hashing.dhash(big) == hashing.dhash(big[::2, ::2]) and hashing.dhash(np.zeros((0, 0))) == 0
    assert hashing.dhash(np.full((20, 20), 9)) == 0


def test_simhash(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[1:])), (4, None), (5, " ".join(f"z{i}" for i in range(200)))]
    got = {r.doc_id: r.simhash for r in hashing.text_simhash(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got[1] == got[2] and got[4] is None

    def far(a, b):
        return ((got[a] ^ got[b]) & (2**64 - 1)).bit_count()

    assert far(1, 3) <= 6 < far(1, 5)


def test_first_by_digest(spark):
    files = spark.createDataFrame([("b", "x", 2), ("a", "x", 3), ("c", "y", 1), ("d", None, 1)], "path string, sha string, period int")
    got = {r.path: r.note for r in dedup.first_by_digest(files, "sha", "period").collect()}
    assert got == {"b": "", "a": "duplicate-of:b", "c": "", "d": ""}


@pytest.mark.parametrize("budget", [0, 1, 2, 4, 9, 14])
def test_near_pairs_are_all_pairs_within_the_budget(spark, budget):
    rng = random.Random(budget)
    hashes = {rng.getrandbits(64) - 2**63 for _ in range(20)}
    for h in list(hashes):
        for n in (budget - 1, budget, budget + 1, budget + 1):
            hashes.add(h ^ (sum(1 << b for b in rng.sample(range(63), max(0, n))) if n < 63 else 0))
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*hashes, *list(hashes)[:3]])], "item long, h long")
    got = [(r.h1, r.h2, r.distance) for r in dedup.near_pairs(df, "item", "h", budget).collect()]
    apart = {(a, b): ((a ^ b) & (2**64 - 1)).bit_count() for a in hashes for b in hashes if a < b}
    assert sorted(got) == sorted((a, b, d) for (a, b), d in apart.items() if d <= budget)


def test_unrelated_hashes_seldom_meet(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(4000)], "a long, b long")
    # With pieces of 4 bits, of which one has to be equal, 0.6 of them meet.
    left, right = hashing.meeting_keys(F.col("a"), 14)[0], hashing.meeting_keys(F.col("b"), 14)[1]
    assert df.filter(F.arrays_overlap(left, right)).count() < 0.1 * 4000


def test_hamming_pairs_are_those_of_its_sql_on_odd_vectors(spark, tmp_path):
    """Falling and flat vectors (a hash of no bits), single, empty and null ones, and vectors with a null component."""
    import duckdb

    from triage.plans import catalogue

    flat, rng = [1.0] * 64, random.Random(9)
    vectors = [flat, flat, [float(i) for i in range(64)], [float(-i % 5) for i in range(64)], [0.5], [], None, [None] * 64, [1.0, None, *flat[2:]]]
    vectors += [[rng.random() if i < n else 2.0 + i for i in range(64)] for n in (3, 12, 20, 30, 40)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("vector_dhash", "hamming_pairs"):
        want = con.execute(catalogue.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
    assert any(0 in pair[:2] for pair in want)
