"""Operator 8: MinHash near-duplicates with odd sketches.

1. One pass over whole texts gives each document's shingle count, a 128-bit
   hash of its shingle set, MinHash band keys and an odd sketch: a bitmap in
   which each MinHash sample flips one bit.
2. Documents of one set are one class; only its smallest id goes on.
3. Documents that share a band key are candidates. In a bucket each member
   meets the bucket's smallest id; later rounds (`buckets.resolve`) only pair
   members whose components still differ, in cells of bounded size, until every
   pair of a bucket was compared or is connected.
4. Odd sketches verify candidates. The population count of the XOR of two
   sketches of MinHash samples estimates the similarity; pairs far below the
   threshold go no further. A second parity bitmap, of the whole set, loses
   nothing: its XOR never has more bits than the sets differ in elements, and
   a linked pair differs in few. Later rounds test both while they pair a
   bucket's members, so a large bucket of copies below the threshold yields
   hardly a row. What is left is confirmed on the full sets.
5. Connected components of the confirmed links.

With BANDS x ROWS samples a pair at 0.85 exactly is missed with probability
(1 - 0.85^ROWS)^BANDS = 2e-5, and the sketch's cut lies six standard errors
below the threshold. Below 0.85 the bands are LOW_BANDS x LOW_ROWS (6e-5 at
0.8), and the cut lies LOW_MARGIN below.

Defined results: null, empty and blank texts have no shingles and no links;
ties do not arise, ids being compared; rows of one id are one document whose
texts all count; a row without id is never linked, its component_id is null
and it is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.buckets import resolve, unresolved
from triage.llm.common import drop, release, stored
from triage.llm.components import beside, components, frequent
from triage.llm.shingles import chunks, mix64, shingle_sets

WIDTH, BANDS, ROWS, ODD_WORDS, SET_WORDS = 5, 28, 7, 8, 16
SAMPLES, BITS = BANDS * ROWS, 64 * ODD_WORDS
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 85
MARGIN = 0.18
#: The same for thresholds below PERCENT.
LOW_BANDS, LOW_ROWS, LOW_MARGIN = 32, 6, 0.22

_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SIGN = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])


def signatures(s: np.ndarray, begin: np.ndarray, bands: int = BANDS, per: int = ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sets with at least one shingle: set hashes (n, 2), band keys (n, bands), odd sketches (n, ODD_WORDS), set parities (n, SET_WORDS)."""
    n = len(begin)
    with np.errstate(over="ignore"):
        sums = np.stack([np.add.reduceat(mix64(s ^ np.uint64(c)), begin) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1)
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.empty((SAMPLES, n), np.uint64)
        for i in range(SAMPLES):
            least[i] = np.minimum.reduceat((x ^ _B[i]) * _A[i], begin)
        keys = np.empty((n, bands), np.uint64)
        for band in range(bands):
            k = np.full(n, band + 1, np.uint64)
            for i in range(band * per, band * per + per):
                k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + least[i])
            keys[:, band] = k
        bit = mix64(least + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(33))[:, None]) % np.uint64(BITS)
    odd = np.zeros((n, ODD_WORDS), np.uint64)
    rows = np.arange(n)
    for i in range(SAMPLES):
        odd[rows, bit[i] >> np.uint64(6)] ^= np.uint64(1) << (bit[i] & np.uint64(63))
    owner = np.repeat(rows, np.diff(np.concatenate((begin, [len(s)]))))
    flips = np.bincount(owner * (64 * SET_WORDS) + (s & np.uint64(64 * SET_WORDS - 1)).astype(np.int64), minlength=n * 64 * SET_WORDS)
    parity = np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, SET_WORDS)
    return sums, keys, odd, parity


def _sign(bands: int, per: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, j in chunks(texts):
                s, at = shingle_sets(texts[i:j], WIDTH)
                n = np.diff(at)
                full = np.flatnonzero(n)
                f, keys, odd, parity = np.zeros((j - i, 2), np.uint64), np.zeros((0, bands), np.uint64), np.zeros((0, ODD_WORDS), np.uint64), np.zeros((0, SET_WORDS), np.uint64)
                if len(full):
                    f[full], keys, odd, parity = signatures(s, at[full], bands, per)
                held = (n > 0).cumsum() * (n > 0)

                def lists(m, w, held=held):
                    off = np.concatenate(([0], np.cumsum((held > 0) * w))).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(off), pa.array(m.reshape(-1).view(np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(f[:, 0].copy().view(np.int64)), pa.array(f[:, 1].copy().view(np.int64)), lists(keys, bands), lists(odd, ODD_WORDS), lists(parity, SET_WORDS)], schema=_SIGN
                )
        release()

    return run


def bands_of(percent: int) -> int:
    return BANDS if percent >= PERCENT else LOW_BANDS


def sign(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    run = _sign(BANDS, ROWS) if percent >= PERCENT else _sign(LOW_BANDS, LOW_ROWS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, odd array<long>, parity array<long>")


def differing(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def odd_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity estimated from the XOR of two odd sketches; -1 if they differ too much to tell."""
    z = differing(a, b)
    left = 1 - 2 * z / F.lit(float(BITS))
    return F.when(left <= 0, -1.0).otherwise(1 + F.lit(BITS / (4.0 * SAMPLES)) * F.ln(left))


def likely(percent: int, a: str = "_a", b: str = "_b") -> Column:
    """Whether a pair of sketch rows (n_shingles, odd and parity with a suffix each) may be a link."""
    n_a, n_b = F.col(f"n_shingles{a}"), F.col(f"n_shingles{b}")
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    # intersection = (n_a + n_b - d) / 2 and union = (n_a + n_b + d) / 2, d the elements of one set alone
    few = (100 + percent) * differing(F.col(f"parity{a}"), F.col(f"parity{b}")) <= (100 - percent) * (n_a + n_b)
    return sizes & few & (odd_similarity(F.col(f"odd{a}"), F.col(f"odd{b}")) >= percent / 100 - (MARGIN if percent >= PERCENT else LOW_MARGIN))


def _sets(batches):
    for batch in batches:
        ids, texts = batch.column(0), [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        for i, j in chunks(texts):
            s, at = shingle_sets(texts[i:j], WIDTH)
            raw = s.tobytes()
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array([raw[8 * p : 8 * q] for p, q in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "shingles"])
    release()


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])
        release()

    return run


def confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), stored, that the sketches let through and the full sets confirm."""
    s = sketches.select("doc_id", "n_shingles", "odd", "parity")
    for k in ("a", "b"):
        pairs = pairs.join(s.withColumnsRenamed({c: f"{c}_{k}" for c in s.columns}), F.col(k) == F.col(f"doc_id_{k}"))
    good = stored(pairs.filter(likely(percent)).select("a", "b").distinct(), "likely")
    out = good
    for k in ("a", "b"):
        out = out.join(sets.withColumnsRenamed({"doc_id": f"{k}_id", "shingles": f"set_{k}"}), F.col(k) == F.col(f"{k}_id")).drop(f"{k}_id")
    out = stored(out.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")
    drop(pairs.sparkSession, good)
    return out


def classes(signed: DataFrame) -> DataFrame:
    """(f1, f2, n_shingles, rep, n): documents of one shingle set, by their smallest id."""
    return signed.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    spark = docs.sparkSession
    signed = stored(sign(docs, percent), "signed")
    reps = stored(classes(signed), "classes")
    sketches = stored(
        signed.join(reps.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "rep"), (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("doc_id") == F.col("rep"))).select("doc_id", "n_shingles", "bands", "odd", "parity"),
        "sketches",
    )
    keyed = sketches.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    hubs = stored(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).filter("hub < last").select("key", "hub", "n"), "hubs")
    members = stored(beside(keyed, hubs, "key", sketches.count() * bands_of(percent)), "members")
    drop(spark, hubs)
    wanted = stored(members.select("rep").distinct(), "wanted")
    sets = stored(docs.select(F.col("doc_id").cast("long"), "text").join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "sets")

    tested = stored(members.filter("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = confirmed(tested, sketches, sets, percent)
    groups = stored(components(links), "components")
    # Of a bucket of two the pair was compared.
    left = unresolved(members.select("key", F.col("rep").alias("name")), groups, 3)
    if left.limit(1).count():
        ready = stored(left.join(sketches.select("doc_id", "n_shingles", "odd", "parity"), F.col("name") == F.col("doc_id")).drop("doc_id"), "ranked")
        groups = resolve(ready, groups, tested, likely(percent), lambda new: confirmed(new, sketches, sets, percent))
    drop(spark, sets)
    # Classes that are not their own component's smallest id or that have more than one document; all others are their own.
    whole = reps.join(groups, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n_shingles", "n", F.coalesce("component", "rep").alias("comp"), "rep")
    whole = stored(whole.filter("n > 1 or comp <> rep"), "classes-done")
    rows = signed.select("doc_id", "n_shingles", "f1", "f2")
    some = rows.filter("n_shingles > 0 and doc_id is not null")
    keys = ["f1", "f2", "n_shingles"]
    hot = frequent(whole, "f1", rows.count())
    right = whole.drop("n", "rep")
    if hot:  # a frequent class's documents meet it by broadcast
        is_hot = F.col("f1").isin(hot)
        some = some.filter(is_hot).join(F.broadcast(right.filter(is_hot)), keys, "left").unionByName(some.filter(~is_hot).join(right, keys, "left"))
    else:
        some = some.join(right, keys, "left")
    some = some.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    none = rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, columns: tuple[str, ...], percent: int = PERCENT) -> DataFrame:
    """One document of each group, whole, with these columns (pipeline stage).

    All texts of an id that is kept stay; of rows equal in id and text one does.
    """
    gone = stored(near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    rest = docs.select(*columns).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__again"), F.xxhash64("text").alias("__text")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stored(again.select("__again", "__text"), "again")
    if not again.limit(1).count():  # ids name one row each, as they should: no text is moved
        return rest
    met = (F.col("doc_id") == F.col("__again")) & (F.xxhash64("text") == F.col("__text"))
    firsts = rest.join(again, met, "left_semi").groupBy("doc_id", "text").agg(*[F.min(c).alias(c) for c in columns if c not in ("doc_id", "text")])
    return rest.join(again, met, "left_anti").unionByName(firsts.select(*columns))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


assert math.isclose((1 - 0.85**ROWS) ** BANDS, 2e-5, rel_tol=0.5)
