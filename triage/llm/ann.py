"""Operator 6: nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so that the largest cosine is the least
Euclidean distance, for which Gaussian projections are 2-stable. Each of
TABLES tables cuts PROJECTIONS of them into cells of WIDTH; a query visits, in
each table, the PROBES cells next to its own that hold its neighbours most
likely: the perturbation sets of least summed squared distance to the cells'
bounds, of up to FLIPS coordinates. Candidates of all tables are merged and
ranked by the exact cosine of the original vectors.

Every row is indexed and nothing is trained. Equal vectors are one class, so
a vector that a third of all rows hold is indexed once; of a class only the
smallest TOP + 1 ids can be among the nearest TOP. Cells are dealt to
partitions, large ones in SALTS parts; a query's vector goes once to each
partition that holds cells it visits, and only its best TOP + 1 classes come
back. Nothing pairs all queries with all rows.

Defined results: vectors that are null, zero or hold null or non-finite
components, and rows without id, take no part; ties go to the smaller id; of
equal rows each counts by its id, a repeated id once; fewer candidates give
fewer results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triage.llm.common import stored

TABLES, PROJECTIONS, WIDTH, PROBES, FLIPS, SALTS, TOP = 6, 10, 2.2, 450, 5, 1, 5
SLACK = 1e-4
#: Index entries of a partition, about; there is one for each vector and table.
PART_ROWS = 8000
_FIELDS = "p int, kind int, id long, vector array<float>, cells array<long>"
_NAMES = ["p", "kind", "id", "vector", "cells"]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(dim: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dim, PROJECTIONS) and offsets of a table."""
    rng = np.random.default_rng([6, table, dim])
    return rng.normal(size=(dim, PROJECTIONS)), rng.uniform(0, WIDTH, PROJECTIONS)


def cell_keys(table: int, cells: np.ndarray) -> np.ndarray:
    """64-bit names of cells (n, PROJECTIONS) of a table."""
    key = np.full(cells.shape[:-1], table + 1, np.uint64)
    for k in range(cells.shape[-1]):
        key = (key ^ (cells[..., k].astype(np.int64).view(np.uint64) + np.uint64(0x7F4A7C15))) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def perturbations() -> np.ndarray:
    """All sets of up to FLIPS coordinates moved by one cell, as rows of -1, 0 and 1."""
    rows = [np.zeros(PROJECTIONS, np.int64)]
    for n in range(1, FLIPS + 1):
        for at in combinations(range(PROJECTIONS), n):
            for signs in product((-1, 1), repeat=n):
                row = np.zeros(PROJECTIONS, np.int64)
                row[list(at)] = signs
                rows.append(row)
    return np.array(rows)


def _part(keys: np.ndarray, salt, parts: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64(1) + np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _groups(batch, width: int):
    """(rows, matrix) of each vector length in a batch."""
    vectors = batch.column(1).to_pylist()
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, np.array([vectors[i] for i in at], np.float32)


def _index(parts: int, salts: int):
    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for at, x in _groups(batch, 0):
                unit = x.astype(np.float64)
                unit /= np.sqrt((unit * unit).sum(1))[:, None]
                salt = (ids[at].view(np.uint64) * _MIX >> np.uint64(40)) % np.uint64(salts)
                # A vector is sent once to each partition, with the names of its cells there.
                keys = np.stack([cell_keys(t, np.floor((unit @ a + b) / WIDTH)) for t in range(TABLES) for a, b in [hashes(x.shape[1], t)]], 1)
                part = _part(keys, salt[:, None], parts)
                out = []
                for i in range(len(at)):
                    for p in set(part[i].tolist()):
                        out.append((p, 0, int(ids[at[i]]), x[i], keys[i][part[i] == p]))
                yield _batch(out)

    return run


def _probe(parts: int, salts: int):
    def run(batches):
        moves = perturbations()
        down, up = moves == -1, moves == 1
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for at, x in _groups(batch, 0):
                unit = x.astype(np.float64)
                unit /= np.sqrt((unit * unit).sum(1))[:, None]
                keys = np.empty((len(at), TABLES, min(PROBES, len(moves))), np.int64)
                for t in range(TABLES):
                    a, b = hashes(x.shape[1], t)
                    place = (unit @ a + b) / WIDTH
                    home = np.floor(place)
                    inside = place - home
                    for i in range(len(at)):
                        cost = down @ (inside[i] ** 2) + up @ ((1 - inside[i]) ** 2)
                        first = np.argpartition(cost, keys.shape[2] - 1)[: keys.shape[2]]
                        first = first[np.argsort(cost[first], kind="stable")]
                        keys[i, t] = cell_keys(t, home[i] + moves[first])
                out = []
                for i in range(len(at)):
                    mine = keys[i].reshape(-1)
                    for s in range(salts):
                        part = _part(mine, s, parts)
                        order = np.argsort(part, kind="stable")
                        p, begin = np.unique(part[order], return_index=True)
                        for q, c in zip(p.tolist(), np.split(mine[order], begin[1:]), strict=True):
                            out.append((q, 1, int(ids[at[i]]), x[i], c))
                    if len(out) > 4096:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return run


def _batch(rows) -> pa.RecordBatch:
    def lists(k, kind):
        off = np.concatenate(([0], np.cumsum([len(r[k]) for r in rows]))).astype(np.int32)
        flat = np.concatenate([r[k] for r in rows]) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))

    first = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64()))]
    return pa.RecordBatch.from_arrays([*first, lists(3, pa.float32()), lists(4, pa.int64())], _NAMES)


class _Cells:
    """The vectors of one partition key, by cell."""

    def __init__(self):
        self.ids, self.rows, self.cells, self.ready = [], [], [], None

    def add(self, i, vector, cells):
        self.ids.append(i)
        self.rows.append(vector)
        self.cells.append(cells)

    def best(self, vector, cells, top: int):
        if self.ready is None:
            where: dict = {}
            for k, own in enumerate(self.cells):
                for c in own:
                    where.setdefault(c, []).append(k)
            width = max(map(len, self.rows))
            m = np.zeros((len(self.rows), width))
            for k, r in enumerate(self.rows):
                m[k, : len(r)] = r
            norm = np.sqrt((m * m).sum(1))
            unit = (m / norm[:, None]).astype(np.float32)
            self.ready = ({c: np.array(v, np.int32) for c, v in where.items()}, m, unit, norm, np.array(self.ids), np.array([len(r) for r in self.rows]))
        where, m, unit, norm, ids, lengths = self.ready
        found = [where[c] for c in cells if c in where]
        if not found:
            return []
        seen = np.zeros(len(m), bool)
        seen[np.concatenate(found)] = True
        k = np.flatnonzero(seen & (lengths == len(vector)))
        if not len(k):
            return []
        q = np.zeros(m.shape[1])
        q[: len(vector)] = vector
        size = np.sqrt((q * q).sum())
        if len(k) > 4 * top:
            # Single precision finds all that may be among the best; SLACK is far above its error.
            rough = unit[k] @ (q / size).astype(np.float32)
            k = k[rough >= np.partition(rough, len(k) - top)[len(k) - top] - SLACK]
        score = (m[k] * q).sum(1) / (norm[k] * size)
        order = np.lexsort((ids[k], -score))[:top]
        return [(int(ids[k[o]]), float(score[o])) for o in order]


def _rank(top: int):
    def run(batches):
        part, held, out = None, _Cells(), []
        for batch in batches:
            for p, kind, i, vector, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, held = p, _Cells()
                if kind == 0:
                    held.add(i, vector, cells)
                elif held.ids:
                    out.extend((i, j, s) for j, s in held.best(vector, cells, top))
                if len(out) > 8192:
                    yield _scored(out)
                    out = []
        yield _scored(out)

    return run


def _scored(rows) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query", "class", "score"])


def usable(vector: Column) -> Column:
    """Whether a vector takes part: components all finite, and not all zero."""
    v = F.coalesce(vector, F.array().cast("array<float>"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return finite & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, top: int = TOP, salts: int = SALTS) -> DataFrame:
    """The nearest `top` other rows of each row of vectors (vec_id, embedding) that `queries` picks: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # -0.0 is 0.0 in a grouping key, as it is in a cosine.
    classes = stored(rows.groupBy("embedding").agg(F.min("vec_id").alias("class")), "vector-classes")
    # As many partitions as the index fills: a query sends its vector to, and gets a few rows from, each that it visits.
    parts = max(1, -(-classes.count() * TABLES // PART_ROWS))
    named = rows.distinct().withColumnRenamed("embedding", "e").join(classes, F.col("e") == F.col("embedding")).select("vec_id", "class")
    named = stored(named, "vector-names")
    asked = stored(named.filter(queries).select(F.col("vec_id").alias("query_id"), F.col("class").alias("query")), "vector-queries")
    index = classes.select("class", "embedding").mapInArrow(_index(parts, salts), _FIELDS)
    wanted = classes.join(asked.select("query").distinct(), F.col("class") == F.col("query"), "left_semi")
    probes = wanted.select("class", "embedding").mapInArrow(_probe(parts, salts), _FIELDS)
    met = index.unionByName(probes).repartition(parts, "p").sortWithinPartitions("p", "kind", "id")
    scored = met.mapInArrow(_rank(top + 1), "query long, class long, score double").groupBy("query", "class").agg(F.max("score").alias("score"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    scored = stored(scored.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= top + 1).drop("r"), "vector-near")
    first = Window.partitionBy("class").orderBy("vec_id")
    members = stored(named.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= top + 1).select(F.col("class").alias("member_of"), "vec_id"), "vector-members")
    # Queries of one class share their classes; each has its own rows left out.
    pairs = asked.join(scored, "query").join(members, F.col("class") == F.col("member_of")).filter("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
