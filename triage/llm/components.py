"""Connected components of an edge table, by repeated joins (distributed union-find), and joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.common import drop, stored

#: A key that has more than one in HOT of all rows (and LEAST of them) is joined by broadcast, so at most HOT keys are.
HOT, LEAST = 1024, 100


def frequent(table: DataFrame, key: str, total: int) -> list:
    """The keys of a table (one row a key, its number of rows as n) that have more than one in HOT of `total` rows: HOT at most."""
    return [r[0] for r in table.filter(F.col("n") > max(LEAST, total // HOT)).select(key).collect()]


def beside(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows, `total` in all, with a table of one row a key that has the key's number of rows as n.

    Rows of frequent keys, HOT keys at most, stay where they are and meet them
    by broadcast; only the others are shuffled.
    """
    hot = frequent(table, key, total)
    if not hot:
        return rows.join(table, key)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(table.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(table, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each round links every node's neighbours to its smallest neighbour (large
    star), then points every node at its smallest known one (small star); the
    rounds grow with the logarithm of the longest path. Groups are only ever
    reduced to their minimum, on the map side, and a hub's edges are not moved
    to its task but meet its minimum by broadcast (`beside`). Every round's
    edges are written to the shared folder; drop() of the result deletes the last.
    """
    spark = edges.sparkSession
    now = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct()
    now = stored(now, "edges")
    while True:
        n = now.count()
        # Large star: each node sends its larger neighbours to its minimum (itself included).
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        up = now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        large = beside(up, least, "u", 2 * n).select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()
        mid = stored(large, "large-star")
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        lowest = mid.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        two = F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        small = beside(mid, lowest, "hi", mid.count()).select(two.alias("e")).select("e.hi", "e.lo").filter("hi > lo").distinct()
        nxt = stored(small, "small-star")
        # A node with two smaller neighbours, or a neighbour that is itself pointed on, means another round.
        unsettled = nxt.groupBy("hi").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).filter("x < y").limit(1).count()
        unsettled = unsettled or nxt.select("lo").distinct().join(nxt.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").limit(1).count()
        drop(spark, now, mid)
        now = nxt
        if not unsettled:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    out = stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
    out._triage_path = now._triage_path
    return out
