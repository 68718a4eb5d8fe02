"""Buckets of candidates that the first pairing leaves with several components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triage.llm.common import drop, stored
from triage.llm.components import beside, components

#: Each round has so many times as many hubs in a bucket as the one before.
SPREAD = 8
#: A cell of a bucket's pairs has about so many hubs, and so many other members, at most.
BLOCK = 1000
_UNIT = 1 << 30


def with_components(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (name, ...) with their component, a name of its own where groups has none."""
    return rows.join(groups.select(F.col("node").alias("__node"), F.col("component").alias("__component")), F.col("name") == F.col("__node"), "left").withColumn("comp", F.coalesce("__component", "name")).drop("__node", "__component")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), stored: the components after these links, found among the components that they tie, in place of all links so far."""
    tied = links.select("a", F.col("b").alias("name"))
    tied = with_components(tied, groups).select(F.col("comp").alias("b"), F.col("a").alias("name"))
    tied = with_components(tied, groups).select(F.col("comp").alias("a"), "b").filter("a <> b")
    found = components(tied)
    moved = stored(found, "components-tied")
    now = with_components(groups.select("node", F.col("component").alias("name")), moved).select("node", F.col("comp").alias("component"))
    fresh = moved.join(groups.select("node"), "node", "left_anti").select("node", "component")
    out = stored(now.unionByName(fresh), "components")
    drop(groups.sparkSession, found, moved, groups)
    return out


def unresolved(members: DataFrame, groups: DataFrame, least: int) -> DataFrame:
    """(key, name, n), stored: members of buckets of `least` or more that still hold two components."""
    now = stored(with_components(members.select("key", "name"), groups), "members-now")
    mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).filter(F.col("x") < F.col("y")).filter(F.col("n") >= least).select("key", "n")
    out = stored(beside(now, mixed, "key", now.count()).select("key", "name", "n"), "unresolved")
    drop(members.sparkSession, now)
    return out


def resolve(members: DataFrame, groups: DataFrame, tested: DataFrame, likely: Column, confirm: Callable[[DataFrame], DataFrame], spread: int = SPREAD) -> DataFrame:
    """(node, component), stored, after every pair of a bucket was compared or is connected.

    members: key, name, n (the bucket's size) and the columns that `likely`
    reads, there with _a and _b. Members stand by a hash of their name; those up
    to a rank that grows by spread are a round's hubs, and meet the members of
    other components behind them. A bucket's pairs of a round are dealt to cells
    of BLOCK by BLOCK, so a large bucket is many tasks' work, and only likely
    pairs leave a cell.
    """
    spark = members.sparkSession
    n = F.col("n")
    rank = F.floor(F.pmod(F.xxhash64("name", "key"), F.lit(_UNIT)) * n / F.lit(float(_UNIT)))
    members = members.withColumn("rank", rank).withColumn("block", F.pmod(F.xxhash64("key", "name", F.lit(1)), F.ceil(n / BLOCK)))
    total, deepest = members.agg(F.count(F.lit(1)), F.max("n")).collect()[0]
    first, done = 0, []
    while first < (deepest or 0):
        last = max(spread, spread * first)
        before = now = stored(with_components(members, groups), "members-now")
        mixed = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).filter(F.col("x") < F.col("y")).filter(F.col("n") > first).select("key", "n")
        now = beside(now.drop("n"), mixed, "key", total)
        across = F.ceil(F.least(F.lit(last - first), n) / BLOCK)  # blocks of hubs
        hubs = now.filter(F.col("rank").between(first, last - 1)).withColumn("j", F.pmod(F.col("block"), across)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(n / BLOCK) - 1)))
        rest = now.filter(F.col("rank") >= first).withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)))
        hubs, rest = (d.withColumnsRenamed({c: f"{c}_{k}" for c in d.columns}) for d, k in ((hubs, "a"), (rest, "b")))
        after = (F.col("rank_b") > F.col("rank_a")) | ((F.col("rank_b") == F.col("rank_a")) & (F.col("name_b") > F.col("name_a")))
        met = (F.col("key_a") == F.col("key_b")) & (F.col("i_a") == F.col("i_b")) & (F.col("j_a") == F.col("j_b")) & after & (F.col("comp_a") != F.col("comp_b")) & likely
        new = rest.join(hubs, met).select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct()
        new = stored(new.join(tested, ["a", "b"], "left_anti"), "pairs")
        drop(spark, before)
        done.append(new)
        if new.limit(1).count():
            more = confirm(new)
            tested = tested.unionByName(new)
            if more.limit(1).count():
                groups = merged(groups, more)
            drop(spark, more)
        first = last
    drop(spark, *done)
    return groups
