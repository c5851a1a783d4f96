"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

# Each round shortens all paths; far more than the rounds any table needs.
MAX_ROUNDS = 60


def _smallest(links: DataFrame) -> DataFrame:
    """(a, m): a node's smallest neighbour. Partial minima meet, not a node's links; joining it back, Spark can split a node's links."""
    return links.groupBy("a").agg(F.min("b").alias("m"))


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node in `links` (a, b: long): the smallest node reachable.

    Large-star and small-star rounds: each round points a node's neighbours at the
    smallest node around it, until no link changes. Every round is a written table,
    so a lost executor costs one round. Nothing is collected but whether links changed.
    """
    either = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(either.distinct(), "links")
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours above a node point at the smallest node around it.
        large = (
            both.join(_smallest(both), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        # Small star: a node and its smaller neighbours point at the smallest of them.
        starred = large.join(_smallest(large), "a")
        small = (
            starred.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(starred.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = stored(small, "links")
        changed = after.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(after, ["a", "b"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
    raise RuntimeError("components did not settle")
