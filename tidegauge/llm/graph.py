"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that (a, b) edges reach, for every node of an edge.

    By contraction: each node hooks to its smallest neighbour, hooks of hooks
    are followed once, and the edges are rewritten to what their ends hook to.
    Edges inside what has merged vanish, so each round works on a fraction of
    the last one's edges. A component's smallest node never hooks, so it is what
    remains. Rounds are tables in the shared folder; only a count reaches the
    driver.
    """
    edges = shared.staged(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        hook = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hook = shared.staged(hook, "hooks")
        again = hook.select(F.col("node").alias("to"), F.col("to").alias("_to2"))
        hook = shared.staged(hook.join(again, "to").select("node", F.col("_to2").alias("to")), "hooks")
        if labels is None:
            labels = hook.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(hook.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            labels = shared.staged(labels, "labels")
        of = lambda c: hook.select(F.col("node").alias(c), F.col("to").alias(f"_{c}"))
        edges = edges.join(of("a"), "a").join(of("b"), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = shared.staged(edges, "edges")
        if not edges.limit(1).count():
            return labels


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels (node, component) after further edges, by the components that the edges join."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    joined = more.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    above = components(joined.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    both = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    fresh = above.join(both.select("node"), "node", "left_anti")
    return shared.staged(both.unionByName(fresh.select("node", "component")), "labels")
