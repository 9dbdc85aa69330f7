"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.scratch import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of ``links``; columns of any one type that has an order.

    Each round sends every node to the smallest of itself and its neighbours, follows these
    pointers twice more, and contracts the links. Every round is written to the shared
    folder; tables of earlier rounds are deleted when the next are written. Minima are combined before the shuffle, so a node with very many links is no
    hot key of an aggregation; links with a null end and links to oneself are left out.
    """
    links = materialize(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents")
        parent = least
        for _ in range(2):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            parent = parent.join(up, "parent").select("node", F.col("_up").alias("parent"))
        parent = materialize(parent, "parents")
        rounds.append(parent)
        discard(least)
        of_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = links.join(of_a, "a").join(of_b, "b").where(F.col("pa") != F.col("pb"))
        before, links = links, materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        discard(before)
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = rounds[0].select("node", F.col("parent").alias("component"))
    for parent in rounds[1:]:
        up = parent.select(F.col("node").alias("component"), F.col("parent").alias("_up"))
        label = label.join(up, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return label
