"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.session import dealt_join, drop, materialise


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (node, other) with the least neighbour of node; a hub's pairs are summed up map-side first and may be split."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    return dealt_join(pairs, least, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    found = _with_least(pairs).where("other > node")
    return found.select(F.least("node", "least").alias("a"), F.col("other").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    found = _with_least(pairs)
    own = found.select(F.col("least").alias("a"), F.col("node").alias("b"))
    rest = found.select(F.col("least").alias("a"), F.col("other").alias("b"))
    return own.union(rest)


def _settled(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def components(edges: DataFrame, about: int | None = None, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Nodes are longs. Self-links and repeated links do no harm; nodes that have only self-links aren't
    returned. about: about how many links there are, where that is known. Every round is written to the shared
    folder, so its lineage is one round long, and work and shuffle are in proportion to the links. Raises if
    rounds don't suffice (they grow with the logarithm).
    """
    tidy = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now, mark = materialise(_settled(tidy), "links", about), None
    size = now.count()
    for _ in range(rounds):
        nearer = materialise(_settled(_small_star(_settled(_large_star(now)))), "links", size)
        drop(now)
        now = nearer
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first()
        if seen == mark:
            roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
        mark, size = seen, max(size, seen[0])
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
