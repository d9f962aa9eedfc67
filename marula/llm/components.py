"""Problem 2: consolidating pairwise matches into groups.

Method: seed-tree pruning (the Cracker scheme). In each round every vertex tells
its neighbours the smallest vertex it knows; vertices that are nobody's minimum
drop out and hang below the smallest minimum they were told, which keeps the
propagation forest; the others go on, linked through their minima. When no edge is
left, each component has one seed, its smallest vertex, and the seeds' identifiers
flow down the forest, round by round in reverse.

A round takes a few joins on vertices; their minima are pre-aggregated, the hub of
a star is one row on the small side, and its many edges on the other side are
split by adaptive skew joins. No adjacency list is ever collected. Rounds grow with
the logarithm of the largest component, as at least half of a path drops out.

Defined results: null ends are ignored; a pair of a record with itself makes a
group of one; repeated and reversed pairs change nothing; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marula.session import checkpoint


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row (vertex, seed) for each vertex; seed is the smallest vertex of its component.

    The vertices may be of any orderable type.
    """
    p = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    both = checkpoint(p.select(F.col("a").alias("u"), F.col("b").alias("v")).union(p.select("b", "a")).distinct())
    vertices = both.select(F.col("u").alias("vertex")).distinct()
    graph, forest = both.where("u <> v"), []
    while not graph.isEmpty():
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = graph.join(least, "u").select(F.col("v").alias("u"), "m").union(least).distinct()
        told = checkpoint(told)
        kept = told.groupBy("u").agg(F.min("m").alias("root"), F.max(F.when(F.col("u") == F.col("m"), 1)).alias("active"))
        kept = checkpoint(kept)
        forest.append(kept.where("active is null").select("u", F.col("root").alias("parent")))
        linked = told.join(kept.select("u", "root"), "u").where("m <> root").select(F.col("m").alias("u"), F.col("root").alias("v"))
        graph = checkpoint(linked.union(linked.select("v", "u")).distinct())
    # Whoever never dropped out is a seed. Names flow from the last round's parents to the first round's leaves.
    labels = None
    for k, tree in enumerate(reversed(forest)):
        if labels is None:
            labels = tree.select("u", F.col("parent").alias("seed"))
        else:
            named = tree.join(labels.withColumnRenamed("u", "parent"), "parent", "left").select("u", F.coalesce("seed", "parent").alias("seed"))
            labels = labels.union(named)
            if k % 4 == 3:
                labels = checkpoint(labels)
    if labels is None:
        return vertices.select("vertex", F.col("vertex").alias("seed"))
    joined = vertices.join(labels.withColumnRenamed("u", "vertex"), "vertex", "left")
    return joined.select("vertex", F.coalesce("seed", "vertex").alias("seed"))
