"""Small graph operators: components, contraction, communities."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marula.session import checkpoint


def min_label_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, label) for each vertex, label being the smallest id of its component.

    Labels spread along edges and are then followed to their own labels, which takes
    about as many rounds as the logarithm of the longest path.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = checkpoint(one.union(one.select("v", "u")).distinct())
    labels = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")))
    while True:
        told = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("told"))
        nearer = labels.join(told, labels.id == told.u).select("id", "label", F.least("label", "told").alias("next"))
        up = nearer.select(F.col("id").alias("next"), F.col("next").alias("above"))
        after = nearer.join(up, "next", "left").select("id", F.col("label").alias("old"), F.least("next", F.coalesce("above", "next")).alias("label"))
        after = checkpoint(after)
        labels = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return labels


def contract(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) after nodes are merged: redirected, without loops, one for each unordered pair.

    merged: from_id, to_id.
    """
    m = merged.select("from_id", "to_id")
    moved = edges.join(m.withColumnsRenamed({"from_id": "src", "to_id": "s2"}), "src", "left").join(m.withColumnsRenamed({"from_id": "dst", "to_id": "d2"}), "dst", "left")
    moved = moved.select(F.coalesce("s2", "src").alias("x"), F.coalesce("d2", "dst").alias("y"), "weight").where("x <> y")
    return moved.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum("weight").alias("weight"))


def communities(edges: list[tuple[str, str, float]], rounds: int = 50) -> dict[str, str]:
    """Greedy modularity by moving nodes between neighbouring communities, in a fixed order; small graphs only."""
    near: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    degree = {v: sum(n.values()) for v, n in near.items()}
    total = sum(degree.values()) or 1.0
    home = {v: v for v in near}
    mass = dict(degree)
    for _ in range(rounds):
        moved = False
        for v in sorted(near):
            mass[home[v]] -= degree[v]
            gain: dict[str, float] = defaultdict(float)
            for u, w in near[v].items():
                gain[home[u]] += w
            gain.setdefault(home[v], 0.0)
            best = min(gain, key=lambda c: (-(gain[c] - degree[v] * mass[c] / total), c != home[v], c))
            if best != home[v]:
                home[v], moved = best, True
            mass[best] += degree[v]
        if not moved:
            break
    names: dict[str, str] = {}
    for v in sorted(home):
        names.setdefault(home[v], v)
    return {v: names[c] for v, c in home.items()}
