"""Connected components by frontier breadth-first search over hash-partitioned adjacency, with label contraction.

Each level expands many seeds at once: every node whose hash is smallest among its neighbours is a seed, seeds spread over
a few hops, and edges between differently labelled nodes become the edges of a smaller label graph, in which the colliding
labels are merged the same way.  Every graph, however small, goes through at least one such level; only a label graph of
colliding seeds with at most ``SMALL_GRAPH_EDGES`` edges (a constant, whatever the input) is merged by union-find inside
one executor task, a larger one goes another level.  Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.cluster import cut

SMALL_GRAPH_EDGES = 200_000
HOPS = 3


def _merge_small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["dst"]):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo : lo + 50_000]
        yield pd.DataFrame({"node": part, "label": [root(x) for x in part]})


def _level(edges: DataFrame) -> DataFrame:
    """(node, label) after one round of seeds and ``HOPS`` frontier expansions; edges are distinct and go both ways."""
    ranked = edges.select("src", "dst", F.xxhash64("src").alias("hs"), F.xxhash64("dst").alias("hd"))
    labels = cut(
        ranked.groupBy("src", "hs")
        .agg(F.min("hd").alias("least"))
        .select(F.col("src").alias("node"), F.when(F.col("hs") <= F.col("least"), F.col("src")).alias("label"))
    )
    for _ in range(HOPS):
        frontier = labels.where("label is not null").select(F.col("node").alias("src"), F.col("label").alias("offer"))
        reached = edges.join(frontier, "src").groupBy("dst").agg(F.min("offer").alias("offer"))
        labels = cut(
            labels.join(reached, labels["node"] == reached["dst"], "left").select("node", F.coalesce("label", "offer").alias("label"))
        )
    return labels.select("node", F.coalesce("label", "node").alias("label"))


def components(edges: DataFrame, small: int = SMALL_GRAPH_EDGES) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst); the component is one of its nodes.

    Null ends and self-loops are dropped, repeated edges count once, no edges give no rows.  A node with very many
    neighbours stays spread over edge rows: frontier joins are split by adaptive skew joins and offers are pre-aggregated.
    """
    one = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    work, found = cut(one.distinct()), []
    while True:
        # adjacency lists, hash-partitioned by node and written once for all hops of the level
        both = cut(work.union(work.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition("src"))
        labels = cut(_level(both))
        found.append(labels)
        a = labels.select(F.col("node").alias("src"), F.col("label").alias("la"))
        b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
        work = cut(
            work.join(a, "src").join(b, "dst").where("la <> lb").select(F.least("la", "lb").alias("src"), F.greatest("la", "lb").alias("dst")).distinct()
        )
        if work.count() <= small:
            found.append(work.coalesce(1).mapInPandas(_merge_small, _pair_schema(work)))
            break
    result = found.pop()
    while found:
        lower, upper = found.pop(), result.select(F.col("node").alias("label"), F.col("label").alias("up"))
        result = lower.join(upper, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return result.select("node", F.col("label").alias("component"))


def _pair_schema(df: DataFrame) -> str:
    kind = df.schema["src"].dataType.simpleString()
    return f"node {kind}, label {kind}"
