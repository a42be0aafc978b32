"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import hot_keys, join_split, stored


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the least node that can be reached.

    Each round a node takes the least label around it, then the label of its
    label, until no label changes; each round's table is written, so that a lost
    executor costs no more than the round. Nodes with very many edges have these
    dealt over tasks. Nulls are no nodes; loops and repeated edges change nothing.
    """
    e = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    e = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels0")
    hubs = hot_keys(stored(e.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1000"), "hubs"), "b", "n")
    for k in range(1, most_rounds):
        around = join_split(e, labels.select(F.col("node").alias("b2"), F.col("label").alias("l")), "b", "b2", hubs, ["a"]).groupBy(F.col("a").alias("n")).agg(F.min("l").alias("l"))
        near = labels.join(around, labels["node"] == around["n"], "left").select("node", "label", F.least("label", "l").alias("new"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        jumped = near.join(up, near["new"] == up["n"], "left").select("node", F.least("new", "l").alias("new"), "label")
        done = stored(jumped, f"labels{k}")
        labels = done.select("node", F.col("new").alias("label"))
        if done.filter("new <> label").isEmpty():
            return labels
    raise RuntimeError("labels still change; raise most_rounds")
