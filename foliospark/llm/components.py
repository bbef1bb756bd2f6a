"""Connected components of a table of links, by rounds of hooking to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node -> component (its least node), for links (a, b) and nodes (node), all long and not null.

    Each round points every linked node at the least of its neighbours and itself, follows these pointers
    once more, renames the links' ends accordingly and drops those that became loops; the least node of a
    component never changes its name, so it is what remains. The rounds' names are followed at the end. Links and names stay in
    tables, never on the driver. Repeated links, loops and nodes without links are allowed.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hook = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = hook.select(F.col("node").alias("to"), F.col("to").alias("root"))
        root = cut(hook.join(step, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
        rounds.append(root)
        a = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = cut(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    labels = nodes.select("node", F.col("node").alias("component"))
    for root in rounds:
        named = root.select(F.col("node").alias("component"), "root")
        labels = labels.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(labels)
