"""Connected components of an edge table, by hooking and pointer jumping.

Each round maps the edges to the components found so far, hooks every component
to its smallest neighbour if that is smaller, and jumps pointers until each
component points to a root. Edges inside a component drop out, so rounds go on
until none is left: there is no cap. All steps are joins and combined minima over
written tables; a hot node is a hot join key that Spark splits. A node is any
value that can be ordered; with a struct that begins with a key, independent
graphs are solved in one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspark.session import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """(node, label) forest with label < node, each node led to its root."""
    while True:
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("above"))
        once = parents.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
        # two steps a written table; a node whose second step finds nothing above has come to its root
        stepped = cut_lineage(once.join(up, "label", "left").select(
            "node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "roots")
        parents = stepped.select("node", "label")
        if stepped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b) that are not their component's
    smallest; ``labels`` is such a table that is already known. Nodes that don't
    appear are components of their own; repeated edges and loops do no harm."""
    edges = edges.select("a", "b")
    while True:
        if labels is not None:
            for end in ("a", "b"):
                of = labels.select(F.col("node").alias(end), F.col("label").alias("to"))
                edges = edges.join(of, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        hooks = _roots(cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "hooks"))
        if labels is None:
            labels = hooks
        else:
            to = hooks.select(F.col("node").alias("label"), F.col("label").alias("to"))
            moved = labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = cut_lineage(moved.unionByName(hooks), "labels")


def keyed_components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node, comp) with comp the smallest node of its component.
    ``edges``: (keys..., src, dst), undirected; each key is a graph of its own."""
    named = lambda c: F.struct(*keys, F.col(c).alias("node"))
    labels = components(edges.select(named("src").alias("a"), named("dst").alias("b")))
    labels = labels.select("node.*", F.col("label.node").alias("comp"))
    return (nodes.select(*keys, "node").join(labels, keys + ["node"], "left")
            .withColumn("comp", F.coalesce("comp", "node")))
