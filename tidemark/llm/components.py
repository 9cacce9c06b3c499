"""Connected components by labels that jump along pointers.

Defined cases: edges may be listed more than once and in either direction; an edge from a node to itself or with a
null end counts as none; ties can't occur, since the smallest node names a component; an empty table of edges has no
components; other columns of the edges are left out. The edges stay in Spark, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node that has an edge.

    Each round, every node takes the smallest label among its own, its neighbours' and its label's label; labels halve
    their way to the root, so that rounds grow with the logarithm of the longest chain. Rounds are written to the
    shared folder. The rows exchanged are those of the edges; a node with very many edges takes part in a join that
    Spark can split, and in a minimum that is formed before the exchange.
    """
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = materialize(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = materialize(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        own = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
        near = both.join(own, "x").select(F.col("y").alias("node"), F.col("lx").alias("label"))
        up = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").select("node", F.col("top").alias("label"))
        new = near.union(up).union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        # what a node learns it also tells its former label, so that whole trees move at once
        told = labels.join(new.withColumnRenamed("label", "now"), "node").select(F.col("label").alias("node"), F.col("now").alias("label"))
        new = materialize(new.union(told).groupBy("node").agg(F.min("label").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
