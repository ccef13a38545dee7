"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm.common import Tables, materialise


def components(edges: DataFrame, kept: Tables | None = None) -> DataFrame:
    """edges(a, b) of longs -> (node, root): for each node of an edge, the smallest node that it reaches. The result is a table of kept, which
    deletes it with its own.

    Each round hooks every root to its smallest neighbour where that is smaller, shortens the paths by pointer
    jumping and contracts the edges; at least half of the roots that have an edge go in a round. Every step is a join or
    an aggregation with a row a node or edge; lineage is cut by written tables.
    """
    with Tables(edges.sparkSession) as tables:
        write, drop, last = tables.write, tables.drop, kept.write if kept else materialise
        edges = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        labels = None
        while not edges.isEmpty():
            hook = write(edges.groupBy("a").agg(F.min("b").alias("b")))
            while True:
                up = hook.select(F.col("a").alias("b"), F.col("b").alias("c"))
                jumped = write(hook.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")))
                hook = jumped.select("a", "b")
                if jumped.where("moved").isEmpty():
                    break
            new = hook.select(F.col("a").alias("node"), F.col("b").alias("root"))
            if labels is None:
                labels = new
            else:
                onward = hook.select(F.col("a").alias("root"), F.col("b").alias("next"))
                labels = labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")).union(new)
            labels = write(labels)
            a = hook.select("a", F.col("b").alias("ra"))
            b = hook.select(F.col("a").alias("b"), F.col("b").alias("rb"))
            moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
            before, edges = edges, write(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            drop(before)
        if labels is None:
            return last(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
        roots = labels.select(F.col("root").alias("node"), "root").distinct()
        return last(labels.union(roots).groupBy("node").agg(F.min("root").alias("root")))
