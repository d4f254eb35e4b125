"""Connected components by contraction, on DataFrames.

Defined results: edges with a null end and edges of a node to itself are left out,
repeated edges count once, and without edges there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node of the edges (a, b), the smallest node of its component.

    Each round, every node points at its smallest neighbour, pointers are
    followed to their ends, and the edges between the resulting roots are the
    next round's. Rounds are cut by checkpoints in the shared folder; neither
    edges nor nodes reach the driver. Messages to a node are pre-aggregated.
    """
    edges = C.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    final: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        point = C.cut(point.select("node", F.least("node", "root").alias("root")))
        while True:  # follow pointers, which go to smaller nodes only
            ahead = point.select(F.col("node").alias("root"), F.col("root").alias("then"))
            moved = C.cut(point.join(ahead, "root", "left").select("node", "root", F.coalesce("then", "root").alias("then")))
            point = moved.select("node", F.col("then").alias("root"))
            if moved.where("then <> root").isEmpty():
                break
        if final is None:
            final = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("then"))
            final = C.cut(final.join(step, "root", "left").select("node", F.coalesce("then", "root").alias("root")))
        a = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = C.cut(edges.distinct())
    if final is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return final
