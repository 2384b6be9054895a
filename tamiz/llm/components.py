"""Connected components of an edge table, by contraction: no vertex list and no neighbour list is ever held in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` ``(a, b)``; the component is its smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their ends (pointers only go down, doubling
    on each step), and contracts the edges to those ends. At least half of the nodes vanish in a round."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = stored(both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to")), "pointers")
        while True:
            further = pointer.alias("p").join(pointer.select(F.col("node").alias("k"), F.col("to").alias("next")), F.col("p.to") == F.col("k"), "left")
            jumped = stored(further.select("p.node", F.coalesce("next", "p.to").alias("to"), (F.coalesce("next", "p.to") != F.col("p.to")).alias("moved")), "pointers")
            pointer = jumped.select("node", "to")
            if not jumped.where("moved").limit(1).count():
                break
        step = pointer.select(F.col("node").alias("k"), F.col("to").alias("end"))
        if found is None:
            found = pointer.select("node", F.col("to").alias("component"))
        else:
            found = found.join(step, F.col("component") == F.col("k"), "left").select("node", F.coalesce("end", "component").alias("component"))
        found = stored(found, "components")
        left = edges.join(step, F.col("a") == F.col("k")).select(F.col("end").alias("x"), "b").join(step, F.col("b") == F.col("k")).select("x", F.col("end").alias("y")).where("x <> y")
        edges = stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return found
