"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of every vertex's component.

    ``edges`` has bigint columns ``u`` and ``v``.  Returns (id, label) for every vertex that has
    an edge to another vertex.  In each round every vertex points to the vertex at most two
    edges away that comes first in a random order drawn anew for the round, and both ends of
    all edges are replaced by what they point to.  A star is gone in one round, and a path
    shrinks by a constant factor a round, whatever its ids.  Vertices and edges stay
    distributed; the pointers of all rounds are followed once, at the end.
    """
    left = cut(edges.where(F.col("u") != F.col("v"))
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    pointers = []
    for r in range(MAX_ROUNDS):
        if left.isEmpty():
            break

        def place(x: str):
            return F.xxhash64(x, F.lit(r))

        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min_by("v", place("v")).alias("x"))
        near = near.select(F.col("u").alias("v"), F.when(place("x") < place("u"), F.col("x")).otherwise(F.col("u")).alias("x"))
        to = cut(both.join(near, "v").groupBy("u").agg(F.min_by("x", place("x")).alias("to"))
                 .withColumnRenamed("u", "id"))
        moved = (left.join(to.select(F.col("id").alias("u"), F.col("to").alias("tu")), "u")
                 .join(to.select(F.col("id").alias("v"), F.col("to").alias("tv")), "v"))
        left = cut(moved.where(F.col("tu") != F.col("tv"))
                   .select(F.greatest("tu", "tv").alias("u"), F.least("tu", "tv").alias("v")).distinct())
        pointers.append(to)
    else:
        raise RuntimeError("components did not settle")
    if not pointers:
        return left.select(F.col("u").alias("id"), F.col("v").alias("label"))
    roots = pointers.pop().withColumnRenamed("to", "root")
    while pointers:
        roots = (pointers.pop().join(roots.withColumnRenamed("id", "to"), "to", "left")
                 .select("id", F.coalesce("root", "to").alias("root")))
    roots = cut(roots)
    labels = roots.groupBy("root").agg(F.min("id").alias("label"))
    return roots.join(labels, "root").select("id", "label")
