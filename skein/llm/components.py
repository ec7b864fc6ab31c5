"""Connected components of a link table, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, many_to_one


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long, any order, repeats allowed. One row per id that has a link: (id, root), the smallest id reachable.

    In each round every id points to its smallest neighbour, pointers are followed to their ends (doubling), and links
    are drawn anew between the ends; rounds go on until no link is left. The work of a round shrinks with the ids. Many
    ids may point to one: those joins are dealt to salts.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")))
        while True:
            hop = parent.select(F.col("id").alias("p"), F.col("p").alias("_p"))
            once = many_to_one(parent, hop, ["p"]).select("id", F.col("p").alias("_from"), F.col("_p").alias("p"))
            further = cut(once.join(hop, "p").select("id", F.col("_p").alias("p"), (F.col("_p") < F.col("_from")).alias("moved")))
            parent = further.select("id", "p")
            if further.where("moved").isEmpty():
                break
        if roots is None:
            roots = parent.select("id", F.col("p").alias("root"))
        else:
            further = many_to_one(roots, parent.select(F.col("id").alias("root"), "p"), ["root"], "left")
            roots = cut(further.select("id", F.coalesce("p", "root").alias("root")))
        left = parent.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        right = parent.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved = cut(many_to_one(edges, left, ["a"]).select("b", "pa"))
        moved = many_to_one(moved, right, ["b"]).where("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
