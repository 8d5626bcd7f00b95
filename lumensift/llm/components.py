"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumensift.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node, comp for every node of the undirected edges (a, b): comp is the smallest node of its component.

    Each node points to its smallest neighbour (or itself), pointers are followed to their roots by doubling, edges between roots are the
    next, smaller graph. Neighbours are only ever summed to their minimum, so a star of any size is no large group; every step is written
    to the checkpoint folder. Joins are merged, so no table of nodes goes through the driver. No edges give no rows.
    """
    rest = cut(edges.select("a", "b").where("a <> b").distinct())
    found = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")))
        while True:
            far = to.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            hop = cut(to.join(far.hint("merge"), "comp").select("node", F.col("root").alias("comp"), (F.col("root") != F.col("comp")).alias("moved")))
            to = hop.select("node", "comp")
            if hop.where("moved").isEmpty():
                break
        found = to if found is None else cut(
            found.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("root")).hint("merge"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        a = rest.join(to.select(F.col("node").alias("a"), F.col("comp").alias("ca")).hint("merge"), "a")
        ab = a.join(to.select(F.col("node").alias("b"), F.col("comp").alias("cb")).hint("merge"), "b")
        rest = cut(ab.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).where(F.lit(False))
