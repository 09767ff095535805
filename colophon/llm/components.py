"""Connected components of a graph of links, as DataFrame code.

Each round, every node points to the least of its neighbours and itself; pointers are followed to their ends by doubling;
then the links are moved to the ends and those within one end dropped. The nodes that still have links at least halve each
round. Nothing of the graph reaches the driver but counts; a node with very many links is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): all nodes of the links, with the same root for those that links connect.

    Links of a node with itself and repeated links change nothing; null ends are ignored.
    """
    links = links.filter("a <> b").select("a", "b")
    links = cut(links.union(links.select("b", "a")).distinct())
    roots = None
    while not links.isEmpty():
        to = cut(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = cut(to.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            to = moved.select("node", "root")
            if not moved.filter("moved").limit(1).count():
                break
        if roots is None:
            roots = to
        else:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = cut(links.join(left, "a").join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
