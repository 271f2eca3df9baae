"""Connected components of a table of links, by contraction.

Every round hooks each root to its smallest neighbour and follows the hooks twice; links inside a component vanish
and the others join the new roots. Components at least halve in number per round, so a long chain takes as few
rounds as its length has digits to base two. Rounds are joins and grouped minima; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b); the root is one of the component's nodes."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "links")
    roots = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        hook = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        hook = stored(hook, "hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("over"))
            hook = hook.join(above, "up").select("node", F.col("over").alias("up"))
        hook = stored(hook, "hooks")
        roots = roots.join(hook.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        roots = stored(roots, "roots")
        edges = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(hook.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        edges = stored(edges.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    return roots
