"""Connected components of a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusflow.llm.common import skew_join
from corpusflow.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Each round takes the smallest root among a node's neighbours, then the root's own root, which halves
    the way left; rounds are written to the shared folder, so lineage stays short.  No edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = materialise(both, "edges")
    roots = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hung = materialise(roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was")), "hung")
        sizes = hung.groupBy("root").agg(F.count("*").alias("n"))
        above = sizes.join(hung.select(F.col("node").alias("root"), F.col("root").alias("above")), "root")
        roots = materialise(skew_join(hung, above, ["root"], "n").select("node", F.col("above").alias("root"), "was"), "roots")
        if roots.where("root <> was").isEmpty():
            return roots.select("node", "root")
        roots = roots.select("node", "root")
