"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.sources.scratch import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Each round every node takes the least root among its own and its neighbours', then the root of its root, which halves
    the distance to go.  Neighbours' roots are reduced by a minimum, so a node with very many edges is combined before the
    shuffle.  Each round is written to the shared scratch folder, which cuts the lineage.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.filter("a <> b").distinct(), "edges")
    roots = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        better = roots.join(near, "node").select("node", F.least("root", "near").alias("new"), F.col("root").alias("old"))
        better = staged(better, "roots")
        of_root = better.select(F.col("node").alias("new"), F.col("new").alias("next"))
        jumped = better.join(of_root, "new", "left").select("node", F.coalesce("next", "new").alias("root"), "old")
        jumped = staged(jumped, "roots")
        roots = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return roots
