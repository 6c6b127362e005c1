"""Connected components of a graph given by its edges, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmend.llm._shared import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches, as a table in the shared folder.

    Edges with a null end and edges of a node with itself say nothing; repeated ones count once; without edges the
    result is empty; other columns are ignored.

    Each round replaces the edges by stars; the number of rounds grows with the logarithm of the longest path.  Every
    round ends in a written table.  A node with very many edges is met by partial aggregates, never by a list.
    """
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    scratch = Scratch(edges.sparkSession)
    now = scratch.stored(now, "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large stars: larger neighbours move to the smallest one of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small stars: smaller neighbours and the node itself move to the smallest
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = scratch.stored(small, "stars")
        scratch.clear(keep=1)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    found = scratch.stored(nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    scratch.clear(keep=1)
    return found
