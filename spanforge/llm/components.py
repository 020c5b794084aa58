"""Connected components of an edge table: one contraction, then alternating large and small stars over what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import join_small, materialize

#: Edges from which on a node's edges are dealt apart from the others'.
HUB = 1000


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """Link each node's neighbours to the least of them: the larger ones (large), or the smaller ones and itself. n: how many edges there are, at most."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if n < HUB:
        near = pairs.join(least.drop("n"), "u")
    else:
        # a component's least node has an edge to each other one: such hubs never meet their edges in one task
        hubs = least.filter(F.col("n") >= HUB).select("u", F.col("m").alias("hub"))
        tagged = join_small(pairs, hubs, ["u"], "left", spread=F.col("v"), at_most=2 * n // HUB)
        near = tagged.filter("hub is null").drop("hub").join(least.drop("n"), "u").unionByName(tagged.filter("hub is not null").withColumnRenamed("hub", "m"))
    if large:
        return near.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or is smaller than one node and larger than another: then there is more to link."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): root is the least node of its component.

    First each node moves to the least of itself and its smaller neighbours, which leaves edges only
    between nodes that others moved to: where many nodes share a few least ones, as in buckets with
    a head, next to nothing. Stars then link the rest in about log d rounds for depth d, each a few
    joins and aggregations written to the shared folder. A node's smaller neighbours are gathered
    in one array: callers' graphs have a few for each node (one for each band, or block). Nodes
    without an edge to another node don't occur; an empty table gives no rows.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    gathered = down.union(down.select("b", "b")).groupBy("a").agg(F.collect_set("b").alias("all"))
    moved = materialize(gathered.select(F.col("a").alias("node"), F.least("a", F.array_min("all")).alias("m"), "all"), "moved")
    left = moved.select("m", F.explode("all").alias("b")).filter("b <> m")
    left = materialize(left.select(F.greatest("m", "b").alias("a"), F.least("m", "b").alias("b")).distinct(), "edges")
    n = left.count()
    if not n:
        return moved.select("node", F.col("m").alias("root"))
    while _open(left):
        left = materialize(_star(_star(left, True, n), False, 2 * n), "edges")
        n = left.count()
    roots = left.select(F.col("a").alias("m"), F.col("b").alias("root"))
    return join_small(moved.select("node", "m"), roots, ["m"], "left", spread=F.col("node")).select("node", F.coalesce("root", "m").alias("root"))
