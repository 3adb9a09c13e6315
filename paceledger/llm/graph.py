"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceledger.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Each round every node points to the neighbour (or itself) that comes first
    in an order drawn anew for the round, and links are rewritten between the
    nodes pointed to. Every node that isn't first among its neighbours goes, so
    the links shrink by a constant factor a round whatever the shape is, and no
    group of links is ever gathered: both steps are a join and a minimum.
    Empty links give an empty table; loops and repeated links do no harm.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("at")), "nodes")
    turn = 0
    while links.take(1):
        turn += 1
        ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        points = ends.groupBy("a").agg(F.min(order("b")).alias("best")).select("a", F.least(F.col("best"), order("a"))["v"].alias("to"))
        points = materialize(points, "points")
        pa, pb = points.withColumnsRenamed({"a": "_a", "to": "_ta"}), points.withColumnsRenamed({"a": "_b", "to": "_tb"})
        moved = links.join(pa, F.col("a") == F.col("_a")).join(pb, F.col("b") == F.col("_b"))
        moved = moved.where("_ta <> _tb").select(F.least("_ta", "_tb").alias("a"), F.greatest("_ta", "_tb").alias("b")).distinct()
        old = (links, nodes, points)
        links = materialize(moved, "links")
        nodes = materialize(nodes.join(pa, F.col("at") == F.col("_a"), "left").select("node", F.coalesce("_ta", "at").alias("at")), "nodes")
        discard(*old)
    discard(links)
    least = nodes.groupBy("at").agg(F.min("node").alias("component")).withColumnRenamed("at", "_at")
    return nodes.join(least, F.col("at") == F.col("_at")).select("node", "component")
