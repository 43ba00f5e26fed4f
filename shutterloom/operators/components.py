"""Connected components by alternating large and small stars.

Each round is two self-joins on the node; minima are taken with partial aggregation, so the centre
of a large star costs one row a task, and AQE splits it in the joins. Rounds end when the edges stay
the same; their number grows with the logarithm of the longest path. Every round is cut by a
checkpoint in the shared folder. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.session import shared_folder


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node move to the least neighbour; small: those below it."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
    return moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge between two nodes.

    Edges may repeat, point either way, or join a node with itself (ignored); rows with a null end are
    ignored. Without edges the result is empty.
    """
    shared_folder(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNull().alias("x"), F.col(b).isNull().alias("y")).where("not x and not y and a <> b").select("a", "b").distinct().checkpoint()
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = tuple(state)
        now = _star(_star(now, True), False).checkpoint()
