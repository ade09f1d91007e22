"""Connected components of a graph that is only ever held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of `edges` (a, b, longs): the smallest vertex it is connected with.

    Alternating large-star and small-star steps (Kiveris and others, 2014), each a group-by minimum
    and a join back, written to the shared folder. Rounds end when a step changes nothing. Edges
    with a null end and loops are left out.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-0")
    state = None
    while True:
        # Large star: each vertex's larger neighbours are linked to the smallest of its neighbourhood.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "star-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each vertex and its smaller neighbours are linked to the smallest of them.
        large = cut(large, "star-large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "star-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = cut(small, "star-small")
        # Order of rows does not matter to count and sum of hashes.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("v"), "root").unionByName(
        e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
