"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.plans.stage import dropped, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """vertex, component (its smallest vertex) of the undirected edges a, b (long).

    Alternating large-star and small-star steps: every vertex hands its neighbours its smallest one, so
    the number of rounds grows with the logarithm of the longest chain; each round is written to the
    shared folder. Aggregation is by vertex with map-side combining, so a star's centre costs no task its
    whole star. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
        low = both.groupBy("v").agg(F.least(F.min("n"), F.first("v")).alias("low"))
        # large star: larger neighbours point to the smallest one around
        large = both.where("n > v").join(low, "v").select(F.col("low").alias("a"), F.col("n").alias("b")).distinct()
        # small star: a vertex and its smaller neighbours point to the smallest of these
        lows = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(lows, "b")
        after = small.select(F.col("low").alias("a"), F.col("b")).unionByName(small.select(F.col("low").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        after = staged(after, "edges", release=False)
        # done when every vertex has one edge, to a vertex that is smallest in its star
        state = after.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        many = state.where("n > 1").limit(1).count()
        inner = 0 if many else after.select(F.col("a").alias("b")).distinct().join(after.select("b"), "b", "left_semi").limit(1).count()
        dropped(edges)  # nothing reads the round before any more
        edges = after
        if not many and not inner:
            break
    else:
        raise RuntimeError("components did not converge")
    out = edges.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
    return out
