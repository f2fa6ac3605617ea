"""Connected components over edge tables, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node of its component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), so the rounds grow with
    the logarithm of the component size. Minima are aggregated on the map side before any shuffle,
    no neighbour list is ever gathered, and each round's edges are written to the shared scratch
    folder. Joins are merge joins by hint, so that no table of nodes is broadcast through the driver
    whatever Spark takes its size to be; minima are written out first, so that a join has nothing but
    two exchanges under it and a node of very many edges can be split. Nulls and self-loops are ignored; an empty table gives no rows.
    """
    star = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    spare: list[DataFrame] = []
    seen = None
    for _ in range(most_rounds):
        both = star.select("a", "b").unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.hint("merge").join(low.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large")
        spare.append(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.hint("merge").join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        nxt = materialize(small.distinct(), "small")
        spare += [star, large, low]
        star = nxt
        mark = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(star, spare)
        spare = []
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    out = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
