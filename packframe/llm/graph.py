"""Connected components over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packframe.llm.common import cut, discard, join_hot, mark


def _shape(at: DataFrame):
    """The number of links, the most links of a node to smaller ones, and whether a node that has one is linked to by a greater one: stars have at most one, and none is."""
    up, down = at.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), at.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    per = up.unionByName(down).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max("up"), F.lit(0)), F.coalesce(F.max(F.when(F.col("up") > 0, F.col("down"))), F.lit(0))).first()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> (node, root): for every node that has a link, the smallest node it is linked to, directly or not.

    Alternating large-star and small-star steps until every link points to a root. A node's neighbours are never listed: minima are aggregated before the
    shuffle and joined back to the links, those of hot nodes (over 1/1024 of all links) by broadcast. Each round is written to the shared folder, and the one before is deleted."""
    spark, start = links.sparkSession, mark()
    at = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        n, most, chained = _shape(at)
        if most <= 1 and not chained:
            break
        # large star: each node's larger neighbours are linked to its smallest
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        big = join_hot(at.select(F.col("b").alias("a"), F.col("a").alias("b")), least, "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = cut(big.filter("a <> b").distinct(), "large-star")
        # small star: each node and its smaller neighbours are linked to the smallest of them
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        at = cut(small.filter("a <> b").distinct(), "small-star")
        discard(spark, start, keep=1)
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
