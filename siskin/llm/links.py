"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siskin.llm import blocks


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with a link; root is the smallest node reachable.

    links: columns a and b. Each round writes its links to the shared folder, so lineage
    stays short and a lost executor costs one round. It ends when a round changes nothing.
    Nodes with many links are not joined by a shuffle, so none makes a task large.
    """
    spark = links.sparkSession
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = blocks.written(edges, spark)
    n, before = edges.count(), None
    while True:
        # large star: all larger neighbours of a node go to its smallest neighbour or itself
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("often"))
        large = blocks.with_unique(both, least, "u", "often", 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = blocks.written(large.filter("u != v").distinct(), spark)
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("often"))
        joined = blocks.with_unique(large, small, "u", "often", n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = blocks.written(joined.filter("u != v").distinct(), spark)
        blocks.tidy(spark)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        n, before = now[0], now
