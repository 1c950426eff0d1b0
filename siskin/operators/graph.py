"""Shortest paths over an edge table by joins and minima."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def two_hops(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, distance): the shortest way by one of paths and then one edge; NULL distances give NULL."""
    a, b = paths.alias("a"), edges.alias("b")
    steps = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
    return steps.groupBy("src", "dst").agg(F.min("distance").alias("distance"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a default is set only for a session of one process that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints"


def saved(df: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back, so its lineage ends."""
    path = path or f"{shared_dir(spark)}/siskin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shortest_within(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, distance) of the shortest ways of at most `hops` edges, one frontier after another.

    Each frontier is saved, so a long search has a short lineage and a lost executor
    costs one step.
    """
    spark = edges.sparkSession
    edges = edges.select("src", "dst", "distance").filter("distance is not null")
    best = saved(edges.groupBy("src", "dst").agg(F.min("distance").alias("distance")), spark)
    for _ in range(hops - 1):
        longer = two_hops(best, edges)
        best = saved(best.unionByName(longer).groupBy("src", "dst").agg(F.min("distance").alias("distance")), spark)
    return best
