"""Connected components on a table of links, with large-star and small-star steps (Kiveris et al.,
"Connected Components in MapReduce and Beyond"). Nothing but two sums goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import remove, scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (u long, v long).

    Links may repeat, go either way or join a node with itself. Each round is written to the
    shared folder, so a lost executor costs no earlier round; the number of rounds grows with the
    logarithm of the longest path. A node with very many links is dealt like any other skewed key:
    minima are pre-aggregated and the join on it can be split.
    """
    spark = links.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch(spark, "links"))
        df.select(F.col("u").cast("long"), F.col("v").cast("long")).write.parquet(paths[-1])
        if len(paths) > 2:
            remove(spark, paths.pop(0))
        return spark.read.schema("u long, v long").parquet(paths[-1])

    edges = kept(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large)  # u > v in every row
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
