"""Components of graphs whose links stay on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import new_folder, remove_folder


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b): root is the smallest node within reach.

    Turns of large stars and small stars: each node's neighbours are hung on the smallest of them, until nothing moves.
    The links stay on the cluster, and each turn's are written to the shared folder.
    """
    spark = links.sparkSession
    folder = new_folder(spark, "components")

    def written(df: DataFrame, turn: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{turn}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{turn}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), 0)  # a > b
    turn, before = 0, state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: the larger neighbours of a node go to the least of its neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        turn += 1
        edges = written(small.where("a <> b").distinct(), turn)
        after = state(edges)
        if after == before:
            break
        before = after
        if turn > 1:
            remove_folder(spark, f"{folder}/{turn - 2}")
    hung = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return hung.union(hung.select(F.col("root").alias("node"), "root").distinct())


def names_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (fp, component) from distinct nodes (fp, least): the smallest least of all nodes within reach over the links (a, b)."""
    roots = components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "root")
    smallest = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(smallest, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component")).alias("component"))
