"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, drop, join_hot


def star_contraction(edges: DataFrame) -> DataFrame:
    """v, label for every vertex of the edges (lo, hi): alternating large-star and small-star rounds until every edge
    points at the least vertex of its component. Hubs are joined apart (join_hot), so no task gathers one."""
    stars = edges.select(F.col("hi").alias("v"), F.col("lo").alias("w"))
    before = None
    while True:
        both = stars.unionAll(stars.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = both.groupBy("v").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        large = cut(join_hot(both, least, "v", "n").where("w > v").select(F.col("w").alias("v"), F.least("m", "v").alias("w")).distinct())
        least = large.groupBy("v").agg(F.min("w").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, least, "v", "n")
        old, stars = stars, cut(small.select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").unionAll(least.select("v", F.col("m").alias("w"))).distinct())
        drop(old, large)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select("v", F.col("w").alias("label")).unionAll(stars.select(F.col("w").alias("v"), F.col("w").alias("label")).distinct())


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, group_id: every vertex (id) with the least id of its component; edges: a, b, in any direction, repeated or
    not. Null ids and edges to unknown vertices are ignored; a vertex without edges is its own group."""
    known = edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    labels = star_contraction(cut(known)).select(F.col("v").alias("id"), "label")
    return vertices.where("id is not null").select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("group_id"))
