"""Connected components by alternating large-star and small-star steps, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (both): each vertex ties its larger neighbours to the least of itself and its neighbours.
    Small star: each vertex ties its smaller neighbours and itself to the least of them."""
    half = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if both:
        half = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = half.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    met = half.join(least, half.a == least.v)
    if both:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns v, component for each vertex of an edge; component is the least vertex reachable.

    Each round is written to the shared folder; a round that changes no edge ends it. Hot vertices meet only in
    aggregates that combine before the shuffle and in joins that Spark can split. An edge from a vertex to itself
    is no edge. If rounds do not suffice it raises, so a partial answer never gets out.
    """
    spark = edges.sparkSession
    now = keep(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        large = keep(_star(now, True), "edges")
        then = keep(_star(large, False), "edges")
        discard(spark, now.kept_at)
        discard(spark, large.kept_at)
        now = then
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())
