"""Connected components by alternating star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """Rows (v, component) for every vertex in `edges` (a, b), of any type with an order; component is its smallest reachable vertex.

    Large-star and small-star steps take turns until the edges stop changing:
    a large star hangs each larger neighbour on a vertex's smallest neighbour,
    a small star does it for the smaller ones. Edges never grow in number, and
    each step is one aggregation and one join on it. Only a count and a checksum
    reach the driver.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = work.save(links, "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        links = work.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots)
