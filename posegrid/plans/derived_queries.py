"""Derived values over driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derived as D
from ..functions import geometry as G
from ..session import table
from .base import query, spread


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'intrinsics' WHEN p_partkey % 3 = 1 THEN 'rays' END AS kind,
              CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN p_size % 4 END AS height,
              CASE WHEN p_partkey % 3 = 0 THEN 2 * p_size WHEN p_partkey % 3 = 1 THEN CASE WHEN p_size % 4 = 0 THEN 0 ELSE 3 END END AS width FROM part"""
)
def calibration_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and image size of calibrations by intrinsics, by rays, or by nothing; some ray maps have no row."""
    k, s = F.col("p_partkey"), F.col("p_size")
    made = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(k % 3 == 0, F.struct(F.lit("PINHOLE").alias("model"), s.alias("height"), (2 * s).alias("width"))).alias("intrinsics"),
        F.when(k % 3 == 1, F.array_repeat(F.array_repeat(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), 3), s % 4)).alias("rays"),
    )
    size = D.image_size(F.col("intrinsics"), F.col("rays"))
    return made.select("p_partkey", D.calibration_kind(F.col("intrinsics"), F.col("rays")).alias("kind"), size["height"].alias("height"), size["width"].alias("width"))


@query("SELECT l_orderkey, max(l_linenumber) AS height, CAST(max(l_partkey % 8) + 1 AS INTEGER) AS width FROM lineitem GROUP BY l_orderkey")
def map_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of maps in long form: an order's lines as pixels."""
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("v"), (F.col("l_partkey") % 8).alias("u"))
    sized = pixels.groupBy("l_orderkey").agg(D.grid_dims(F.col("v"), F.col("u")).alias("s"))
    return sized.select("l_orderkey", "s.height", "s.width")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 4 <> 0 THEN 16 END AS dim, CASE WHEN vec_id % 4 <> 0 THEN 'float32' END AS kind, CASE WHEN vec_id % 3 = 0 THEN 'indexed' ELSE 'coordinates' END AS mode,
              CAST(CASE WHEN vec_id % 3 = 0 THEN vec_id % 5 ELSE 4 END AS INTEGER) AS matches FROM embeddings"""
)
def feature_and_pair_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and type of descriptors, and pairs made by indices or by coordinates with their number of matches."""
    v = F.col("vec_id")
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("embedding", 16 * k + 1, 16))
    idx = F.transform(F.when(v % 5 > 0, F.sequence(F.lit(1).cast("long"), v % 5)).otherwise(F.array().cast("array<bigint>")), lambda k: F.array(k, k))
    made = table(spark, sf_dir, "embeddings").select("vec_id", F.when(v % 4 != 0, grid).alias("d"), idx.alias("indices"), F.transform(grid, lambda g: F.slice(g, 1, 2)).alias("xy"))
    d = F.col("d")
    sized = ["vec_id", D.descriptor_dim(d).alias("dim"), D.descriptor_type(d).alias("kind")]
    names = ["vec_id", "dim", "kind", "mode", "matches"]
    indexed = made.where("vec_id % 3 = 0").select(*sized, *D.indexed_pair(F.col("indices"))).select(*names)
    return indexed.unionByName(made.where("vec_id % 3 <> 0").select(*sized, *D.coordinate_pair(F.col("xy"), F.col("xy"))).select(*names))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS ref FROM customer")
def view_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What views are shown as: a name, else an image's name, else nothing."""
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 != 0, F.col("c_name")).alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("image_name"))
    return made.select("c_custkey", D.view_id(F.col("name"), F.col("image_name")).alias("ref"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 0.5 ELSE 1.0 END + 0.0 AS scale, """
    + ", ".join(f"{'1.0' if k % 4 == 0 else '0.0'} AS r{k}" for k in range(9))
    + """, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal, 6) ELSE 0.0 END + 0.0 AS t0, 0.0 AS t1, 0.0 AS t2, CASE WHEN s_suppkey % 2 = 0 THEN 'opencv_world2cam' ELSE 'opencv_cam2world' END AS convention FROM supplier"""
)
def sim3_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities from scaled poses, and the identity."""
    s = table(spark, sf_dir, "supplier")
    r, _, _ = G.identity()
    parts = ["scale", "r", "t", "convention"]
    posed = D.sim3_from_se3(r, F.array(F.col("s_acctbal"), F.lit(0.0), F.lit(0.0)), F.lit(G.WORLD2CAM), F.col("s_suppkey") * 0.5)
    made = s.where("s_suppkey % 2 = 0").select("s_suppkey", *(c.alias(n) for c, n in zip(posed, parts)))
    made = made.unionByName(s.where("s_suppkey % 2 <> 0").select("s_suppkey", *(c.alias(n) for c, n in zip(D.sim3_identity(), parts))))
    return made.select("s_suppkey", F.col("scale").cast("double").alias("scale"), *spread("r", 9, "r"), *spread("t", 3, "t"), "convention")
