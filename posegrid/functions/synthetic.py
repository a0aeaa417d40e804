"""Deterministic synthetic scenes: values follow from a seed and row numbers by hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unit(seed: int, *columns: str | Column) -> Column:
    """A double in [0, 1) that depends on the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 24)).cast("double") / float(1 << 24)


def views(spark: SparkSession, n: int = 3) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("view_idx"), F.format_string("view%03d", "id").alias("name"))


def images(spark: SparkSession, n: int = 3, height: int = 8, width: int = 8, seed: int = 0) -> DataFrame:
    """Views with (height, width, 3) pixels of bytes."""
    hexes = F.transform(F.sequence(F.lit(0), F.lit(height * width * 3 - 1)), lambda k: F.lpad(F.hex(F.pmod(F.xxhash64(F.lit(seed), "view_idx", k), F.lit(256))), 2, "0"))
    return views(spark, n).select("view_idx", "name", F.lit(height).alias("h"), F.lit(width).alias("w"), F.lit(3).alias("c"), F.unhex(F.array_join(hexes, "")).alias("pixels"))


def keypoints(spark: SparkSession, n_views: int = 3, n: int = 6, dim: int = 8, side: float = 8.0, seed: int = 0) -> DataFrame:
    """n keypoints per view, in [0, side) squared, with dim-dimensional descriptors."""
    rows = views(spark, n_views).select(F.col("name").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    value = lambda k: unit(seed, "image_id", "idx", F.lit(k)).cast("float")
    descriptor = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.pmod(F.xxhash64(F.lit(seed), "image_id", "idx", d), F.lit(1 << 20)) / float(1 << 20)).cast("float"))
    return rows.select("image_id", F.col("idx").cast("long").alias("idx"), (value(-1) * side).cast("float").alias("x"), (value(-2) * side).cast("float").alias("y"), value(-3).alias("score"), descriptor.alias("descriptor"))


def chain_matches(points: DataFrame) -> DataFrame:
    """Identity matches between consecutive images by name."""
    names = points.select("image_id").distinct()
    following = names.withColumn("image_b", F.lead("image_id").over(Window.orderBy("image_id"))).where("image_b IS NOT NULL")  # one row an image
    return points.join(following, "image_id").select(F.col("image_id").alias("image_a"), "image_b", F.col("idx").alias("m"), F.lit("indexed").alias("mode"), F.col("idx").alias("idx_a"), F.col("idx").alias("idx_b"))
