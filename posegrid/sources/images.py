"""Image sources: files as rows, with a fingerprint that does not depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import fingerprint


def materialize(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: name, abs_path, size, modified, content_sha. Contents are read only for the digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), F.col("path").alias("abs_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("content_sha"))


def source_fingerprint(images: DataFrame) -> DataFrame:
    """One row: the fingerprint of name, size, time and digest of every file."""
    return images.agg(fingerprint(images, "name", "size", "modified", "content_sha").alias("fingerprint"))
