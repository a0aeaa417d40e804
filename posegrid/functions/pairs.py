"""Image-pair ids, version numbers and extractor types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTRACTOR_TYPES, MAX_NUM_IMAGES, UNDEFINED_EXTRACTOR

def pair_id(a: Column, b: Column) -> Column:
    """Symmetric id of an image pair, the smaller image in the high digits."""
    a, b = a.cast("long"), b.cast("long")
    return F.lit(MAX_NUM_IMAGES).cast("long") * F.least(a, b) + F.greatest(a, b)


def pair_of(p: Column) -> tuple[Column, Column]:
    """The two image ids of a pair id, smaller first."""
    cap = F.lit(MAX_NUM_IMAGES).cast("long")
    return F.call_function("div", p, cap), F.pmod(p, cap)


def pair_fault(a: Column, b: Column) -> Column:
    """Why a pair has no id, or null."""
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(low < 0, "PAIRID.nonneg").when(high >= MAX_NUM_IMAGES, "PAIRID.cap")


def version_number(major: Column, minor: Column, patch: Column, revision: Column) -> Column:
    """Database version number; null where a part but the major one is 100 or more."""
    fine = (minor < 100) & (patch < 100) & (revision < 100)
    return F.when(fine, major * 1_000_000 + minor * 10_000 + patch * 100 + revision)


def type_compatible(a: Column, b: Column) -> Column:
    """Only descriptor sets of the same extractor may be matched; any name is a type."""
    return a == b


def native_code(df: DataFrame, column: str) -> DataFrame:
    """Add the stored code of an extractor type, -1 for others, and whether it is native."""
    known = df.sparkSession.createDataFrame(list(EXTRACTOR_TYPES.items()), f"{column} string, _code int")
    out = df.join(F.broadcast(known), column, "left")
    return out.withColumn("code", F.coalesce("_code", F.lit(UNDEFINED_EXTRACTOR))).withColumn("is_native", F.col("_code").isNotNull()).drop("_code")
