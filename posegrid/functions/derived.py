"""Values that follow from a record's members, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def calibration_kind(intrinsics: Column, rays: Column) -> Column:
    """Which of its two members a calibration has; null for none."""
    return F.when(intrinsics.isNotNull(), "intrinsics").when(rays.isNotNull(), "rays")


def image_size(intrinsics: Column, rays: Column) -> Column:
    """(height, width) of the calibrated image; intrinsics have both as fields, rays are array<array<...>>, row by row."""
    of = lambda h, w: F.struct(h.cast("int").alias("height"), w.cast("int").alias("width"))
    return F.when(intrinsics.isNotNull(), of(intrinsics["height"], intrinsics["width"])).when(rays.isNotNull(), dims(rays))


def dims(grid: Column) -> Column:
    """(height, width) of a map of rays, depths, points, confidences or a mask in nested form; null without a map."""
    return F.when(grid.isNotNull(), F.struct(F.size(grid).alias("height"), F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0)).alias("width")))


def grid_dims(v: Column, u: Column) -> Column:
    """Aggregate: (height, width) of a map in long form, from its pixels' rows and columns."""
    return F.struct((F.max(v) + 1).cast("int").alias("height"), (F.max(u) + 1).cast("int").alias("width"))


def descriptor_dim(descriptors: Column) -> Column:
    """Length of the descriptors; null where there are none."""
    return F.when(descriptors.isNotNull(), F.size(F.get(descriptors, F.lit(0))))


def descriptor_type(descriptors: Column) -> Column:
    """Element type of the descriptors in the contract's names; null where there are none."""
    kind = F.regexp_extract(F.typeof(descriptors), r"^array<array<(\w+)>>$", 1)
    name = F.when(kind == "float", "float32").when(kind == "double", "float64").when(kind.isin("tinyint", "smallint"), "uint8").otherwise(kind)
    return F.when(descriptors.isNotNull(), name)


def indexed_pair(indices: Column) -> tuple[Column, Column, Column]:
    """mode, idx and number of matches of a pair matched by keypoint indices."""
    return F.lit("indexed").alias("mode"), indices.alias("idx"), F.size(indices).alias("matches")


def coordinate_pair(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """mode, both sides and number of matches of a pair matched by image coordinates."""
    return F.lit("coordinates").alias("mode"), a.alias("coords_a"), b.alias("coords_b"), F.size(a).alias("matches")


def view_id(name: Column, image_name: Column) -> Column:
    """What a view is shown as: its name, else its image's, else nothing."""
    return F.coalesce(name, image_name)


def sim3_identity() -> tuple[Column, Column, Column, Column]:
    """scale, r, t and convention of the similarity that changes nothing."""
    return F.lit(1.0), *G.identity()


def sim3_from_se3(r: Column, t: Column, convention: Column, scale: Column | float = 1.0) -> tuple[Column, Column, Column, Column]:
    """A pose as a similarity."""
    return (scale if isinstance(scale, Column) else F.lit(float(scale))), r, t, convention
