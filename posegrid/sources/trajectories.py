"""Plain-text pose and camera files as DataFrames, in this library's conventions.

Comments start with `#`. Quaternions come out with the scalar first; poses keep
the direction their format defines and are tagged with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    return lines.select(F.split("line", r"[\s,]+").alias("f"))


def _doubles(first: int, *places: int):
    return F.array(*(F.get("f", F.lit(first + p)).cast("double") for p in places))


def read_tum(spark: SparkSession, path: str) -> DataFrame:
    """timestamp tx ty tz qx qy qz qw; camera to world."""
    q = _doubles(4, 3, 0, 1, 2)
    return _fields(spark, path).select(F.get("f", F.lit(0)).cast("double").alias("timestamp"), G.quat_to_rotation(G.normalised(q, 4)).alias("r"), _doubles(1, 0, 1, 2).alias("t"), F.lit(G.CAM2WORLD).alias("convention"))


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Twelve numbers of a 3 x 4 camera-to-world matrix a line; the line is the frame."""
    return _fields(spark, path).select(_doubles(0, 0, 1, 2, 4, 5, 6, 8, 9, 10).alias("r"), _doubles(0, 3, 7, 11).alias("t"), F.lit(G.CAM2WORLD).alias("convention"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """CAMERA_ID MODEL WIDTH HEIGHT PARAMS..."""
    at = lambda k: F.get("f", F.lit(k))
    params = F.transform(F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))), lambda x: x.cast("double"))
    return _fields(spark, path).select(at(0).cast("long").alias("camera_id"), at(1).alias("model"), at(2).cast("int").alias("width"), at(3).cast("int").alias("height"), params.alias("params"))


def read_euroc(spark: SparkSession, path: str, camera_to_body: list[float] | None = None) -> DataFrame:
    """timestamp [ns], px, py, pz, qw, qx, qy, qz, ...; the file's poses are body to world.

    camera_to_body, 16 numbers row by row as in a sensor's calibration, makes them
    camera to world; without it the body itself is taken for the camera.
    """
    q = _doubles(4, 0, 1, 2, 3)
    body = _fields(spark, path).select(F.get("f", F.lit(0)).cast("long").alias("timestamp_ns"), G.quat_to_rotation(G.normalised(q, 4)).alias("r"), _doubles(1, 0, 1, 2).alias("t"))
    if camera_to_body is not None:
        m = [float(x) for x in camera_to_body]
        columns = [F.array(*(F.lit(m[4 * i + k]) for i in range(3))) for k in range(4)]  # of the rotation, then the translation
        turned = body.select("timestamp_ns", *(G.rotated("r", columns[k]).alias(f"c{k}") for k in range(3)), G.apply_se3("r", "t", columns[3]).alias("t"))
        body = turned.select("timestamp_ns", F.array(*(F.get(f"c{k}", F.lit(i)) for i in range(3) for k in range(3))).alias("r"), "t")
    return body.withColumn("convention", F.lit(G.CAM2WORLD))
