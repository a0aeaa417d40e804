"""The scene database as data: tables, columns, versions and their Spark schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the scene-database contract.
TABLES_DDL = """
rigs (rig_id INTEGER, ref_sensor_id INTEGER, ref_sensor_type INTEGER)
rig_sensors (rig_id INTEGER, sensor_id INTEGER, sensor_type INTEGER, sensor_from_rig BLOB)
cameras (camera_id INTEGER, model INTEGER, width INTEGER, height INTEGER, params BLOB, prior_focal_length INTEGER)
frames (frame_id INTEGER, rig_id INTEGER)
frame_data (frame_id INTEGER, data_id INTEGER, sensor_id INTEGER, sensor_type INTEGER)
images (image_id INTEGER, name TEXT, camera_id INTEGER, time_id INTEGER)
pose_priors (pose_prior_id INTEGER, corr_data_id INTEGER, corr_sensor_id INTEGER, corr_sensor_type INTEGER, position BLOB, position_covariance BLOB, gravity BLOB, coordinate_system INTEGER, rotation BLOB, rotation_covariance BLOB, pose_covariance BLOB)
keypoints (image_id INTEGER, rows INTEGER, cols INTEGER, data BLOB)
descriptors (image_id INTEGER, type INTEGER, rows INTEGER, cols INTEGER, data BLOB)
matches (pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB)
two_view_geometries (pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB, config INTEGER, F BLOB, E BLOB, H BLOB, qvec BLOB, tvec BLOB)
videos (video_id INTEGER, name TEXT, source_path TEXT, content_hash TEXT, width INTEGER, height INTEGER, num_frames INTEGER, fps REAL, duration_seconds REAL, codec_name TEXT, sync_group TEXT)
video_frames (video_id INTEGER, image_id INTEGER, frame_id INTEGER, pts_seconds REAL, time_id INTEGER)
image_qualities (image_id INTEGER, quality REAL)
markers (marker_id INTEGER, label TEXT, type INTEGER, world_position BLOB, world_position_cov BLOB, point3D_id INTEGER, enabled INTEGER)
marker_projections (marker_id INTEGER, image_id INTEGER, x REAL, y REAL, size REAL, pinned INTEGER, point2D_idx INTEGER)
"""
EXTENSION_TABLES = ("videos", "video_frames", "image_qualities", "markers", "marker_projections")
EXTENSION_COLUMNS = ("images.time_id", "descriptors.type")
DATABASE_VERSION = (3, 14, 0, 2)
MAX_NUM_IMAGES = 2147483647
EXTRACTOR_TYPES = {"SIFT": 0, "ALIKED_N16ROT": 1, "ALIKED_N32": 2}
UNDEFINED_EXTRACTOR = -1
MATCHER_TYPES = ("SIFT_BRUTEFORCE", "SIFT_LIGHTGLUE", "ALIKED_BRUTEFORCE", "ALIKED_LIGHTGLUE")
CONTRACT_NAME, CONTRACT_SCHEMA_VERSION = "colmap_db", 1

#: (table, [(column, SQL type)]) in declaration order.
TABLES: list[tuple[str, list[tuple[str, str]]]] = [
    (name, [tuple(c.split()) for c in columns.split(", ")]) for name, columns in re.findall(r"(\w+) \((.*)\)", TABLES_DDL)
]
_TYPES = {"INTEGER": T.LongType(), "TEXT": T.StringType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}


def table_schema(name: str) -> T.StructType:
    """Spark schema of one database table."""
    return T.StructType([T.StructField(c, _TYPES[kind]) for c, kind in dict(TABLES)[name]])


def is_extension_table(name: str) -> bool:
    return name in EXTENSION_TABLES


def is_extension_column(table: str, column: str) -> bool:
    return f"{table}.{column}" in EXTENSION_COLUMNS


def extension_columns(table: str) -> list[str]:
    """Columns of a table that the upstream schema lacks, by flag of the column alone."""
    return [c for c, _ in dict(TABLES)[table] if is_extension_column(table, c)]


def column_type(table: str, column: str) -> str | None:
    """SQL type of a column, or None if the table lacks it."""
    return dict(dict(TABLES)[table]).get(column)


def version_number(major: int, minor: int, patch: int, revision: int) -> int:
    """Database version as one number; all but the major part must be below 100."""
    if max(minor, patch, revision) >= 100:
        raise ValueError("minor, patch and revision must each be below 100")
    return ((major * 100 + minor) * 100 + patch) * 100 + revision


def column_rows() -> list[tuple[int, str, int, str, str, bool, bool]]:
    """(table_ord, table, ord, column, sql_type, table_extension, column_extension) of all columns."""
    return [
        (t, name, k, column, kind, is_extension_table(name), is_extension_column(name, column))
        for t, (name, columns) in enumerate(TABLES)
        for k, (column, kind) in enumerate(columns)
    ]


def db_columns(spark: SparkSession) -> DataFrame:
    """The schema as a relation."""
    return spark.createDataFrame(column_rows(), "table_ord int, table_name string, ord int, column_name string, sql_type string, table_extension boolean, column_extension boolean")


def contract_json() -> str:
    """The database contract, in declaration order; free-text notes are not part of it."""
    major, minor, patch, revision = DATABASE_VERSION
    return json.dumps(
        {
            "contract": CONTRACT_NAME,
            "contract_schema_version": CONTRACT_SCHEMA_VERSION,
            "database_version": {"number": version_number(*DATABASE_VERSION), "major": major, "minor": minor, "patch": patch, "revision": revision},
            "pair_id": {"max_num_images": MAX_NUM_IMAGES},
            "extractor_types": {"known": EXTRACTOR_TYPES, "undefined": UNDEFINED_EXTRACTOR, "open_registry": True},
            "matcher_types": {"known": list(MATCHER_TYPES), "open_registry": True},
            "tables": [
                {
                    "name": name,
                    "extension": is_extension_table(name),
                    "columns": [{"name": c, "sql_type": kind, "extension": is_extension_column(name, c)} for c, kind in columns],
                }
                for name, columns in TABLES
            ],
            "upstream_tables": sorted(name for name, _ in TABLES if not is_extension_table(name)),
            "extension_tables": sorted(EXTENSION_TABLES),
            "extension_columns": sorted(EXTENSION_COLUMNS),
        }
    )
