"""Registries as relations: data types, formats, camera models and vocabularies."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Data types as (id, title, kind, description), in order.
DATA_TYPES = [
    ("image_sequence", "Image sequence", "scene_input", "An ordered collection of images from a single capture."),
    ("camera", "Camera", "scene_input", "A single camera model (intrinsics + distortion)."),
    ("camera_collection", "Camera collection", "scene_input", "A collection of camera models, e.g. a multi-camera rig."),
    ("feature_set", "Feature set", "artifact", "Per-image keypoints and descriptors."),
    ("pair_set", "Pair set", "artifact", "The image pairs selected for matching."),
    ("match_graph", "Match graph", "artifact", "Feature correspondences across image pairs (optionally verified)."),
    ("sparse_model", "Sparse model", "artifact", "A sparse SfM model: camera poses, intrinsics, and a point cloud."),
    ("projection", "Projection", "artifact", "Rendered or reprojected views derived from a reconstruction."),
]
DATA_TYPE_KINDS = ("scene_input", "artifact")
DATA_TYPES_CONTRACT, DATA_TYPES_CONTRACT_VERSION = "datatypes", 1
# Fixed values of the exported contract: formats as (id, kind, description); none has a media type.
FORMATS = [
    ("sfmapi.features.local.v1", "feature_set", "Versioned interchange manifest for per-image keypoints, descriptors, descriptor dtype/layout, and detector metadata."),
    ("sfmapi.features.global.v1", "feature_set", "Versioned interchange manifest for per-image retrieval descriptors."),
    ("sfmapi.pairs.image_names.v1", "pair_set", "Portable image-pair list keyed by dataset image names."),
    ("sfmapi.matches.indexed.v1", "match_graph", "Portable match graph expressed as feature-index pairs."),
    ("sfmapi.matches.coordinates.v1", "match_graph", "Portable detector-free match graph expressed as image coordinates."),
    ("sfmapi.matches.dense.v1", "match_graph", "Portable tiled dense or semi-dense correspondence field."),
    ("sfmapi.matches.verified.v1", "match_graph", "Portable verified correspondences with F/E/H matrices and inliers."),
    ("sfmapi.reconstruction.sparse.v1", "sparse_model", "Portable cameras, image poses, rigs, tracks, and sparse points manifest."),
    ("sfmapi.reconstruction.snapshot.v1", "sparse_model", "Immutable snapshot directory containing portable sparse reconstruction files."),
    ("sfmapi.reconstruction.submodel.v1", "sparse_model", "One disconnected component inside a sparse reconstruction snapshot."),
    ("sfmapi.projection.images.v1", "projection", "Projected image files plus a manifest with source/output geometry metadata."),
]
# Camera models in the order of their ids, with their parameters.
CAMERA_MODELS = [
    ("SIMPLE_PINHOLE", "f cx cy"),
    ("PINHOLE", "fx fy cx cy"),
    ("SIMPLE_RADIAL", "f cx cy k"),
    ("RADIAL", "f cx cy k1 k2"),
    ("OPENCV", "fx fy cx cy k1 k2 p1 p2"),
    ("OPENCV_FISHEYE", "fx fy cx cy k1 k2 k3 k4"),
    ("FULL_OPENCV", "fx fy cx cy k1 k2 p1 p2 k3 k4 k5 k6"),
    ("FOV", "fx fy cx cy omega"),
    ("SIMPLE_RADIAL_FISHEYE", "f cx cy k"),
    ("RADIAL_FISHEYE", "f cx cy k1 k2"),
    ("THIN_PRISM_FISHEYE", "fx fy cx cy k1 k2 p1 p2 k3 k4 sx1 sy1"),
]
# Vocabularies and tolerances of the data contracts.
POSE_CONVENTIONS = ("opencv_cam2world", "opencv_world2cam")
DEFAULT_CONVENTION = "opencv_cam2world"
POINTMAP_FRAMES = ("world", "camera")
CORRESPONDENCE_MODES = ("indexed", "coordinates")
SCALE_CLASSES = ("arbitrary", "normalized", "metric")
SCALE_PROVENANCES = ("model_claimed", "prior_anchored", "unknown")
ROTATION_TOLERANCE, UNIT_TOLERANCE = 1e-5, 1e-3


def data_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(DATA_TYPES)], "ord int, type_id string, title string, kind string, description string")


def formats(spark: SparkSession) -> DataFrame:
    rows = [(k, i, kind, None, about) for k, (i, kind, about) in enumerate(FORMATS)]
    return spark.createDataFrame(rows, "ord int, format_id string, kind string, media_type string, description string")


def camera_models(spark: SparkSession) -> DataFrame:
    rows = [(name, k, len(p.split()), p.split()) for k, (name, p) in enumerate(CAMERA_MODELS)]
    return spark.createDataFrame(rows, "model string, model_id int, num_params int, param_names array<string>")


def lookup_format(df: DataFrame, column: str) -> DataFrame:
    """Add the kind of each format id and whether it is registered; the registry is a fixed, tiny side."""
    known = formats(df.sparkSession).select(F.col("format_id").alias(column), "kind")
    return df.join(F.broadcast(known), column, "left").withColumn("is_core", F.col("kind").isNotNull())


def unserved_types(spark: SparkSession) -> DataFrame:
    """Artifact data types without any format."""
    artifacts = data_types(spark).where("kind = 'artifact'").select("type_id")
    return artifacts.join(formats(spark).select(F.col("kind").alias("type_id")), "type_id", "left_anti")


def data_types_json() -> str:
    """The data-type contract, in declaration order."""
    types = [{"type_id": i, "title": t, "kind": k, "aliases": [], "description": d} for i, t, k, d in DATA_TYPES]
    return json.dumps({"contract": DATA_TYPES_CONTRACT, "contract_schema_version": DATA_TYPES_CONTRACT_VERSION, "kinds": sorted(DATA_TYPE_KINDS), "types": types})
