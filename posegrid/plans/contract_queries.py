"""The remaining rules of the data contracts over driver tables, with breaches planted by expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..session import table
from .base import query

_NAN = float("nan")
#: A result without a view has a dense entry only where one is too many.
_DENSE = "(o_orderkey % 13 <> 0 OR o_orderkey % 7 = 0)"


def _breaches(key: str, source: str, **conditions: str) -> str:
    """SQL: one row (key, rule_id) for every condition that a row of the source meets; `__` stands for the dot of a rule's id."""
    return " UNION ALL ".join(f"SELECT {key}, '{rule.replace('__', '.')}' AS rule_id FROM {source} WHERE {where}" for rule, where in conditions.items())


def _found(df: DataFrame, rule_list: list[rules.Rule], *keys: str) -> DataFrame:
    return rules.violations(df, rule_list, *keys).select(*keys, "rule_id")


def _doubles(*xs: float | Column) -> Column:
    return F.array(*((x if isinstance(x, Column) else F.lit(float(x))) for x in xs))


@query(
    _breaches(
        "event_id", "events", PMAP__shape="event_id % 6 = 0", PMAP__frame="event_id % 10 = 3 OR event_id % 10 = 4", MASK__shape="event_id % 7 = 2",
        CONF__shape="event_id % 9 = 1 OR event_id % 9 = 4", CONF__range="event_id % 9 = 1 OR event_id % 9 = 2",
    )
)
def dense_part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointmaps of two numbers, unknown frames, masks that are too small, confidences that are NaN, null or above 1."""
    i = F.col("event_id")
    made = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 6 == 0, _doubles(1, 2)).otherwise(_doubles(1, _NAN, 3)).alias("xyz"),
        F.when(i % 10 == 3, "sky").when(i % 10 != 4, "world").alias("frame"),
        F.array_repeat(F.lit(True), F.when(i % 7 == 2, 5).otherwise(6)).alias("mask"),
        F.lit(2).alias("height"),
        F.lit(3).alias("width"),
        F.when(i % 9 == 1, _NAN).when(i % 9 == 2, 1.5).when(i % 9 != 4, 1.0).alias("conf"),
    )
    return _found(made, [*rules.pointmap_rules(), *rules.mask_rules(), *rules.confidence_rules()], "event_id")


@query(
    _breaches(
        "event_id", "events", DEPTH__shape="event_id % 8 = 0", DEPTH__valid_shape="event_id % 9 = 0", DEPTH__finite="event_id % 7 = 3 AND event_id % 2 = 1",
        DEPTH__positive="event_id % 11 = 5 AND event_id % 2 = 1",
    )
)
def depth_map_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 2 x 3 pixels in nested form; the fourth pixel may be bad, but even maps mask it."""
    i = F.col("event_id")
    bad = F.when(i % 7 == 3, _NAN).when(i % 11 == 5, -1.0).otherwise(2.0)
    bad = F.when((i % 7 == 3) & (i % 11 == 5) & (i % 2 == 1), float("-inf")).otherwise(bad)  # breaks both rules
    pixels = F.slice(_doubles(1, 1, 1, bad, 1, 1), 1, F.when(i % 8 == 0, 5).otherwise(6))
    mask = F.slice(F.array(*(F.lit(k) != 3 for k in range(6))), 1, F.when(i % 9 == 0, 5).otherwise(6))
    whole = F.array_repeat(F.lit(True), F.when(i % 9 == 0, 5).otherwise(6))
    made = table(spark, sf_dir, "events").select("event_id", pixels.alias("depth"), F.when(i % 2 == 0, mask).otherwise(whole).alias("valid"), F.lit(2).alias("height"), F.lit(3).alias("width"))
    return _found(made, rules.depth_map_rules(), "event_id")


@query(
    "SELECT s_suppkey, 'TVG.matrix' AS rule_id FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL "
    + _breaches("s_suppkey", "supplier", TVG__matrix="s_suppkey % 5 = 0", TVG__inliers="s_suppkey % 6 = 1")
)
def two_view_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of eight numbers or with a NaN, negative inlier counts; nulls are allowed."""
    k = F.col("s_suppkey")
    made = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.array_repeat(F.lit(1.0), F.when(k % 4 == 0, 8).otherwise(9)).alias("E"),
        F.lit(None).cast("array<double>").alias("F"),
        F.when(k % 3 != 0, _doubles(*[1.0] * 9)).alias("h0"),
        F.when(k % 6 == 1, -1).when(k % 6 != 2, F.col("s_nationkey")).cast("long").alias("num_inliers"),
    )
    spoiled = F.when(k % 5 == 0, _doubles(*[1.0] * 8, _NAN)).otherwise(F.col("h0"))
    return _found(made.select("*", spoiled.alias("H")), rules.two_view_rules(), "s_suppkey")


@query(
    _breaches(
        "p_partkey", "part", OBS__image_id="p_partkey % 8 < 2", OBS__keypoint_idx="p_partkey % 5 < 2", CLOUD__xyz="p_partkey % 7 < 2", CLOUD__rgb="p_partkey % 11 < 2",
        GRAPH__image_id="p_partkey % 8 < 2",
    )
)
def cloud_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations without an image or keypoint, points without a finite place, colours beyond a byte."""
    p = F.col("p_partkey")
    made = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(p % 8 == 0, "").when(p % 8 != 1, F.col("p_name")).alias("image_id"),
        F.when(p % 5 == 0, -1).when(p % 5 != 1, F.col("p_size")).cast("long").alias("keypoint_idx"),
        F.when(p % 7 == 0, _NAN).otherwise(1.0).alias("x"),
        F.when(p % 7 != 1, 2.0).alias("y"),
        F.lit(3.0).alias("z"),
        F.when(p % 11 == 0, 256).otherwise(255).alias("r"),
        F.when(p % 11 == 1, -1).alias("g"),
        F.lit(0).alias("b"),
    )
    return _found(made, [*rules.observation_rules(), *rules.cloud_rules(), *rules.image_id_rules()], "p_partkey")


@query(_breaches("c_custkey", "customer", CLOUD__tracks_len="c_custkey % 4 = 1", CLOUD__track_item="c_custkey % 5 = 2 AND c_custkey % 3 <> 0"))
def track_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks in nested form: one too few, or a null among them; no tracks at all are allowed."""
    k = F.col("c_custkey")
    item = F.when(k % 5 != 2, F.array(F.lit(1)))
    tracks = F.when(k % 4 == 1, F.array(F.array(F.lit(1)), item)).when(k % 3 != 0, F.array(F.array(F.lit(1)), F.array().cast("array<int>"), item))
    tracks = F.when((k % 4 == 1) & (k % 3 == 0), F.array(F.array(F.lit(1)))).otherwise(tracks)
    made = table(spark, sf_dir, "customer").select("c_custkey", F.array(*map(F.lit, (1, 2, 3))).alias("points"), tracks.alias("tracks"))
    return _found(made, rules.track_rules(), "c_custkey")


@query(_breaches("o_orderkey", "orders", VIEW__name="o_orderkey % 6 = 0", OPT__max_views="o_orderkey % 7 < 2", GRAPH__pair_key="o_orderkey % 10 < 2 OR o_orderkey % 6 = 0", GRAPH__self_pair="o_orderkey % 10 = 2 OR o_orderkey % 30 = 0"))
def view_option_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty names, options below 1, pairs without an image id or of one image."""
    k = F.col("o_orderkey")
    name = F.when(k % 6 == 0, "").otherwise(F.format_string("o%d", k))
    other = F.when(k % 10 == 0, "").when(k % 10 == 1, None).when(k % 10 == 2, name).otherwise("other")
    made = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("image_a"), other.alias("image_b"), F.when(k % 7 == 0, 0).when(k % 7 == 1, -2).when(k % 7 == 2, 1).alias("max_views"))
    return _found(made, [*rules.view_rules("image_a"), *rules.option_rules(), *rules.graph_key_rules()], "o_orderkey")


@query(_breaches("p_partkey", "part", FMT__id="p_partkey % 5 = 0", FMT__kind="p_partkey % 6 < 2", FMT__media_type="p_partkey % 7 = 0", FMT__description="p_partkey % 8 < 2"))
def format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats without an id, a kind or a description; a media type may be missing but not empty."""
    p = F.col("p_partkey")
    made = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(p % 5 == 0, "").otherwise(F.col("p_name")).alias("format_id"),
        F.when(p % 6 == 0, "").when(p % 6 != 1, "feature_set").alias("kind"),
        F.when(p % 7 == 0, "").when(p % 7 != 1, "text/plain").alias("media_type"),
        F.when(p % 8 == 0, "").when(p % 8 != 1, "About it.").alias("description"),
    )
    return _found(made, rules.format_rules(), "p_partkey")


@query(_breaches("vec_id", "embeddings", SE3__shape="vec_id % 5 = 0 OR vec_id % 7 < 2", SE3__convention="vec_id % 11 < 2", TVEC__shape="vec_id % 7 < 2", RAY__shape="vec_id % 9 < 2"))
def pose_shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations of eight numbers, translations of two or with a NaN, unknown conventions, rays of two numbers or none."""
    v = F.col("vec_id")
    eye = F.slice(_doubles(1, 0, 0, 0, 1, 0, 0, 0, 1), 1, F.when(v % 5 == 0, 8).otherwise(9))
    made = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        eye.alias("r"),
        F.when(v % 7 == 0, _doubles(1, 2)).when(v % 7 == 1, _doubles(1, 2, _NAN)).otherwise(_doubles(1, 2, 3)).alias("t"),
        F.when(v % 11 == 0, "opengl").when(v % 11 != 1, "opencv_world2cam").alias("convention"),
        _doubles(1, 0, 0, 0).alias("q"),
        F.when(v % 9 == 0, _doubles(0, 1)).when(v % 9 != 1, _doubles(0, 1, 0)).alias("ray"),
    )
    wanted = F.col("rule_id").isin("SE3.shape", "SE3.convention", "TVEC.shape", "RAY.shape")
    return _found(made, [*rules.se3_rules(), *rules.quaternion_rules(), *rules.ray_rules()], "vec_id").where(wanted)


@query(_breaches("o_orderkey", "orders", FEAT__keypoints="o_orderkey % 4 = 0 OR o_orderkey % 9 = 1", PAIR__scores="o_orderkey % 6 < 2"))
def keypoint_score_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of three numbers or with a NaN, and scores that are too few or not finite."""
    k = F.col("o_orderkey")
    number = lambda x: F.lit(float(x)).cast("float")
    second = F.when(k % 4 == 0, F.array(number(1), number(2), number(3))).when(k % 9 == 1, F.array(number(1), number(_NAN))).otherwise(F.array(number(1), number(2)))
    made = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(F.array(number(0), number(0)), second).alias("xy"),
        F.lit(None).cast("array<array<float>>").alias("descriptors"),
        F.lit(None).cast("array<float>").alias("feature_scores"),
        F.lit("indexed").alias("mode"),
        F.array(F.array(F.lit(0).cast("long"), k), F.array(k, F.lit(1).cast("long"))).alias("idx"),
        F.lit(None).cast("array<array<float>>").alias("coords_a"),
        F.lit(None).cast("array<array<float>>").alias("coords_b"),
        F.when(k % 6 == 0, F.array(number(1))).when(k % 6 == 1, F.array(number(1), number(_NAN))).when(k % 6 != 2, F.array(number(1), number(0))).alias("scores"),
    )
    return _found(made, [*rules.feature_rules(scores="feature_scores"), *rules.pair_rules()], "o_orderkey")


@query(
    _breaches(
        "o_orderkey", "orders", RES__nonempty="o_orderkey % 13 = 0", RES__one_registered="o_orderkey % 13 = 1", RES__mixed_convention="o_orderkey % 13 = 2",
        RES__calibrations_aligned="o_orderkey % 5 = 0", RES__dense_aligned="o_orderkey % 7 = 0", RES__dense_pair=f"o_orderkey % 8 = 1 AND {_DENSE}", RES__dense_member=f"o_orderkey % 8 = 2 AND {_DENSE}", RES__dense_shape=f"o_orderkey % 8 = 3 AND {_DENSE}",
    )
)
def result_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three views in nested form: poses, calibrations and dense parts that do not fit each other."""
    k = F.col("o_orderkey")
    pose = lambda c: F.struct(F.lit(c).alias("convention"))
    none = F.lit(None).cast("struct<convention:string>")
    views = F.when(k % 13 == 0, 0).otherwise(3)
    poses = F.when(k % 13 == 0, F.array().cast("array<struct<convention:string>>")).when(k % 13 == 1, F.array(none, none, none))
    poses = poses.when(k % 13 == 2, F.array(pose("opencv_cam2world"), none, pose("opencv_world2cam"))).otherwise(F.array(pose("opencv_cam2world"), none, pose("opencv_cam2world")))
    part = lambda kind, h: F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("h"), F.lit(4).alias("w"))
    fine = F.array(part("pointmap", 3), part("confidence", 3))
    odd = F.when(k % 8 == 1, F.array(part("pointmap", 3))).when(k % 8 == 2, F.array(part("confidence", 3), part("pointmap", 3))).when(k % 8 == 3, F.array(part("pointmap", 3), part("confidence", 2))).otherwise(fine)
    size = views + F.when(k % 7 == 0, 1).otherwise(0)
    dense = F.slice(F.array(odd, F.when(k % 2 == 0, fine), odd, fine), 1, size)
    made = table(spark, sf_dir, "orders").select("o_orderkey", poses.alias("poses"), F.when(k % 5 < 4, F.array_repeat(F.lit("PINHOLE"), views + F.when(k % 5 == 0, 1).otherwise(0))).alias("calibrations"), dense.alias("dense"))
    return _found(made, rules.result_rules(), "o_orderkey")


@query(
    """SELECT c_custkey AS run, rule_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 11 = 0, (SELECT unnest(['PVS.nonempty', 'RES.nonempty']) AS rule_id)
       WHERE o_orderkey IS NULL"""
)
def empty_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any of these orders are sets without a view and results without a pose."""
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("view"))
    sets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")).join(orders, "run", "left")
    return rules.group_violations(sets, [rules.nonempty_rule("PVS.nonempty", "view"), rules.nonempty_rule("RES.nonempty", "view")], "run").select("run", "rule_id")
