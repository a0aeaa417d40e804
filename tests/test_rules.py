"""Rules: every breach is found, in order, and clean rows have none."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from posegrid.operators import rules as R

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def found(df, rule_list, key="k"):
    return sorted((r[key], r["rule_id"]) for r in R.violations(df, rule_list, key).collect())


def test_se3(spark):
    mirrored = [-1.0, *EYE[1:]]
    data = [
        (1, EYE, [0.0, 1.0, 2.0], "opencv_cam2world"),
        (2, mirrored, [0.0, 0.0, 0.0], "opencv_cam2world"),
        (3, [2.0, *EYE[1:]], [0.0, 0.0, math.nan], "opengl"),
        (4, EYE[:8], [0.0, 0.0, 0.0], None),
        (5, None, None, "opencv_world2cam"),
    ]
    df = spark.createDataFrame(data, "k int, r array<double>, t array<double>, convention string")
    got = found(df, R.se3_rules())
    assert (2, "ROT.proper") in got and (2, "ROT.orthonormal") not in got
    assert {x for k, x in got if k == 3} == {"SE3.shape", "ROT.orthonormal", "ROT.proper", "SE3.convention"}
    assert {(4, "SE3.shape"), (4, "SE3.convention"), (5, "SE3.shape")} <= set(got)
    assert not [x for x in got if x[0] == 1]
    first = {r["k"]: r["rule_id"] for r in R.first_violation(df, R.se3_rules(), "k").collect()}
    assert first == {2: "ROT.proper", 3: "SE3.shape", 4: "SE3.shape", 5: "SE3.shape"}


def test_depth_only_valid_pixels(spark):
    df = spark.createDataFrame([(1, math.nan, False), (2, 1.5, True), (3, math.inf, True), (4, 0.0, True), (5, -1.0, None), (6, None, True)], "k int, depth double, valid boolean")
    assert found(df, R.depth_rules()) == [(3, "DEPTH.finite"), (4, "DEPTH.positive"), (5, "DEPTH.positive"), (6, "DEPTH.finite")]


def test_pairs(spark):
    one, c = [[0, 1]], [[0.5, 1.0]]
    data = [
        (1, "indexed", one, None, None, None), (2, "coordinates", None, c, c, [1.0]), (3, "indexed", None, c, c, None), (4, "coordinates", one, c, None, None),
        (5, "dense", None, None, None, None), (6, "indexed", [[0, -1]], None, None, [1.0, 2.0]), (7, "coordinates", None, c, c + c, None), (8, "indexed", [], None, None, []),
    ]
    df = spark.createDataFrame(data, "k int, mode string, idx array<array<bigint>>, coords_a array<array<float>>, coords_b array<array<float>>, scores array<float>")
    got = found(df, R.pair_rules())
    assert got == [
        (3, "PAIR.indexed_excl"), (3, "PAIR.indexed_req"), (4, "PAIR.coords_excl"), (4, "PAIR.coords_req"), (5, "PAIR.mode"), (6, "PAIR.indices"), (6, "PAIR.scores"), (7, "PAIR.coords_shape"),
    ]


@pytest.mark.parametrize(
    "rule_list, row, breaches",
    [
        (R.camera_rules, ("PINHOLE", 640, 480, [500.0, 500.0, 320.0, 240.0]), []),
        (R.camera_rules, ("PINHOLE", 0, 480, [500.0]), ["CAM.params", "CAM.size"]),
        (R.camera_rules, (None, 1, 1, None), ["CAM.model", "CAM.params"]),
    ],
)
def test_camera(spark, rule_list, row, breaches):
    df = spark.createDataFrame([(1, *row)], "k int, model string, width int, height int, params array<double>")
    assert [x for _, x in found(df, rule_list())] == breaches


def test_confidence_prior_frame_sha(spark):
    df = spark.createDataFrame([(1, 0.5), (2, -0.1), (3, 1.5), (4, math.nan), (5, None)], "k int, conf double")
    assert {k for k, _ in found(df, R.confidence_rules())} == {2, 3, 4, 5}
    df = spark.createDataFrame([(1, "a" * 64), (2, "A" * 64), (3, "a" * 63 + "\n"), (4, "a" * 63), (5, None)], "k int, sha string")
    assert {k for k, _ in found(df, R.sha_rules())} == {2, 3, 4, 5}
    df = spark.createDataFrame([(1, "first_view", "metric", "unknown"), (2, "", "big", None)], "k int, world_frame string, scale string, scale_provenance string")
    assert [x for _, x in found(df, R.frame_rules())] == ["FRAME.scale", "FRAME.scale_provenance", "FRAME.world_frame"]


def test_more_rule_lists(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 1, 2, 3), (2, math.inf, 0.0, 0.0, 256, 0, 0)], "k int, x double, y double, z double, r int, g int, b int")
    assert found(df, R.cloud_rules()) == [(2, "CLOUD.rgb"), (2, "CLOUD.xyz")]
    df = spark.createDataFrame([(1, "a", 0), (2, "", -1), (3, None, None)], "k int, image_id string, keypoint_idx long")
    assert len(found(df, R.observation_rules())) == 4
    df = spark.createDataFrame([(1, [1, 2], [[1], []]), (2, [1, 2], [[1]]), (3, [1], [None])], "k int, points array<int>, tracks array<array<int>>")
    assert found(df, R.track_rules()) == [(2, "CLOUD.tracks_len"), (3, "CLOUD.track_item")]
    df = spark.createDataFrame([(1, [1.0] * 9, None, None, 3), (2, [1.0] * 8, None, [math.nan] * 9, -1)], "k int, E array<double>, F array<double>, H array<double>, num_inliers long")
    assert [x for _, x in found(df, R.two_view_rules())] == ["TVG.inliers", "TVG.matrix", "TVG.matrix"]
    df = spark.createDataFrame([(1, [True] * 6, 2, 3), (2, [True], 2, 3)], "k int, mask array<boolean>, height int, width int")
    assert found(df, R.mask_rules()) == [(2, "MASK.shape")]
    df = spark.createDataFrame([(1, [0.0, math.nan, 1.0], "world"), (2, [0.0], "moon")], "k int, xyz array<double>, frame string")
    assert found(df, R.pointmap_rules()) == [(2, "PMAP.frame"), (2, "PMAP.shape")]
    df = spark.createDataFrame([(1, "", 0, "f", "k", None, "d"), (2, None, None, "", "k", "", "")], "k int, name string, max_views int, format_id string, kind string, media_type string, description string")
    assert found(df, R.view_rules() + R.option_rules() + R.format_rules()) == [(1, "OPT.max_views"), (1, "VIEW.name"), (2, "FMT.description"), (2, "FMT.id"), (2, "FMT.media_type")]


def test_groups_and_enforce(spark):
    df = spark.createDataFrame([(1, [1.0], "a"), (1, None, "b"), (2, None, "a"), (3, [1.0], "a"), (3, [1.0], "b")], "run int, r array<double>, convention string")
    got = sorted((r["run"], r["rule_id"]) for r in R.group_violations(df, R.pose_set_rules(), "run").collect())
    assert got == [(2, "RES.one_registered"), (3, "RES.mixed_convention")]
    fine = spark.range(5)
    assert R.enforce(fine, [R.Rule("ID", F.col("id") >= 0, "negative")]).count() == 5
    with pytest.raises(Exception, match="ID: too large"):
        R.enforce(fine, [R.Rule("ID", F.col("id") < 4, "too large")]).collect()
    assert R.violations(fine.limit(0), [R.Rule("ID", F.col("id") < 4, "x")], "id").count() == 0


def test_repartitioning_does_not_matter(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7 - 1.0).alias("depth"), F.lit(True).alias("valid"))
    assert found(df, R.depth_rules()) == found(df.repartition(7), R.depth_rules())


def test_results_and_depth_maps(spark):
    schema = "k int, poses array<struct<convention:string>>, calibrations array<string>, dense array<array<struct<kind:string,h:int,w:int>>>"
    p, m, c = ("opencv_cam2world",), ("pointmap", 2, 3), ("confidence", 2, 3)
    rows = [
        (1, [p, None], None, None), (2, [], None, None), (3, [None, None], ["x", None], [None, None]), (4, [p, p], ["x"], [[m, c]]),
        (5, [p, p], None, [[m], None]), (6, [p, p], None, [[c, m], None]), (7, [p, p], None, [None, [m, ("confidence", 3, 2)]]), (8, [p, ("opencv_world2cam",)], None, [[m, c], [m, c]]),
    ]
    assert found(spark.createDataFrame(rows, schema), R.result_rules()) == [
        (2, "RES.nonempty"), (3, "RES.one_registered"), (4, "RES.calibrations_aligned"), (4, "RES.dense_aligned"), (5, "RES.dense_pair"), (6, "RES.dense_member"), (7, "RES.dense_shape"), (8, "RES.mixed_convention"),
    ]
    first = R.first_violation(spark.createDataFrame(rows, schema), R.result_rules(), "k").where("k = 4").first()
    assert first["rule_id"] == "RES.calibrations_aligned"
    maps = [(1, [math.nan, 1.5], [False, True]), (2, [math.nan, 1.5], None), (3, [0.0, 1.0], [True, None]), (4, [1.0], [True]), (5, [1.0, 1.0], [True]), (6, [math.nan, -1.0], [False, False])]
    df = spark.createDataFrame(maps, "k int, depth array<float>, valid array<boolean>").selectExpr("*", "1 AS height", "2 AS width")
    assert found(df, R.depth_map_rules()) == [(2, "DEPTH.finite"), (3, "DEPTH.positive"), (4, "DEPTH.shape"), (4, "DEPTH.valid_shape"), (5, "DEPTH.valid_shape")]
    image = spark.createDataFrame([(1, 0, 2, 4, bytearray(b"x"))], "k int, h int, w int, c int, pixels binary")
    assert R.first_violation(image, R.image_rules(), "k").first()["rule_id"] == "IMG.dtype"
