"""Pose algebra: round trips and conventions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from posegrid.functions import geometry as G
from posegrid.functions import pairs as P


def rot_z(a: float) -> list[float]:
    return [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]


def row(spark, **values):
    """One row of arrays and values; steps are selected one after the other, so that no expression grows."""
    return spark.range(1).select(*(F.array(*map(F.lit, v)).alias(k) if isinstance(v, list) else F.lit(v).alias(k) for k, v in values.items()))


@pytest.mark.parametrize("q", [[1.0, 0, 0, 0], [0.0, 1, 0, 0], [0.0, 0, 1, 0], [0.0, 0, 0, 1], [0.5, -0.5, 0.5, 0.5], [-0.1, 0.7, 0.1, 0.7]])
def test_quaternion_round_trip(spark, q):
    q = [float(x) for x in q]
    n = math.sqrt(sum(x * x for x in q))
    wanted = [x / n * (-1 if q[0] < 0 else 1) for x in q]
    r = row(spark, q=q).select(G.normalised("q", 4).alias("q")).select(G.quat_to_rotation("q").alias("r"))
    assert r.select(G.rotation_to_quat("r")).first()[0] == pytest.approx(wanted, abs=1e-12)


def test_inverse_and_convention(spark):
    df = row(spark, r=rot_z(1.1), t=[-4.0, 0.25, 9.0], c="opencv_cam2world", p=[0.3, 0.4, 0.5])
    r, t, c = G.se3_inverse("r", "t", "c")
    made = df.select("*", r.alias("ri"), t.alias("ti"), c.alias("ci"), G.apply_se3("r", "t", "p").alias("x"))
    back = made.select(G.apply_se3("ri", "ti", "x"), "ci", *G.as_convention("r", "t", "c", "opencv_cam2world")[:2]).first()
    assert back[0] == pytest.approx([0.3, 0.4, 0.5], abs=1e-12) and back[1] == "opencv_world2cam"
    assert back[2] == pytest.approx(rot_z(1.1)) and back[3] == [-4.0, 0.25, 9.0]


def test_camera_centre_and_sim3(spark):
    df = row(spark, q=[1.0, 0.0, 0.0, 0.0], t=[1.0, 2.0, 3.0], s=2.5, r=rot_z(0.4), u=[-3.0, 0.5, 8.0], c="opencv_world2cam", p=[4.0, 5.0, 6.0])
    assert df.select(G.from_world2cam("q", "t")[1]).first()[0] == pytest.approx([-1.0, -2.0, -3.0])
    s, r, t, c = G.sim3_inverse("s", "r", "u", "c")
    made = df.select(s.alias("si"), r.alias("ri"), t.alias("ti"), c.alias("ci"), G.apply_sim3("s", "r", "u", "p").alias("x"), G.sim3_matrix("s", "r", "u").alias("m"))
    got = made.select(G.apply_sim3("si", "ri", "ti", "x"), "m", "ci").first()
    assert got[0] == pytest.approx([4.0, 5.0, 6.0], abs=1e-12)
    assert got[1][15] == 1.0 and got[1][3] == -3.0 and got[1][0] == pytest.approx(2.5 * math.cos(0.4))
    assert got[2] == "opencv_cam2world"


@pytest.mark.parametrize("a, b", [(0, 3), (9, 4), (31, 1_000_003), (88, 17), (0, 2147483646), (6, 6)])
def test_pair_id(spark, a, b):
    p = spark.range(1).select(P.pair_id(F.lit(a), F.lit(b)).alias("p"))
    low, high = P.pair_of(F.col("p"))
    assert tuple(p.select("p", low.alias("l"), high.alias("h")).first()) == (2147483647 * min(a, b) + max(a, b), min(a, b), max(a, b))
