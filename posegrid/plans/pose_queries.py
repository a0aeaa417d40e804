"""Pose algebra over descriptors that stand in for quaternions, translations and scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import rules
from ..session import table
from .base import query, rounded, spread

_E = lambda k: f"CAST(embedding[{k}] AS DOUBLE)"
_CONV = "CASE WHEN vec_id % 2 = 0 THEN 'opencv_cam2world' ELSE 'opencv_world2cam' END"
_FLIP = "CASE WHEN conv = 'opencv_cam2world' THEN 'opencv_world2cam' ELSE 'opencv_cam2world' END"
#: Quaternion, translation, scale, convention and rotation of every vector.
_BASE = f"""raw AS (
    SELECT vec_id, {_E(1)} AS a, {_E(2)} AS b, {_E(3)} AS c, {_E(4)} AS d, {_E(5)} AS t0, {_E(6)} AS t1, {_E(7)} AS t2,
           abs({_E(8)}) + 0.5 AS s, {_E(9)} AS p0, {_E(10)} AS p1, {_E(11)} AS p2, {_CONV} AS conv FROM embeddings
), unit AS (
    SELECT *, a / n AS w, b / n AS x, c / n AS y, d / n AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM raw)
), rot AS (
    SELECT *, 1 - 2 * (y * y + z * z) AS r0, 2 * (x * y - z * w) AS r1, 2 * (x * z + y * w) AS r2,
           2 * (x * y + z * w) AS r3, 1 - 2 * (x * x + z * z) AS r4, 2 * (y * z - x * w) AS r5,
           2 * (x * z - y * w) AS r6, 2 * (y * z + x * w) AS r7, 1 - 2 * (x * x + y * y) AS r8 FROM unit
), inv AS (
    SELECT *, -(r0 * t0 + r3 * t1 + r6 * t2) AS i0, -(r1 * t0 + r4 * t1 + r7 * t2) AS i1, -(r2 * t0 + r5 * t1 + r8 * t2) AS i2 FROM rot
)"""


def _out(names: list[str], values: list[str]) -> str:
    return ", ".join(f"round({v}, 6) + 0.0 AS {n}" for n, v in zip(names, values))


_R = [f"r{k}" for k in range(9)]
_T = ["t0", "t1", "t2"]
_RT = [f"r{3 * c + r}" for r in range(3) for c in range(3)]
_INV = ["i0", "i1", "i2"]
#: Quaternion of the rotation r0..r8, by the largest component.
_QUAT = """quat AS (
    SELECT *, CASE WHEN r0 + r4 + r8 > 0 THEN 0 WHEN r0 > r4 AND r0 > r8 THEN 1 WHEN r4 > r8 THEN 2 ELSE 3 END AS branch FROM {of}
), sized AS (
    SELECT *, 2 * sqrt(CASE branch WHEN 0 THEN r0 + r4 + r8 + 1 WHEN 1 THEN 1 + r0 - r4 - r8 WHEN 2 THEN 1 + r4 - r0 - r8 ELSE 1 + r8 - r0 - r4 END) AS k FROM quat
), four AS (
    SELECT *, CASE branch WHEN 0 THEN 0.25 * k WHEN 1 THEN (r7 - r5) / k WHEN 2 THEN (r2 - r6) / k ELSE (r3 - r1) / k END AS q0,
           CASE branch WHEN 0 THEN (r7 - r5) / k WHEN 1 THEN 0.25 * k WHEN 2 THEN (r1 + r3) / k ELSE (r2 + r6) / k END AS q1,
           CASE branch WHEN 0 THEN (r2 - r6) / k WHEN 1 THEN (r1 + r3) / k WHEN 2 THEN 0.25 * k ELSE (r5 + r7) / k END AS q2,
           CASE branch WHEN 0 THEN (r3 - r1) / k WHEN 1 THEN (r2 + r6) / k WHEN 2 THEN (r5 + r7) / k ELSE 0.25 * k END AS q3 FROM sized
), done AS (
    SELECT * REPLACE (g * q0 / l AS q0, g * q1 / l AS q1, g * q2 / l AS q2, g * q3 / l AS q3)
    FROM (SELECT *, sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3) AS l, CASE WHEN q0 < 0 THEN -1.0 ELSE 1.0 END AS g FROM four)
)"""
_Q = ["q0", "q1", "q2", "q3"]


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, q, r, t, s, p, convention."""
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    raw = table(spark, sf_dir, "embeddings").select("vec_id", part(1, 4).alias("q0"), part(5, 3).alias("t"), (F.abs(F.get("embedding", F.lit(7)).cast("double")) + 0.5).alias("s"), part(9, 3).alias("p"), F.expr(_CONV).alias("convention"))
    unit = raw.withColumn("q", G.normalised(F.col("q0"), 4)).drop("q0")
    return unit.withColumn("r", G.quat_to_rotation(F.col("q")))


_r, _t, _s, _c = "r", "t", "s", "convention"


@query(f"WITH {_BASE} SELECT vec_id, {_out(_R, _R)} FROM rot")
def quat_to_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poses(spark, sf_dir).select("vec_id", *spread("r", 9, "r"))


@query(f"WITH {_BASE}, {_QUAT.format(of='rot')} SELECT vec_id, branch, {_out(_Q, _Q)} FROM done")
def rotation_to_quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _poses(spark, sf_dir).select("vec_id", G.quat_branch(_r).alias("branch"), G.rotation_to_quat(_r).alias("q"))
    return found.select("vec_id", "branch", *spread("q", 4, "q"))


@query(
    f"""WITH {_BASE}, back AS (SELECT vec_id, r0, r1, r2, r3, r4, r5, r6, r7, r8, t0, t1, t2 FROM rot), {_QUAT.format(of='back')}
        SELECT vec_id, {_out(_Q, _Q)}, {_out(_T, _T)} FROM done"""
)
def world2cam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World-to-camera quaternions into cam-to-world poses and back."""
    made = _poses(spark, sf_dir).select("vec_id", G.quat_to_rotation(G.normalised("q", 4)).alias("r"), "t")
    r, t, c = G.as_convention("r", "t", F.lit(G.WORLD2CAM), G.CAM2WORLD)
    poses = made.select("vec_id", r.alias("r"), t.alias("t"), c.alias("convention"))
    q, t = G.to_world2cam("r", "t", "convention")
    return poses.select("vec_id", q.alias("q"), t.alias("t")).select("vec_id", *spread("q", 4, "q"), *spread("t", 3, "t"))


@query(f"WITH {_BASE} SELECT vec_id, {_out(_R, _RT)}, {_out(_T, _INV)}, {_FLIP} AS convention FROM inv")
def se3_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t, c = G.se3_inverse(_r, _t, _c)
    return _poses(spark, sf_dir).select("vec_id", r.alias("r"), t.alias("t"), c.alias("convention")).select("vec_id", *spread("r", 9, "r"), *spread("t", 3, "t"), "convention")


@query(f"WITH {_BASE} SELECT vec_id, {_out(_T, _INV)} FROM inv")
def camera_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, _ = G.from_world2cam(F.col("q"), _t)
    return _poses(spark, sf_dir).select("vec_id", t.alias("t")).select("vec_id", *spread("t", 3, "t"))


@query(
    f"""WITH {_BASE} SELECT vec_id, {_out(_R, [f"CASE WHEN conv = 'opencv_world2cam' THEN {a} ELSE {b} END" for a, b in zip(_R, _RT)])},
        {_out(_T, [f"CASE WHEN conv = 'opencv_world2cam' THEN {a} ELSE {b} END" for a, b in zip(_T, _INV)])}, 'opencv_world2cam' AS convention FROM inv"""
)
def as_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t, c = G.as_convention(_r, _t, _c, G.WORLD2CAM)
    return _poses(spark, sf_dir).select("vec_id", r.alias("r"), t.alias("t"), c.alias("convention")).select("vec_id", *spread("r", 9, "r"), *spread("t", 3, "t"), "convention")


_M = [f"m{k}" for k in range(16)]
_LAST = [f"CAST({k} AS DOUBLE)" for k in (0, 0, 0, 1)]
_ROWS = [x for k in range(3) for x in (*_R[3 * k : 3 * k + 3], _T[k])]


@query(f"WITH {_BASE} SELECT vec_id, {_out(_M, [*_ROWS, *_LAST])} FROM rot")
def se3_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poses(spark, sf_dir).select("vec_id", G.se3_matrix(_r, _t).alias("m")).select("vec_id", *spread("m", 16, "m"))


@query(f"WITH {_BASE} SELECT vec_id, {_out(_M, [*(x if x in _T else f's * {x}' for x in _ROWS), *_LAST])} FROM rot")
def sim3_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poses(spark, sf_dir).select("vec_id", G.sim3_matrix(_s, _r, _t).alias("m")).select("vec_id", *spread("m", 16, "m"))


@query(f"WITH {_BASE} SELECT vec_id, {_out(['s'], ['1.0 / s'])}, {_out(_R, _RT)}, {_out(_T, [f'(1.0 / s) * {x}' for x in _INV])}, {_FLIP} AS convention FROM inv")
def sim3_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r, t, c = G.sim3_inverse(_s, _r, _t, _c)
    made = _poses(spark, sf_dir).select("vec_id", s.alias("s"), r.alias("r"), t.alias("t"), c.alias("convention"))
    return made.select("vec_id", rounded(F.col("s")).alias("s"), *spread("r", 9, "r"), *spread("t", 3, "t"), "convention")


@query(
    f"""WITH {_BASE} SELECT vec_id, {_out(['x0', 'x1', 'x2'], [f'r{3 * k} * p0 + r{3 * k + 1} * p1 + r{3 * k + 2} * p2 + t{k}' for k in range(3)])},
        {_out(['y0', 'y1', 'y2'], [f's * (r{3 * k} * p0 + r{3 * k + 1} * p1 + r{3 * k + 2} * p2) + t{k}' for k in range(3)])} FROM rot"""
)
def apply_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    made = _poses(spark, sf_dir).select("vec_id", G.apply_se3(_r, _t, p).alias("x"), G.apply_sim3(_s, _r, _t, p).alias("y"))
    return made.select("vec_id", *spread("x", 3, "x"), *spread("y", 3, "y"))


_DOT = lambda a, b: " + ".join(f"m{3 * a + k} * m{3 * b + k}" for k in range(3))


@query(
    f"""WITH {_BASE}, made AS (
          SELECT vec_id, {', '.join(f"r{k} * CASE WHEN vec_id % 5 = 0 THEN 1.001 WHEN vec_id % 7 = 0 AND {k} < 3 THEN -1.0 ELSE 1.0 END AS m{k}" for k in range(9))} FROM rot
        ), judged AS (
          SELECT vec_id, greatest({', '.join(f'abs({_DOT(a, b)} - {1.0 if a == b else 0.0})' for a in range(3) for b in range(a, 3))}) AS e,
                 abs(m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) - 1) AS d FROM made
        )
        SELECT vec_id, 'ROT.orthonormal' AS rule_id FROM judged WHERE e > 1e-5 UNION ALL SELECT vec_id, 'ROT.proper' FROM judged WHERE d > 1e-5"""
)
def rotation_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth rotation is stretched, every seventh mirrored."""
    v = F.col("vec_id")
    factor = lambda k: F.when(v % 5 == 0, 1.001).when((v % 7 == 0) & (k < 3), -1.0).otherwise(1.0)
    made = _poses(spark, sf_dir).select("vec_id", F.transform("r", lambda x, k: x * factor(k)).alias("r"))
    return rules.violations(made, rules.rotation_rules(), "vec_id").select("vec_id", "rule_id")


@query(
    f"""WITH {_BASE}, made AS (SELECT vec_id, sqrt(a * a + b * b + c * c + d * d) AS size FROM (
          SELECT vec_id, w * f AS a, x * f AS b, y * f AS c, z * f AS d FROM (SELECT *, 1 + (vec_id % 5) * 0.0004 AS f FROM unit)))
        SELECT vec_id, 'QUAT.unit' AS rule_id FROM made WHERE abs(size - 1) > 1e-3"""
)
def quaternion_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = 1 + (F.col("vec_id") % 5) * F.lit(0.0004)
    made = _poses(spark, sf_dir).select("vec_id", F.transform("q", lambda x: x * factor).alias("q"), "t")
    return rules.violations(made, rules.quaternion_rules(), "vec_id").select("vec_id", "rule_id")


@query(
    f"""WITH {_BASE}, made AS (SELECT vec_id, CASE vec_id % 11 WHEN 0 THEN 0.0 WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN -s ELSE s END AS s,
          CASE WHEN vec_id % 13 = 0 THEN 'opengl' ELSE conv END AS conv FROM rot)
        SELECT vec_id, 'Sim3.scale' AS rule_id FROM made WHERE NOT (isfinite(s) AND s > 0)
        UNION ALL SELECT vec_id, 'Sim3.convention' FROM made WHERE conv NOT IN ('opencv_cam2world', 'opencv_world2cam')"""
)
def sim3_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    scale = F.when(v % 11 == 0, 0.0).when(v % 11 == 1, float("nan")).when(v % 11 == 2, -F.col(_s)).otherwise(F.col(_s))
    made = _poses(spark, sf_dir).withColumn("scale", scale).withColumn("convention", F.when(v % 13 == 0, "opengl").otherwise(F.col(_c)))
    return rules.violations(made, rules.sim3_rules(), "vec_id").select("vec_id", "rule_id")
