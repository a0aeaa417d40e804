"""Validation rules over driver tables, with breaches planted by expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..registry import CAMERA_MODELS
from ..session import table
from .base import query

_NAN, _INF = "CAST('nan' AS DOUBLE)", "CAST('inf' AS DOUBLE)"


def _found(df: DataFrame, rule_list: list[rules.Rule], *keys: str) -> DataFrame:
    return rules.violations(df, rule_list, *keys).select(*keys, "rule_id")


@query("SELECT vec_id, 'SHAPE' AS rule_id FROM embeddings WHERE vec_id % 9 = 0")
def shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth vector has lost its last element."""
    e = table(spark, sf_dir, "embeddings")
    made = e.select("vec_id", F.slice("embedding", 1, F.when(F.col("vec_id") % 9 == 0, 63).otherwise(64)).alias("v"))
    return _found(made, [rules.Rule("SHAPE", rules.sized(F.col("v"), 64), "64 finite values are needed")], "vec_id")


@query(
    """SELECT vec_id, 'FINITE' AS rule_id FROM embeddings WHERE vec_id % 17 IN (3, 5)
       UNION ALL SELECT event_id + 1000000, 'FINITE' FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0"""
)
def finite_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    bad = F.when(v % 17 == 3, float("nan")).when(v % 17 == 5, float("-inf")).otherwise(0.0)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, k: x + F.when(k == 7, bad).otherwise(0.0)).alias("v"))
    first = _found(e, [rules.Rule("FINITE", rules.all_finite(F.col("v")), "not finite")], "vec_id")
    i = F.col("event_id")
    value = F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, float("inf")).otherwise(F.col("value"))
    events = table(spark, sf_dir, "events").select((i + 1000000).alias("vec_id"), value.alias("v"))
    return first.unionByName(_found(events, [rules.Rule("FINITE", rules.finite(F.col("v")), "not finite")], "vec_id"))


@query(
    """SELECT vec_id, 'RAY.unit' AS rule_id FROM (
         SELECT vec_id, sqrt(a * a + b * b + c * c) AS n FROM (
           SELECT vec_id, a * f / s AS a, b * f / s AS b, c * f / s AS c FROM (
             SELECT *, sqrt(a * a + b * b + c * c) AS s, CASE WHEN vec_id % 6 = 0 THEN 1.002 ELSE 1.0 END AS f FROM (
               SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)))
       ) WHERE abs(n - 1) > 1e-3"""
)
def unit_ray_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import geometry as G

    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("v"))
    unit = raw.select("vec_id", G.normalised("v", 3).alias("v"))
    factor = F.when(F.col("vec_id") % 6 == 0, 1.002).otherwise(1.0)
    return _found(unit.select("vec_id", F.transform("v", lambda x: x * factor).alias("ray")), rules.ray_rules(), "vec_id")


_DEPTH = f"""SELECT event_id, user_id, ts, event_type <> 'error' AS valid,
    CASE WHEN event_id % 97 = 0 THEN {_NAN} WHEN event_id % 89 = 0 THEN {_INF} WHEN event_id % 83 = 0 THEN -value WHEN event_id % 79 = 0 THEN 0.0 ELSE value END AS depth FROM events"""


def _depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    depth = F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, float("inf")).when(i % 83 == 0, -F.col("value")).when(i % 79 == 0, 0.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "error").alias("valid"), depth.alias("depth"))


@query(
    f"""SELECT event_id, 'DEPTH.finite' AS rule_id FROM ({_DEPTH}) WHERE valid AND NOT isfinite(depth)
        UNION ALL SELECT event_id, 'DEPTH.positive' FROM ({_DEPTH}) WHERE valid AND NOT (depth > 0)"""
)
def depth_valid_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_depth(spark, sf_dir), rules.depth_rules(), "event_id")


@query(
    f"""SELECT user_id, CASE WHEN bool_or(valid AND NOT isfinite(depth)) THEN 'DEPTH.finite' ELSE 'DEPTH.positive' END AS rule_id
        FROM ({_DEPTH}) WHERE valid AND (NOT isfinite(depth) OR NOT (depth > 0)) GROUP BY user_id"""
)
def first_violation_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a fail-fast check would say of each user's pixels."""
    return rules.first_violation(_depth(spark, sf_dir), rules.depth_rules(), "user_id").select("user_id", "rule_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM (
         SELECT *, CASE WHEN l_partkey % 53 = 0 THEN -0.1 WHEN l_partkey % 59 = 0 THEN 1.5 ELSE l_discount END AS conf FROM lineitem)
       WHERE NOT (conf >= 0 AND conf <= 1) GROUP BY ALL"""
)
def confidence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    conf = F.when(p % 53 == 0, -0.1).when(p % 59 == 0, 1.5).otherwise(F.col("l_discount"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    made = table(spark, sf_dir, "lineitem").select(*keys, conf.alias("conf"))
    return _found(made, rules.confidence_rules(), *keys).groupBy(*keys).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'CHOICE' AS rule_id FROM orders WHERE o_orderstatus NOT IN ('O', 'F') OR o_orderkey % 101 = 0")
def choice_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null is no choice either."""
    status = F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderstatus"))
    made = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("s"))
    return _found(made, [rules.Rule("CHOICE", rules.chosen(F.col("s"), ("O", "F")), "unknown status")], "o_orderkey")


_MODELS = ", ".join(f"({k}, '{name}', {len(p.split())})" for k, (name, p) in enumerate(CAMERA_MODELS))


@query(
    f"""WITH models(id, model, n) AS (VALUES {_MODELS}),
        made AS (SELECT c_custkey, CASE WHEN c_custkey % 12 = 11 THEN 'OMNI' ELSE model END AS model, 3 + c_nationkey % 10 AS given, c_nationkey % 8 AS width,
                        n, c_custkey % 31 = 0 AS bad FROM customer LEFT JOIN models ON id = c_custkey % 12)
        SELECT c_custkey, 'CAM.model' AS rule_id FROM made WHERE model = 'OMNI' UNION ALL
        SELECT c_custkey, 'CAM.size' FROM made WHERE width < 1 UNION ALL
        SELECT c_custkey, 'CAM.params' FROM made WHERE bad OR (model <> 'OMNI' AND given <> n)"""
)
def param_count_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    names = F.array(*(F.lit(name) for name, _ in CAMERA_MODELS), F.lit("OMNI"))
    given = F.lit(3) + F.col("c_nationkey") % 10
    params = F.transform(F.sequence(F.lit(1), given), lambda x: F.when(k % 31 == 0, float("nan")).otherwise(x.cast("double")))
    made = table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (k % 12).cast("int")).alias("model"), (F.col("c_nationkey") % 8).alias("width"), F.lit(480).alias("height"), params.alias("params"))
    return _found(made, rules.camera_rules(), "c_custkey")


@query(
    """SELECT p_partkey, 'VIEW.resolution' AS rule_id FROM (
         SELECT p_partkey, p_size AS a, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS b, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 WHEN p_partkey % 5 = 0 THEN p_size END AS c FROM part)
       WHERE a <> b OR a <> c OR b <> c"""
)
def resolution_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image, calibration and depth of a view, some of them unknown or of another size."""
    p, s = F.col("p_partkey"), F.col("p_size")
    width = F.lit(8)
    made = table(spark, sf_dir, "part").select(
        "p_partkey", s.alias("image_h"), F.when(p % 4 != 0, s).alias("cal_h"), F.when(p % 6 == 0, s + 1).when(p % 5 == 0, s).alias("depth_h"), width.alias("image_w"), width.alias("cal_w"), width.alias("depth_w")
    )
    return _found(made, [rules.resolution_rule(("image_h", "image_w"), ("cal_h", "cal_w"), ("depth_h", "depth_w"))], "p_partkey")


_XOR = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
    CASE WHEN l_partkey % 3 = 0 THEN 'coordinates' WHEN l_partkey % 41 = 0 THEN 'dense' ELSE 'indexed' END AS mode,
    l_partkey % 3 <> 0 OR l_suppkey % 7 = 0 AS has_idx, l_partkey % 3 = 0 AND l_suppkey % 5 <> 0 OR l_suppkey % 11 = 0 AS has_a, l_partkey % 3 = 0 OR l_suppkey % 11 = 0 AS has_b FROM lineitem"""


@query(
    f"""SELECT rule_id, count(*) AS n FROM (
          SELECT unnest([CASE WHEN mode = 'dense' THEN 'PAIR.mode' END,
            CASE WHEN mode = 'indexed' AND (has_a OR has_b) THEN 'PAIR.indexed_excl' END,
            CASE WHEN mode = 'indexed' AND NOT has_idx THEN 'PAIR.indexed_req' END,
            CASE WHEN mode = 'indexed' AND has_idx AND n % 6 = 0 THEN 'PAIR.indices' END,
            CASE WHEN mode = 'coordinates' AND has_idx THEN 'PAIR.coords_excl' END,
            CASE WHEN mode = 'coordinates' AND NOT (has_a AND has_b) THEN 'PAIR.coords_req' END]) AS rule_id FROM ({_XOR}))
        WHERE rule_id IS NOT NULL GROUP BY rule_id"""
)
def pair_mode_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondence modes against what the pairs carry; every line is a pair, with members added or dropped."""
    made = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", *[x.strip() for x in (
        "CASE WHEN l_partkey % 3 = 0 THEN 'coordinates' WHEN l_partkey % 41 = 0 THEN 'dense' ELSE 'indexed' END AS mode",
        "l_partkey % 3 <> 0 OR l_suppkey % 7 = 0 AS has_idx",
        "l_partkey % 3 = 0 AND l_suppkey % 5 <> 0 OR l_suppkey % 11 = 0 AS has_a",
        "l_partkey % 3 = 0 OR l_suppkey % 11 = 0 AS has_b",
    )])
    index = F.when(F.col("n") % 6 == 0, -1).otherwise(F.col("n")).cast("long")
    coords = F.array(F.array(F.lit(0.5).cast("float"), F.lit(1.0).cast("float")))
    pairs = made.select("k", "n", "mode", F.when(F.col("has_idx"), F.array(F.array(index, index))).alias("idx"), F.when(F.col("has_a"), coords).alias("coords_a"), F.when(F.col("has_b"), coords).alias("coords_b"), F.lit(None).cast("array<float>").alias("scores"))
    return _found(pairs, rules.pair_rules(), "k").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id, 'PAIR.coords_shape' AS rule_id FROM embeddings WHERE vec_id % 8 = 0 OR vec_id % 9 = 0")
def coord_matches_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of unequal number, or not finite."""
    v = F.col("vec_id")
    xy = lambda a, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array(F.get("embedding", (a + 2 * k).cast("int")), F.get("embedding", (a + 2 * k + 1).cast("int"))))
    b = F.transform(xy(16, F.when(v % 8 == 0, 3).otherwise(4)), lambda p: F.transform(p, lambda x: F.when(v % 9 == 0, F.lit(float("nan"))).otherwise(x).cast("float")))
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.lit("coordinates").alias("mode"), F.lit(None).cast("array<array<bigint>>").alias("idx"), xy(0, F.lit(4)).alias("coords_a"), b.alias("coords_b"), F.lit(None).cast("array<float>").alias("scores"))
    return _found(pairs, rules.pair_rules(), "vec_id")


@query(
    """SELECT c_custkey, 'CAL.xor' AS rule_id FROM customer WHERE (c_nationkey % 2 = 0) = (c_custkey % 3 = 0)"""
)
def calibration_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.struct(F.lit("PINHOLE").alias("model"))).alias("intrinsics"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1.0))).alias("rays"))
    return _found(made, rules.calibration_rules(), "c_custkey")


@query(
    """SELECT c_custkey, 'FRAME.world_frame' AS rule_id FROM customer WHERE c_custkey % 19 = 0
       UNION ALL SELECT c_custkey, 'FRAME.scale' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
       UNION ALL SELECT c_custkey, 'FRAME.scale_provenance' FROM customer WHERE c_nationkey % 5 = 4"""
)
def frame_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, k = F.col("c_mktsegment"), F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 19 == 0, "").otherwise("first_view").alias("world_frame"),
        F.when(seg == "BUILDING", "metric").when(seg == "MACHINERY", "arbitrary").otherwise("huge").alias("scale"),
        F.get(F.array(*map(F.lit, ("model_claimed", "prior_anchored", "unknown", "unknown", "guessed"))), F.col("c_nationkey") % 5).alias("scale_provenance"),
    )
    return _found(made, rules.frame_rules(), "c_custkey")


@query(
    """SELECT s_suppkey, 'PRIOR.weight' AS rule_id FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 23 = 0
       UNION ALL SELECT s_suppkey, 'PRIOR.covariance' FROM supplier WHERE s_suppkey % 6 = 0
       UNION ALL SELECT s_suppkey, 'PRIOR.is_metric' FROM supplier WHERE s_suppkey % 8 = 0
       UNION ALL SELECT s_suppkey, 'PRIOR.pose.convention' FROM supplier WHERE s_suppkey % 10 = 0"""
)
def pose_prior_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import geometry as G

    k = F.col("s_suppkey")
    r, t, c = G.identity()
    weight = F.when(k % 23 == 0, float("inf")).when(k % 29 != 0, F.col("s_acctbal")).otherwise(F.abs("s_acctbal") * F.when(F.col("s_acctbal") < 0, -1).otherwise(1))
    made = table(spark, sf_dir, "supplier").select(
        "s_suppkey", r.alias("r"), t.alias("t"), F.when(k % 10 == 0, "opengl").otherwise(c).alias("convention"), weight.alias("weight"),
        F.array_repeat(F.lit(0.5), F.when(k % 6 == 0, 35).otherwise(36)).alias("covariance"), F.when(k % 8 != 0, k % 2 == 0).alias("is_metric"),
    )
    return _found(made, rules.prior_rules(), "s_suppkey")


@query(
    """SELECT o_custkey, 'FEAT.descriptors' AS rule_id FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE o_custkey % 5 = 0 AND n > 1
       UNION ALL SELECT o_custkey, 'FEAT.scores' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 7 = 0"""
)
def feature_set_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as keypoints; some descriptors are cut, some scores are missing."""
    k, o = F.col("o_custkey"), table(spark, sf_dir, "orders")
    sets = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    made = sets.select(
        "o_custkey",
        F.transform("keys", lambda x: F.array((x % 100).cast("float"), (x % 77).cast("float"))).alias("xy"),
        F.transform("keys", lambda x, i: F.array_repeat(F.lit(1.0).cast("float"), F.when((k % 5 == 0) & (i == 0), 7).otherwise(8))).alias("descriptors"),
        F.transform(F.slice("keys", 1, F.size("keys") - F.when(k % 7 == 0, 1).otherwise(0)), lambda x: x.cast("float")).alias("scores"),
    )
    return _found(made, rules.feature_rules(), "o_custkey")


@query(
    """SELECT event_id, 'IMG.nonempty' AS rule_id FROM events WHERE event_id % 10 = 0
       UNION ALL SELECT event_id, 'IMG.shape' FROM events WHERE event_id % 7 = 3
       UNION ALL SELECT event_id, 'IMG.dtype' FROM events WHERE event_id % 9 = 4 AND event_id % 10 <> 0"""
)
def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    h, w = (i % 10).cast("int"), F.lit(2)
    c = F.when(i % 7 == 3, 4).when(i % 2 == 0, 3)
    made = table(spark, sf_dir, "events").select("event_id", h.alias("h"), w.alias("w"), c.alias("c"))
    bytes_ = F.col("h") * F.col("w") * F.coalesce("c", F.lit(1)) + F.when((i % 9 == 4) & (F.col("h") > 0), 1).otherwise(0)
    return _found(made.withColumn("pixels", F.repeat(F.lit("x"), bytes_).cast("binary")), rules.image_rules(), "event_id")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag")
def enforced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines pass an enforced rule; one that breaks it would stop the query, as a unit test shows."""
    lines = table(spark, sf_dir, "lineitem").withColumn("conf", F.abs("l_discount"))
    return rules.enforce(lines, rules.confidence_rules()).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
