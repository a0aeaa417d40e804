"""Correspondence graphs, tracks, view sets and procedure reports."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import synthetic
from ..operators import graph, procedures, rules
from ..session import table
from .base import query


@query(
    """WITH f AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 0), pairs AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem)
       SELECT DISTINCT image_id, side FROM (SELECT a AS image_id, 'a' AS side FROM pairs UNION ALL SELECT b, 'b' FROM pairs) WHERE image_id NOT IN (SELECT id FROM f)"""
)
def graph_missing_featureset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image_a"), F.col("l_suppkey").alias("image_b"))
    features = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("image_id"))
    return graph.missing_featuresets(pairs, features)


@query(
    """WITH k AS (SELECT o_orderkey AS id, 1 + o_custkey % 5 AS n FROM orders), m AS (SELECT l_orderkey AS a, l_partkey % 100 + 1 AS b, max(l_linenumber) AS x FROM lineitem GROUP BY ALL)
       SELECT a AS image_a, b AS image_b, 'a' AS side, a AS image_id, x AS most, n FROM m JOIN k ON id = a WHERE x >= n
       UNION ALL SELECT a, b, 'b', b, x - 1, n FROM m JOIN k ON id = b WHERE x - 1 >= n"""
)
def graph_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    matches = line.select(F.col("l_orderkey").alias("image_a"), (F.col("l_partkey") % 100 + 1).alias("image_b"), F.col("l_linenumber").alias("idx_a"), (F.col("l_linenumber") - 1).alias("idx_b"))
    orders = table(spark, sf_dir, "orders")
    points = orders.select(F.col("o_orderkey").alias("image_id"), F.explode(F.sequence(F.lit(0), (F.col("o_custkey") % 5).cast("int"))).alias("idx"))
    return graph.index_range(matches, points)


@query("SELECT CAST(l_partkey AS VARCHAR) AS image_a, CAST(l_suppkey AS VARCHAR) AS image_b, 'GRAPH.self_pair' AS rule_id, count(*) AS n FROM lineitem WHERE l_partkey = l_suppkey GROUP BY ALL")
def graph_self_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("image_a"), F.col("l_suppkey").cast("string").alias("image_b"))
    return rules.violations(pairs, rules.graph_key_rules(), "image_a", "image_b").groupBy("image_a", "image_b", "rule_id").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, nxt AS next_turn FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def chain_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = graph.chain_consecutive(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return chained.select("conv_id", "turn", F.col("next").alias("next_turn"))


@query("SELECT l_partkey AS point_id, count(*) AS track_len, count(DISTINCT l_orderkey) AS images, min(l_linenumber) AS least, max(l_linenumber) AS most FROM lineitem GROUP BY l_partkey")
def track_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_partkey").alias("point_id")).agg(F.count("*").alias("track_len"), F.count_distinct("l_orderkey").alias("images"), F.min("l_linenumber").alias("least"), F.max("l_linenumber").alias("most"))


@query("SELECT l_partkey AS point_id, count(*) AS track_len, string_agg(l_orderkey || ':' || l_linenumber, ' ' ORDER BY l_orderkey, l_linenumber) AS track FROM lineitem GROUP BY l_partkey")
def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested tracks; one track is one row by its nature."""
    nested = graph.track_table(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "point_id"), "point_id", "l_orderkey", "l_linenumber")
    text = F.array_join(F.transform("track", lambda s: F.concat_ws(":", s["l_orderkey"].cast("string"), s["l_linenumber"].cast("string"))), " ")
    return nested.select("point_id", "track_len", text.alias("track"))


@query("SELECT l_partkey AS point_id, count(*) AS seen FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 1 + o_custkey % 5 GROUP BY l_partkey")
def track_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track observations whose keypoint exists."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("point_id"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") - 1).alias("keypoint_idx"))
    counts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (1 + F.col("o_custkey") % 5).alias("n"))
    return graph.known_observations(line, counts).groupBy("point_id").agg(F.count("*").alias("seen"))


_VIEWS = "SELECT o_custkey AS run, o_orderkey AS view, o_orderstatus AS s, o_orderkey % 3 = 0 AS posed, CASE WHEN o_orderkey % 2 = 0 THEN 'opencv_cam2world' ELSE 'opencv_world2cam' END AS conv FROM orders"


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    conv = F.when(o % 2 == 0, "opencv_cam2world").otherwise("opencv_world2cam")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), o.alias("view"), F.when(o % 3 == 0, F.array(F.lit(1.0))).alias("r"), conv.alias("convention"))


@query(
    """WITH v AS (SELECT DISTINCT o_orderkey AS view FROM orders WHERE o_orderkey % 7 <> 0), p AS (SELECT DISTINCT l_orderkey AS view FROM lineitem WHERE l_orderkey % 5 <> 0)
       SELECT coalesce(v.view, p.view) AS view, v.view IS NOT NULL AS has_view, p.view IS NOT NULL AS has_pose FROM v FULL JOIN p ON v.view = p.view WHERE v.view IS NULL OR p.view IS NULL"""
)
def view_pose_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("view"))
    poses = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("view"))
    return graph.align(views, poses, ["view"], "has_view", "has_pose").where("NOT (has_view AND has_pose)")


@query(f"SELECT run, string_agg(CASE WHEN posed THEN '1' ELSE '0' END, '' ORDER BY view) AS mask, count(*) FILTER (posed) AS registered FROM ({_VIEWS}) GROUP BY run")
def registered_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.registered_mask(_views(spark, sf_dir), "run", "view", "r")
    return found.select("run", F.array_join(F.transform("mask", lambda m: F.when(m, "1").otherwise("0")), "").alias("mask"), "registered")


@query(f"SELECT run, 'RES.one_registered' AS rule_id FROM ({_VIEWS}) GROUP BY run HAVING count(*) FILTER (posed) = 0")
def one_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.group_violations(_views(spark, sf_dir), rules.pose_set_rules(), "run")
    return found.where("rule_id = 'RES.one_registered'").select("run", "rule_id")


@query(f"SELECT run, 'RES.mixed_convention' AS rule_id FROM ({_VIEWS}) GROUP BY run HAVING count(DISTINCT CASE WHEN posed THEN conv END) > 1")
def mixed_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.group_violations(_views(spark, sf_dir), rules.pose_set_rules(), "run")
    return found.where("rule_id = 'RES.mixed_convention'").select("run", "rule_id")


@query(
    f"""SELECT run, 'PVS.one_pose_per_view' AS rule_id FROM ({_VIEWS}) GROUP BY run HAVING bool_or(NOT posed)
        UNION ALL SELECT run, 'PVS.mixed_convention' FROM ({_VIEWS}) GROUP BY run HAVING count(DISTINCT conv) > 1"""
)
def posed_view_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.group_violations(_views(spark, sf_dir), rules.viewset_rules(), "run").select("run", "rule_id")


@query(
    """SELECT o_orderkey AS view, 'RES.dense_shape' AS rule_id FROM orders JOIN (SELECT l_orderkey, max(l_linenumber) AS h FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE h <> 1 + o_custkey % 7"""
)
def dense_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointmap and confidence of a view must be of one size."""
    points = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("view")).agg(F.max("l_linenumber").alias("h"), F.lit(3).alias("w"))
    conf = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("view"), (1 + F.col("o_custkey") % 7).alias("conf_h"), F.lit(3).alias("conf_w"))
    return rules.violations(points.join(conf, "view"), rules.dense_shape_rules(), "view").select("view", "rule_id")


@query("SELECT e.event_id, CASE WHEN e.event_id % 5 <> 0 THEN e.user_id END AS time_id, CASE WHEN e.event_id % 5 = 0 THEN 'static' WHEN e.event_id % 13 = 0 THEN 'differs' ELSE 'echoed' END AS state FROM events e")
def image_time_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's time tag against its video frame's; no tag means static."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events")
    images = e.select("event_id", F.when(i % 5 != 0, F.col("user_id")).alias("time_id"))
    frames = e.select("event_id", (F.col("user_id") + F.when(i % 13 == 0, 1).otherwise(0)).alias("frame_time"))
    state = F.when(F.col("time_id").isNull(), "static").when(F.col("time_id") == F.col("frame_time"), "echoed").otherwise("differs")
    return images.join(frames, "event_id").select("event_id", "time_id", state.alias("state"))


def _scene_mapper(t: pa.Table, matches: pa.Table | None = None) -> pa.Table:
    """A mapper for the report: identity poses, none for every third view."""
    n = t.num_rows
    views = t.column("view_idx").to_pylist()
    eye, zero = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0], [0.0, 0.0, 0.0]
    posed = [v % 3 != 2 for v in views]
    return pa.table(
        {
            "scene": t.column("scene"), "view_idx": pa.array(views, pa.int32()),
            "r": pa.array([eye if p else None for p in posed], pa.list_(pa.float64())), "t": pa.array([zero if p else None for p in posed], pa.list_(pa.float64())),
            "convention": pa.array(["opencv_cam2world"] * n), "dense": pa.array([v % 2 == 0 for v in views]), "scale": pa.array(["arbitrary"] * n),
        }
    )


@query(
    """WITH s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 3 <> 2) AS posed, count(*) FILTER (turn % 3 <> 2 AND turn % 2 <> 0) AS bare FROM conversations GROUP BY conv_id),
       r AS (SELECT unnest(['KIT.two_views', 'KIT.poses_align', 'RES.one_registered', 'RES.mixed_convention', 'KIT.emits_dense', 'KIT.metric_capable', 'KIT.requires_correspondences']) AS rule_id)
       SELECT CAST(conv_id AS VARCHAR) AS scene, rule_id,
              CASE rule_id WHEN 'KIT.two_views' THEN n >= 2 WHEN 'RES.one_registered' THEN posed >= 1 WHEN 'KIT.emits_dense' THEN bare = 0 WHEN 'KIT.requires_correspondences' THEN n % 2 = 1 ELSE true END AS holds
       FROM s, r"""
)
def mapper_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scenes, turns as views, and what a mapper that claims dense output keeps of its word."""
    views = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("scene"), F.col("turn").cast("int").alias("view_idx"))
    matches = views.select("scene", (F.col("view_idx") - 1).alias("a"), F.col("view_idx").alias("b"))
    results = procedures.map_views(views, _scene_mapper, matches)
    traits = procedures.MapperTraits(emits_dense=True, requires_correspondences=True)
    return procedures.mapper_report(views, results, traits, procedures.refusals(views, _refusing_mapper))


def _refusing_mapper(t: pa.Table, matches: pa.Table | None = None) -> pa.Table:
    """Refuses scenes of an odd number of views without matches, as its traits say for all."""
    if matches is None and t.num_rows % 2:
        raise procedures.ContractViolation("matches are needed")
    return _scene_mapper(t, matches)


def _index_matcher(a: pa.Table, b: pa.Table) -> pa.Table:
    """Matches keypoints of equal rank; where the first image's number divides by 3, one place too far in the second."""
    n = min(a.num_rows, b.num_rows)
    first = lambda t, c: t.column(c)[0].as_py()
    ia, ib = sorted(a.column("idx").to_pylist())[:n], sorted(b.column("idx").to_pylist())[:n]
    none = pa.nulls(n, pa.float32())
    if n and first(a, "image_a").isdigit() and int(first(a, "image_a")) % 3 == 0:
        ib = [k + 1 for k in ib]
    names = ["image_a", "image_b", "m", "mode", "idx_a", "idx_b", "xa", "ya", "xb", "yb", "score"]
    pair = (first(a, "image_a"), first(a, "image_b")) if n else ("", "")
    cols = [pa.array([pair[0]] * n, pa.string()), pa.array([pair[1]] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(["indexed"] * n, pa.string()), pa.array(ia, pa.int64()), pa.array(ib, pa.int64()), none, none, none, none, pa.array([1.0] * n, pa.float32())]
    return pa.table(cols, names=names)


def _even_verifier(t: pa.Table) -> pa.Table:
    return t.filter(pc.equal(pc.bit_wise_and(t.column("m"), 1), 0))


@query(
    """WITH k AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label),
       p AS (SELECT a.label, a.k AS ka, b.k AS kb FROM k a JOIN k b ON b.label = a.label + 1),
       r AS (SELECT unnest(['KIT.mode', 'KIT.index_range', 'KIT.verifier_mode', 'KIT.verifier_never_grows']) AS rule_id)
       SELECT CAST(label AS VARCHAR) AS image_a, CAST(label + 1 AS VARCHAR) AS image_b, rule_id, rule_id <> 'KIT.index_range' OR label % 3 <> 0 OR ka < kb AS holds FROM p, r"""
)
def matcher_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as images, vectors as keypoints: consecutive labels are matched, verified and reported on."""
    e = table(spark, sf_dir, "embeddings")
    rank = F.row_number().over(graph.Window.partitionBy("label").orderBy("vec_id")) - 1
    points = e.select(F.col("label").cast("string").alias("image_id"), rank.cast("long").alias("idx"))
    labels = e.select("label").distinct()
    pairs = labels.join(labels.select((F.col("label") - 1).alias("label"), F.col("label").alias("next")), "label")
    pairs = pairs.select(F.col("label").cast("string").alias("image_a"), F.col("next").cast("string").alias("image_b"))
    matches = procedures.match(pairs, points, _index_matcher)
    return procedures.matcher_report(matches, points, procedures.MatcherTraits(), procedures.verify(matches, _even_verifier))


@query(
    """SELECT format('view{:03d}', v) AS image_a, format('view{:03d}', v + 1) AS image_b, k AS m, 'indexed' AS mode, k AS idx_a, k AS idx_b
       FROM range(2) AS a(v), range(6) AS b(k)"""
)
def synthetic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic fixture: chained views with identity matches."""
    return synthetic.chain_matches(synthetic.keypoints(spark))
