"""Pair ids, versions, extractor types and matching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..operators import graph, procedures, rules
from ..session import table
from .base import query, rounded

_PAIRS = "SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem"
_ID = "CAST(2147483647 AS BIGINT) * least(a, b) + greatest(a, b)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()


@query(f"SELECT a, b, {_ID} AS pair_id FROM ({_PAIRS})")
def pair_id_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("pair_id", P.pair_id(F.col("a"), F.col("b")))


@query(
    f"""SELECT pair_id, pair_id // 2147483647 AS image_1, pair_id % 2147483647 AS image_2,
               pair_id // 2147483647 = least(a, b) AND pair_id % 2147483647 = greatest(a, b) AS round_trip
        FROM (SELECT a, b, {_ID} AS pair_id FROM ({_PAIRS}))"""
)
def pair_id_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pair_id_encode(spark, sf_dir)
    low, high = P.pair_of(F.col("pair_id"))
    out = ids.select("pair_id", "a", "b", low.alias("image_1"), high.alias("image_2"))
    same = (F.col("image_1") == F.least("a", "b")) & (F.col("image_2") == F.greatest("a", "b"))
    return out.select("pair_id", "image_1", "image_2", same.alias("round_trip"))


@query(
    f"""WITH bad AS (SELECT DISTINCT CASE WHEN a % 50 = 0 THEN -a WHEN a % 37 = 0 THEN 2147483647 + a ELSE a END AS image_a, b AS image_b FROM ({_PAIRS}))
        SELECT image_a, image_b, 'PAIRID.nonneg' AS rule_id FROM bad WHERE image_a < 0 OR image_b < 0
        UNION ALL SELECT image_a, image_b, 'PAIRID.cap' FROM bad WHERE image_a >= 2147483647 OR image_b >= 2147483647"""
)
def pair_id_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("a")
    bad = _pairs(spark, sf_dir).select(F.when(a % 50 == 0, -a).when(a % 37 == 0, a + 2147483647).otherwise(a).alias("image_a"), F.col("b").alias("image_b"))
    return rules.violations(bad.distinct(), rules.pair_id_rules(), "image_a", "image_b").select("image_a", "image_b", "rule_id")


@query(
    """SELECT major, minor, patch, revision, CASE WHEN minor < 100 AND patch < 100 AND revision < 100 THEN major * 1000000 + minor * 10000 + patch * 100 + revision END AS number
       FROM (SELECT CAST(o_orderkey % 5 AS BIGINT) AS major, CAST(o_orderkey % 113 AS BIGINT) AS minor, CAST(o_custkey % 101 AS BIGINT) AS patch, CAST(o_orderkey % 7 AS BIGINT) AS revision FROM orders)"""
)
def db_version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = o.select((F.col("o_orderkey") % 5).alias("major"), (F.col("o_orderkey") % 113).alias("minor"), (F.col("o_custkey") % 101).alias("patch"), (F.col("o_orderkey") % 7).alias("revision"))
    return parts.withColumn("number", P.version_number(*(F.col(c) for c in parts.columns)))


@query("SELECT 3 * 1000000 + 14 * 10000 + 0 * 100 + 2 AS number, 'DBVER.components' AS rule_id, CAST(1 AS BIGINT) AS breaches FROM (SELECT 1)")
def db_version_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current number, and how many of two candidate versions break the rule."""
    from ..schemas import DATABASE_VERSION, version_number

    made = spark.createDataFrame([(3, 14, 0, 2), (3, 100, 0, 0)], "major int, minor int, patch int, revision int")
    found = rules.violations(made, rules.version_rules(), "major")
    return found.groupBy("rule_id").agg(F.count("*").alias("breaches")).select(F.lit(version_number(*DATABASE_VERSION)).alias("number"), "rule_id", "breaches")


@query(
    """SELECT x.vec_id AS image_a, x.vec_id + 1 AS image_b, x.label = y.label AS compatible FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1 AND y.vec_id % 10 <> 0 WHERE x.vec_id % 10 <> 0
       UNION ALL SELECT vec_id, vec_id + 1, NULL FROM embeddings WHERE vec_id % 10 = 0"""
)
def type_guard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which neighbours may be matched by the types of their descriptor sets; every tenth image has no set."""
    e = table(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("vec_id").alias("image_a"), (F.col("vec_id") + 1).alias("image_b"))
    return graph.guard_types(pairs, e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("image_id"), F.col("label").alias("type")))


_TYPE = "CASE label % 5 WHEN 0 THEN 'SIFT' WHEN 1 THEN 'ALIKED_N16ROT' WHEN 2 THEN 'ALIKED_N32' WHEN 3 THEN 'LOFTR' ELSE 'ROMA' END"


@query(
    f"""SELECT vec_id, type, CASE type WHEN 'SIFT' THEN 0 WHEN 'ALIKED_N16ROT' THEN 1 WHEN 'ALIKED_N32' THEN 2 ELSE -1 END AS code,
               type IN ('SIFT', 'ALIKED_N16ROT', 'ALIKED_N32') AS is_native FROM (SELECT vec_id, {_TYPE} AS type FROM embeddings)"""
)
def native_extractor_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(_TYPE).alias("type"))
    return P.native_code(typed, "type").select("vec_id", "type", "code", "is_native")


_NN = """scored AS (
          SELECT x.vec_id AS a, y.vec_id AS b,
                 round(list_inner_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS s
          FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id
        ), nn AS (
          SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM scored) WHERE k = 1
        )"""


def _nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return graph.nearest(e, e, "label", "vec_id", "embedding")


@query(f"WITH {_NN} SELECT a, b, round(s, 6) + 0.0 AS score FROM nn")
def nn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default matcher: top-1 within the extractor type."""
    return _nn(spark, sf_dir).select("a", "b", rounded(F.col("score")).alias("score"))


@query(f"WITH {_NN} SELECT x.a, x.b, round(x.s, 6) + 0.0 AS score FROM nn x JOIN nn y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_nn_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mutual(_nn(spark, sf_dir)).select("a", "b", rounded(F.col("score")).alias("score"))


_RANKED = "SELECT o_custkey, o_orderkey AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders"


def _order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer a pair, its orders the matches, by coordinates."""
    none = F.lit(None).cast("long")
    at = lambda x: F.lit(x).cast("float")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("image_a"), F.lit("map").alias("image_b"), F.col("o_orderkey").alias("m"), F.lit("coordinates").alias("mode"), none.alias("idx_a"), none.alias("idx_b"),
        at(1.0).alias("xa"), at(2.0).alias("ya"), at(3.0).alias("xb"), at(4.0).alias("yb"), F.col("o_totalprice").cast("float").alias("score"),
    )


def _every_second(t: pa.Table) -> pa.Table:
    """Keeps every second match of a pair, in the order of m."""
    return t.sort_by("m").take(pa.array(range(1, t.num_rows, 2), pa.int64()))


def _every_second_but(t: pa.Table) -> pa.Table:
    """As above, but a pair whose first image's number divides by 5 gets its matches twice."""
    return pa.concat_tables([t, t]) if int(t.column("image_a")[0].as_py()) % 5 == 0 else _every_second(t)


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS image_a, m FROM ({_RANKED}) WHERE k % 2 = 0")
def verify_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verifier that keeps every second match."""
    return procedures.verify(_order_matches(spark, sf_dir), _every_second).select("image_a", "m")


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS image_a, rule_id, rule_id <> 'KIT.verifier_never_grows' OR o_custkey % 5 <> 0 AS holds
       FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest(['KIT.mode', 'KIT.index_range', 'KIT.verifier_mode', 'KIT.verifier_never_grows']) AS rule_id)"""
)
def verify_never_grows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on a verifier that returns more than it got for every fifth customer."""
    matches = _order_matches(spark, sf_dir)
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("image_id"))
    report = procedures.matcher_report(matches, points, procedures.MatcherTraits(detector_free=True), procedures.verify(matches, _every_second_but))
    return report.select("image_a", "rule_id", "holds")
