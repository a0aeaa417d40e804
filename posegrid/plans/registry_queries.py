"""Registries and the database schema as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry, schemas
from ..operators import rules
from ..session import table
from .base import query


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_FORMATS = _values([f[:2] for f in registry.FORMATS])
_TYPES = _values(registry.DATA_TYPES)
_COLUMNS = _values([(t, o, c, k, te, ce) for _, t, o, c, k, te, ce in schemas.column_rows()])


@query(f"SELECT kind, count(*) AS n, string_agg(id, ' ' ORDER BY id) AS ids FROM ({_FORMATS}) AS f(id, kind) GROUP BY kind")
def formats_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.formats(spark).groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("format_id")), " ").alias("ids"))


@query(
    f"""WITH f(id, kind) AS ({_FORMATS}), wanted AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'sfmapi.matches.dense.v1' WHEN 'view' THEN 'sfmapi.features.local.v1' ELSE event_type END AS format_id FROM events)
        SELECT event_id, format_id, kind, kind IS NOT NULL AS is_core FROM wanted LEFT JOIN f ON id = format_id"""
)
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    wanted = table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "sfmapi.matches.dense.v1").when(kind == "view", "sfmapi.features.local.v1").otherwise(kind).alias("format_id"))
    return registry.lookup_format(wanted, "format_id").select("event_id", "format_id", "kind", "is_core")


@query(f"SELECT t.id AS type_id, t.kind, count(f.id) AS formats FROM ({_TYPES}) AS t(id, title, kind, about) LEFT JOIN ({_FORMATS}) AS f(id, kind) ON f.kind = t.id GROUP BY ALL")
def io_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many formats serve each data type; every artifact needs one."""
    served = registry.formats(spark).groupBy(F.col("kind").alias("type_id")).agg(F.count("*").alias("formats"))
    return registry.data_types(spark).select("type_id", "kind").join(served, "type_id", "left").withColumn("formats", F.coalesce("formats", F.lit(0)).cast("long"))


@query(f"SELECT * FROM ({_TYPES}) AS t(type_id, title, kind, description)")
def data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.data_types(spark).drop("ord")


@query(f"SELECT * FROM ({_COLUMNS}) AS c(table_name, ord, column_name, sql_type, table_extension, column_extension)")
def db_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.db_columns(spark).drop("table_ord")


@query(
    f"""WITH c(t, ord, c, k, te, ce) AS ({_COLUMNS})
        SELECT 'upstream_tables' AS part, count(DISTINCT t) AS n, string_agg(DISTINCT t, ' ' ORDER BY t) AS names FROM c WHERE NOT te
        UNION ALL SELECT 'extension_tables', count(DISTINCT t), string_agg(DISTINCT t, ' ' ORDER BY t) FROM c WHERE te
        UNION ALL SELECT 'extension_columns', count(*), string_agg(t || '.' || c, ' ' ORDER BY t || '.' || c) FROM c WHERE ce AND NOT te"""
)
def extension_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream and extension parts of the schema; every table is in exactly one."""
    c = schemas.db_columns(spark)
    part = F.when(F.col("table_extension"), "extension_tables").otherwise("upstream_tables")
    named = c.select(part.alias("part"), F.col("table_name").alias("name")).unionByName(
        c.where("column_extension AND NOT table_extension").select(F.lit("extension_columns").alias("part"), F.concat_ws(".", "table_name", "column_name").alias("name"))
    )
    return named.distinct().groupBy("part").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), " ").alias("names"))


@query(f"SELECT * FROM ({_values([(n, k, len(p.split()), p) for k, (n, p) in enumerate(registry.CAMERA_MODELS)])}) AS m(model, model_id, num_params, params)")
def camera_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.camera_models(spark).select("model", "model_id", "num_params", F.array_join("param_names", " ").alias("params"))


@query("SELECT o_orderpriority AS id, 'FMT.unique' AS rule_id FROM orders GROUP BY 1 HAVING count(*) > 1")
def format_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniqueness rule over priorities as registry ids."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("id"))
    return rules.group_violations(made, [rules.unique_rule()], "id").select("id", "rule_id")


@query()
def contract_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both contracts as JSON text."""
    rows = [(schemas.CONTRACT_NAME, schemas.contract_json()), (registry.DATA_TYPES_CONTRACT, registry.data_types_json())]
    return spark.createDataFrame(rows, "contract string, json string")
