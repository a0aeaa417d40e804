"""Blobs, fingerprints, checkpoints and the points codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, storage
from ..sources import points
from ..session import table
from .base import query, rounded


@query("SELECT sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS size, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def blob_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return storage.with_sha(docs, "text").groupBy("sha", "size").agg(F.count("*").alias("copies"))


@query("SELECT DISTINCT sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def blob_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store with the even documents has to add for all of them."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    store = storage.with_sha(docs.where("doc_id % 2 = 0"), "text").select("sha").distinct()
    return storage.new_blobs(docs.select(F.col("text").alias("content")), store).select("sha", "size")


@query(
    """SELECT doc_id, 'SHA.format' AS rule_id FROM documents WHERE doc_id % 4 <> 0 AND (doc_id % 4 <> 1 OR true)"""
)
def sha_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only every fourth digest is left as it is; others are upper-cased, cut or end in a line end."""
    i = F.col("doc_id")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    made = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 1, F.concat(F.lit("A"), F.substring(sha, 2, 63))).when(i % 4 == 2, F.substring(sha, 1, 63)).when(i % 4 == 3, F.concat(F.substring(sha, 1, 63), F.lit("\n"))).otherwise(sha).alias("sha"))
    return rules.violations(made, rules.sha_rules(), "doc_id").select("doc_id", "rule_id")


@query("SELECT sha256(text) AS sha, count(*) AS wanted FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def blob_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.with_sha(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text").select("doc_id", "sha")
    return storage.missing(docs.select("sha"), docs.where("doc_id % 3 = 0").select("sha").distinct()).groupBy("sha").agg(F.count("*").alias("wanted"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, '/store/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents WHERE text IS NOT NULL GROUP BY text HAVING min(doc_id) % 3 = 0")
def blob_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third blob of a store, found by its address, and where a folder would hold it."""
    docs = storage.with_sha(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text")
    store = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    wanted = store.where("doc_id % 3 = 0").select("sha").unionByName(store.limit(0).select("sha"))
    return storage.open_blobs(wanted, store).select("sha", "doc_id", storage.local_path(F.lit("/store/"), F.col("sha")).alias("path"))


@query("SELECT sha256(text) AS sha, count(*) AS kept FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def blob_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = storage.with_sha(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text").select("doc_id", "sha")
    return storage.delete(store, store.where("doc_id % 5 = 0")).groupBy("sha").agg(F.count("*").alias("kept"))


@query(
    """SELECT doc_id, CAST(k AS INTEGER) AS chunk, lower(hex(raw[k * 1000 + 1:least((k + 1) * 1000, n)])) AS data
       FROM (SELECT doc_id, n, raw, unnest(range(0, (n + 999) // 1000)) AS k FROM (SELECT doc_id, encode(text) AS raw, strlen(text) AS n FROM documents WHERE doc_id % 1 = 0 AND strlen(text) > 0))"""
)
def blob_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = storage.chunks(table(spark, sf_dir, "documents"), "text", 1000, "doc_id")
    return pieces.select("doc_id", "chunk", F.lower(F.hex("data")).alias("data"))


@query(
    """WITH row AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(page_id AS VARCHAR), chr(0)), coalesce(url, chr(0)), coalesce(html, chr(0)))) AS h FROM pages)
       SELECT sha256(concat_ws(',', CAST(count(*) AS VARCHAR), """
    + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))
    + """)) AS fingerprint FROM row"""
)
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.agg(storage.fingerprint(pages, "page_id", "url", "html").alias("fingerprint"))


_SEQ = "SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, props FROM events"
_NAME = "lpad(CAST(seq AS VARCHAR), CAST(greatest(8, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') || '.pcmapin'"


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), seq.alias("seq"), "event_type", "props")


@query(f"SELECT job, seq, {_NAME} AS name, CASE WHEN event_type = 'error' OR seq % 3 = 0 THEN '{{}}' ELSE props END AS summary FROM ({_SEQ}) WHERE seq % 11 <> 0")
def checkpoint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload files with their summaries; some files have other names, some summaries are missing or no JSON."""
    c = _checkpoints(spark, sf_dir)
    name = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("tmp-"), storage.checkpoint_name(F.col("seq")))).otherwise(storage.checkpoint_name(F.col("seq")))
    files = c.select("job", F.concat(storage.checkpoint_root(F.concat(F.lit("/jobs/"), F.col("job").cast("string"))), F.lit("/"), name).alias("path"))
    summaries = c.where("event_type <> 'error'").select("job", "seq", F.when(F.col("seq") % 3 == 0, "{broken").otherwise(F.col("props")).alias("summary"))
    return storage.list_checkpoints(files, summaries).select("job", "seq", "name", "summary")


@query(f"SELECT job, seq + 1000000 AS seq, '/' || CAST(job AS VARCHAR) || '/checkpoints/' || lpad(CAST(seq + 1000000 AS VARCHAR), 8, '0') || '.pcmapin' AS path FROM ({_SEQ}) WHERE seq % 4 = 0")
def checkpoint_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New checkpoints with the paths they go to; none of them has a number the job already has."""
    c = _checkpoints(spark, sf_dir).select("job", "seq")
    return storage.append_checkpoints(c, c.where("seq % 4 = 0").select("job", (F.col("seq") + 1_000_000).alias("seq"))).select("job", "seq", "path")


@query(f"SELECT job, max(seq) AS seq, lpad(CAST(max(seq) AS VARCHAR), 8, '0') || '.pcmapin' AS name FROM ({_SEQ}) GROUP BY job")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.latest(_checkpoints(spark, sf_dir).select("job", "seq"))


@query(f"SELECT job, seq FROM (SELECT job, seq, row_number() OVER (PARTITION BY job ORDER BY {_NAME} DESC) AS k FROM ({_SEQ})) WHERE k > 5")
def checkpoint_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.collectable(_checkpoints(spark, sf_dir).select("job", "seq"), 5)


@query(f"SELECT job, seq, 'CKPT.duplicate_seq' AS rule_id FROM ({_SEQ}) WHERE seq % 4 = 0")
def checkpoint_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checkpoints(spark, sf_dir).select("job", "seq")
    new = c.where("seq % 4 = 0").unionByName(c.select("job", (F.col("seq") + 1_000_000).alias("seq")))
    return storage.duplicate_sequences(c, new).select("job", "seq", F.lit("CKPT.duplicate_seq").alias("rule_id"))


def _cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points; ids beyond 2^63, colours beyond 255, and track lengths beyond 2^16 among them."""
    p = F.col("p_partkey")
    big = p.cast("decimal(20,0)") + F.when(p % 5 == 0, F.lit("9223372036854775808").cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("blob"), big.cast("decimal(20,0)").alias("point3d_id"), (F.col("p_retailprice") / 8).cast("float").alias("x"), (p * 0.25).cast("float").alias("y"), (F.col("p_size") * -0.5).cast("float").alias("z"),
        (p % 300).cast("short").alias("r"), (p % 256).cast("short").alias("g"), F.col("p_size").cast("short").alias("b"), (p * 40).cast("int").alias("track_len"),
    )


_POINT = """SELECT p_brand AS blob, CAST(p_partkey AS DECIMAL(20,0)) + CASE WHEN p_partkey % 5 = 0 THEN 9223372036854775808 ELSE 0 END AS id, CAST(p_retailprice / 8 AS FLOAT) AS x,
    CAST(p_partkey * 0.25 AS FLOAT) AS y, CAST(p_size * -0.5 AS FLOAT) AS z, p_partkey % 300 % 256 AS r, p_partkey % 256 AS g, p_size AS b, p_partkey * 40 % 65536 AS track_len FROM part"""


@query(
    f"""SELECT blob, row_number() OVER (PARTITION BY blob ORDER BY id) - 1 AS pos, CAST(id AS DECIMAL(20,0)) AS point3d_id, round(CAST(x AS DOUBLE), 6) + 0.0 AS x, round(CAST(y AS DOUBLE), 6) + 0.0 AS y, round(CAST(z AS DOUBLE), 6) + 0.0 AS z,
        CAST(r AS SMALLINT) AS r, CAST(g AS SMALLINT) AS g, CAST(b AS SMALLINT) AS b, CAST(track_len AS INTEGER) AS track_len FROM ({_POINT})"""
)
def points_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded per brand and decoded again; integers come back wrapped."""
    blobs = points.encode(_cloud(spark, sf_dir), "blob", "point3d_id")
    number = lambda c: rounded(F.col(c).cast("double")).alias(c)
    return points.decode(blobs, "content", "blob").select("blob", "pos", "point3d_id", number("x"), number("y"), number("z"), "r", "g", "b", "track_len")


@query(f"SELECT blob, count(*) AS n, {', '.join(f'round(CAST({f}({c}) AS DOUBLE), 6) + 0.0 AS {f}_{c}' for f in ('min', 'max') for c in 'xyz')} FROM ({_POINT}) GROUP BY blob")
def points_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = [rounded(f(c).cast("double")).alias(f"{name}_{c}") for f, name in ((F.min, "min"), (F.max, "max")) for c in "xyz"]
    return _cloud(spark, sf_dir).groupBy("blob").agg(F.count("*").alias("n"), *box)


@query(f"SELECT blob, 44 + 26 * count(*) AS bytes, CAST(44 AS BIGINT) AS first_record, 44 + 26 * (count(*) - 1) AS last_record FROM ({_POINT}) GROUP BY blob")
def points_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _cloud(spark, sf_dir).groupBy("blob").agg(points.blob_size(F.count("*")).alias("bytes"))
    return sized.select("blob", "bytes", F.lit(points.HEADER_SIZE).cast("long").alias("first_record"), (F.col("bytes") - points.RECORD_SIZE).alias("last_record"))


@query(f"SELECT CAST(id AS DECIMAL(20,0)) AS key, CAST(r AS BIGINT) AS r, CAST(track_len AS BIGINT) AS track_len, CAST(id AS DECIMAL(20,0)) AS wrapped FROM ({_POINT})")
def points_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers as the record's unsigned fields keep them."""
    cloud = _cloud(spark, sf_dir)
    over = F.col("point3d_id").cast("decimal(38,0)") + F.lit("18446744073709551616").cast("decimal(38,0)") * (F.col("g") - 100)
    return cloud.select(F.col("point3d_id").alias("key"), points.wrap_unsigned(F.col("r"), 8).alias("r"), points.wrap_unsigned(F.col("track_len"), 16).alias("track_len"), points.wrap_unsigned(over, 64).alias("wrapped"))


@query()
def points_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = points.encode(_cloud(spark, sf_dir), "blob", "point3d_id")
    return blobs.select("blob", F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("bytes"))
