"""Content-addressed blobs, source fingerprints and resumable checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sha(df: DataFrame, content: str = "content") -> DataFrame:
    """Add sha (SHA-256, hex) and size of a binary or string column."""
    raw = F.col(content).cast("binary")
    return df.withColumn("sha", F.sha2(raw, 256)).withColumn("size", F.octet_length(raw).cast("long"))


def new_blobs(df: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """Of df's blobs those the store lacks, each once: sha, size, content."""
    lacking = with_sha(df, content).select("sha", "size", content).join(store.select("sha"), "sha", "left_anti")
    return lacking.dropDuplicates(["sha"])  # only what the store lacks moves with its bytes


def exists(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store.select("sha"), "sha", "left_semi")


def missing(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store.select("sha"), "sha", "left_anti")


def open_blobs(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """The stored rows (sha, content, ...) of the wanted addresses, each once; unknown addresses give none."""
    return store.join(wanted.select("sha").distinct(), "sha", "left_semi")


def local_path(root: Column, sha: Column) -> Column:
    """Where a store in a folder keeps a blob; null for what is no address."""
    return F.when(sha.rlike("^[0-9a-f]{64}$") & (F.length(sha) == 64), F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.substring(sha, 1, 2), F.lit("/"), sha))


def delete(store: DataFrame, doomed: DataFrame) -> DataFrame:
    """The store without the doomed blobs."""
    return store.join(doomed.select("sha"), "sha", "left_anti")


def chunks(df: DataFrame, content: str, size: int, *keys: str) -> DataFrame:
    """Each blob in pieces of at most `size` bytes: keys, chunk, data. Empty blobs have none."""
    raw = F.col(content).cast("binary")
    n = F.ceil(F.octet_length(raw) / size).cast("int")
    numbered = df.where(F.octet_length(raw) > 0).select(*keys, raw.alias("_raw"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return numbered.select(*keys, "chunk", F.substring("_raw", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def fingerprint(df: DataFrame, *fields: str) -> Column:
    """Aggregate: order-independent digest of the rows' fields.

    Digests of rows are summed as numbers of 32 bits, in eight lanes, so that the
    aggregate merges on the map side and needs no list of all rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields)), 256)
    lanes = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("long")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *lanes), 256)


def checkpoint_name(seq: Column) -> Column:
    """File name of a checkpoint: the number with at least eight digits."""
    text = seq.cast("string")
    return F.concat(F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text), F.lit(".pcmapin"))


def checkpoint_root(job_dir: Column) -> Column:
    return F.concat(F.regexp_replace(job_dir, "/+$", ""), F.lit("/checkpoints"))


def list_checkpoints(files: DataFrame, summaries: DataFrame, job: str = "job") -> DataFrame:
    """Checkpoints of payload files (job, path) with their summaries (job, seq, summary); `{}` where missing or no JSON.

    Files whose stem is no integer are skipped. Order them by name, as `latest` does.
    """
    stem = F.regexp_extract("path", r"([^/]*)\.pcmapin$", 1)
    found = files.withColumn("name", F.concat(stem, F.lit(".pcmapin"))).withColumn("seq", F.expr("try_cast(regexp_extract(path, '([^/]*)\\\\.pcmapin$', 1) AS BIGINT)")).where("seq IS NOT NULL")
    checked = summaries.select(job, "seq", F.when(F.expr("try_parse_json(summary) IS NOT NULL"), F.col("summary")).alias("summary"))
    return found.join(checked, [job, "seq"], "left").withColumn("summary", F.coalesce("summary", F.lit("{}")))


def duplicate_sequences(existing: DataFrame, new: DataFrame, job: str = "job") -> DataFrame:
    """Of the new checkpoints those whose number the job already has."""
    return new.join(existing.select(job, "seq").distinct(), [job, "seq"], "left_semi")


def append_checkpoints(existing: DataFrame, new: DataFrame, job: str = "job") -> DataFrame:
    """The new checkpoints with the path they are written to; reading fails at a number the job already has, or has twice among the new."""
    name = F.concat(checkpoint_root(F.concat(F.lit("/"), F.col(job).cast("string"))), F.lit("/"), checkpoint_name(F.col("seq")))
    taken = existing.select(job, "seq").unionByName(new.select(job, "seq")).groupBy(job, "seq").agg(F.count("*").alias("_n"))
    fault = F.concat(F.lit("CKPT.duplicate_seq: "), F.col(job).cast("string"), F.lit(" "), F.col("seq").cast("string"))
    fresh = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))
    return new.join(taken, [job, "seq"]).where(fresh).drop("_n").withColumn("path", name)


def latest(checkpoints: DataFrame, job: str = "job") -> DataFrame:
    """Per job the last checkpoint by file name."""
    best = checkpoints.groupBy(job).agg(F.max(F.struct(checkpoint_name(F.col("seq")).alias("name"), "seq")).alias("m"))
    return best.select(job, "m.seq", "m.name")


def collectable(checkpoints: DataFrame, keep_last: int = 5, job: str = "job") -> DataFrame:
    """Checkpoints beyond the last `keep_last` of each job; keep_last = 0 drops none."""
    if keep_last <= 0:
        return checkpoints.limit(0)
    w = Window.partitionBy(job).orderBy(checkpoint_name(F.col("seq")).desc())
    return checkpoints.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") > keep_last).drop("_rank")
