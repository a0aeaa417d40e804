"""The corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, edit_counts, html_extract, language_id, license_scan, media_avi, neardup, sentencepiece_bpe, sharding, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    model = _tokenizer("piece_bpe_32k.model")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.encode(docs, model, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_pages(_read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned without the held-out quarter."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where("NOT held_out"))
    return language_id.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op6_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an AVI file, and what reading it back gives."""
    stored = media_avi.encode_avi(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return media_avi.features(stored)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains four fifths of a benchmark item's 5-word shingles, with the item."""
    return decontamination.containments(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = sharding.shard(_read(spark, sf_dir, "documents"), 16, "bytes")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def made_edits(docs: DataFrame) -> DataFrame:
    """Three edits per document, in places that follow from its id: an insertion, a replacement, a deletion."""
    size = F.length(F.coalesce("text", F.lit("")))
    spot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size + 1).cast("int")
    edit = lambda k, n, new: F.struct(spot(k).alias("start"), (spot(k) + n).alias("stop"), F.lit(new).alias("replacement"))
    return docs.withColumn("edits", F.array(edit(1, 0, " inserted words"), edit(2, 9, "it's 42"), edit(3, 25, "")))


def op9_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    import public_tokenizers

    docs = made_edits(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = edit_counts.count_edited(docs, _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_before", "n_after", "n_pretokens", "n_reencoded", F.sha2(F.col("edited"), 256).alias("edited_sha256"))


def op10_setsketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of 0.85."""
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": op2_license_scan,
    "op3_html_extract": op3_html_extract,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_media_avi": op6_media_avi,
    "op7_decontamination": op7_decontamination,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_edit_counts": op9_edit_counts,
    "op10_setsketch_neardup": op10_setsketch_neardup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op7_decontamination": r"""
        WITH texts AS (
          SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
        ), split AS (
          SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
          FROM texts
        ), shingled AS (
          SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
          FROM split
        ), sizes AS (
          SELECT id, count(*) AS n FROM shingled WHERE kind = 'i' GROUP BY id
        ), common AS (
          SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c
          FROM shingled d JOIN shingled i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY d.id, i.id
        )
        SELECT doc_id, item_id, n AS n_item, c AS n_shared, c / n AS containment
        FROM common JOIN sizes ON sizes.id = item_id WHERE 100 * c >= 80 * n
    """,
    "op5_url_filter": """
        WITH parts AS (
          SELECT page_id,
                 coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest
          FROM pages
        ), split AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
          FROM parts
        ), ruled AS (
          SELECT *, CASE
            WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
            WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
            WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
            WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
            WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
          END AS rule, CASE
            WHEN host LIKE '%ads-track.%' THEN '*ads-track.**'
            WHEN host LIKE '%cheap-pills.%' THEN '*cheap-pills.**'
            WHEN host LIKE '%free-bets.%' THEN '*free-bets.**'
            WHEN host LIKE '%casino%' THEN '*casino**'
            WHEN path LIKE '/%/adserver/%' THEN '*/*/adserver/*'
            WHEN path LIKE '%/banner/%.gif' THEN '**/banner/*.gif'
          END AS hit
          FROM split
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               CASE WHEN rule IS NULL THEN hit END AS pattern
        FROM ruled
    """,
}
