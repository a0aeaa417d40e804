"""The corpus pipeline: language ID, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns
of documents; the last returns the tokens. Its result has no SQL equivalent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm import decontamination, language_id, neardup, sentencepiece_bpe
from posegrid.llm.common import Workspace, release, unused

#: Calibrated score below which a document has no recognised language.
MIN_SCORE = 0.35

ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language stays unsure.

    Every row is judged by its own text; null ids and repeated rows are kept like others,
    and an empty table stays empty. No column of docs is changed, whatever its name.
    """
    model = language_id.train(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))  # nothing to learn languages from
    lang, score = unused("lang_pred", docs), unused("score", docs)
    found = language_id.identify(docs, model, lang=lang, score=score)
    return found.where((F.col(lang) != language_id.UND) & (F.col(score) >= MIN_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, and repeated rows once.

    Texts without words are in no group; of a group without any id one row stays;
    where an id stands for several texts, each is judged by its own group.
    """
    return neardup.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose own text contains a benchmark item; with an empty benchmark all stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text and the text that they give back; null texts count as empty."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_bpe.encode(docs.select("doc_id", "text"), model, decoded="decoded").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("SentencePiece encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written and reread, and what it was read from deleted."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        docs = work.save(made, f"stage{k}")
        release(made)
    return docs
