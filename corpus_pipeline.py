"""A corpus pipeline of training-data operators: language ID, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Null and empty texts, repeated rows, null and repeated ids, further columns and empty tables are served by every stage as
its docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import language_id, mixing, near_copies, secret_scan, sentencepiece_bpe
from trajecta.llm.common import discard_written, shared_folder, written_so_far

ENOUGH = 100  # letters


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null or no letter, or ENOUGH letters and yet no more like any learned language than chance is.

    Shorter texts with letters stay: they are too short to tell. Of repeated rows all stay or go.
    """
    names, prototypes = language_id.fit(docs.select("doc_id", "text", "lang"))
    spare = {c: f"~{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}  # columns that the operator would replace step aside
    judged = language_id.identify(docs.withColumnsRenamed(spare), names, prototypes, keep_text=True)
    short = F.regexp_count("text", F.lit("\\p{L}")) < ENOUGH
    stays = judged.where((F.col("lang_pred") != language_id.UND) & ((F.col("score") > language_id.chance(len(names))) | short))
    return stays.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in spare.items()}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of exact and near copies (five words, 0.8): that with the smallest id, null last, of equal ids the one whose text has the smaller digest."""
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets by a mask; every document stays."""
    return secret_scan.redact_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: rows repeat, or go. Rows that agree in all columns are interchangeable."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, and the digests of the ids and of what they decode to; every row stays, null texts as empty ones."""
    proto = sentencepiece_bpe.read_model(spark, sentencepiece_bpe.default_model_path())
    return sentencepiece_bpe.encode_pieces(docs.select("doc_id", "lang", "source", "text"), proto)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("SentencePiece", encode),
]
#: No stage but the third could be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = written_so_far()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        discard_written(spark, before)  # what the stage itself had stored
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
