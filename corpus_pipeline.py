"""The training-corpus pipeline: language ID, line dedup, near-duplicate removal, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs; all
but the last return the columns of documents. The cases of nulls, empty and repeated rows are those of the operators; a
document without a letter goes in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinegrid.llm import jaccard, language, lines, packing, pii
from kinegrid.llm.common import load, materialise, unused

#: A document of whose n-grams its best language has a smaller share is in none of the learned languages.
LEAST_SHARE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """With n_chars, if there, of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labels know go."""
    best, share = unused(docs, "lang_pred"), unused(docs, "score")
    found = language.predict(docs, language.train(docs), keep=True, names=(best, share))
    return found.where((F.col(best) != "und") & (F.col(share) >= LEAST_SHARE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two lines or more go, and documents of which nothing else is left."""
    total, removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    found = lines.dedup(docs, counts=(total, removed))
    return _measured(found.where((F.col(removed) < F.col(total)) | (F.col(total) == 0)).select(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, of rows that repeat an id those with other texts
    that are no near copies; rows without an id stay."""
    return jaccard.representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _measured(pii.masked(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses none of: learned language filters, content-defined chunks, EM over labelers, tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
