"""The corpus pipeline: toxicity, language identification, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. run() writes every stage's result as Parquet in the shared checkpoint folder and reads it for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caloris.llm import exact, langid, minhash, packing, toxicity
from caloris.llm.common import checkpoint_dir, crc_of_id, read
from caloris.llm.queries import TOKENIZER
from caloris.session import delete

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below 0.7. A null text counts as empty and scores as the bias alone; rows that
    repeat a text stay or go together; without labels of both kinds nothing or everything goes; no document, no result."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    return toxicity.clean_rows(docs, model).select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: null texts and texts without a letter go, and all if no language is labelled."""
    return langid.known_rows(docs, langid.train(docs, crc_of_id() % 5 != 0)).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; null counts as empty. Rows with null ids stay, and of rows that repeat
    an id and a text all stay if one does."""
    return exact.survivors(docs, keep="max").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each class of near copies. Rows with null ids stay, and rows that repeat an
    id stay or go together."""
    return minhash.survivors(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens, with their token ids. A null text is its end token alone, a null source a queue of
    its own name ''; repeated rows are packed each; no document, no piece."""
    return packing.pack(docs, TOKENIZER, capacity=2048, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Models, similarity classes and a tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:  # what the next stage has read is not needed any more; the result's own folder stays
            delete(spark, f"{folder}/{last}")
        last = name
    return docs
