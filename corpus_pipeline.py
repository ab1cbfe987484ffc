"""Five operators over `documents`, one after the other: from raw documents to packed training sequences.

Each stage takes what its predecessor kept. Stages but the last return the columns of `documents`, n_chars of the
text as it then is.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import lines, neardup, packing, quality, secrets
from textwarden.llm.shared import ship, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
END_ID = 2


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go.

    Null and empty texts go, as having too few words; a null language is a language. Repeated rows are judged each, and alike. Of equal
    perplexities all stay or go. An empty table stays empty; other columns don't matter. Texts of any length are read whole.
    """
    ship(spark)
    return quality.keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources show go; documents stay.

    A null text stays null, and a null source counts for no line. Repeated rows stay repeated. Lines with equally many sources are
    treated alike. An empty table stays empty; columns named n_lines or n_removed don't matter. Texts of any length are split whole.
    """
    ship(spark)
    return _measured(lines.remove_boilerplate(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id, null last, then of the least digest of its text.

    Documents without words are like no other and stay; of repeated rows one stays. An empty table stays empty; other columns don't
    matter. Texts of any length are compared whole.
    """
    ship(spark)
    return neardup.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; documents stay.

    A null text has none and stays null. Repeated rows are masked each, and alike; overlapping secrets become one mask. An empty table
    stays empty; a column named secrets doesn't matter. Texts of any length are scanned whole.
    """
    ship(spark)
    return _measured(secrets.mask(secrets.scan(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences.

    A null or empty text is the end id alone. Repeated rows are packed once each; pieces of one length go in the order they are read. An
    empty table gives no pieces; other columns don't matter. Texts of any length are encoded whole.
    """
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]
#: The perplexity bands, the samples and the tokens have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
