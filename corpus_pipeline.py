"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.llm import exact_dedup as exact
from cantora.llm import langid, mixing, packing
from cantora.llm.queries import tokenizer_path
from cantora.llm.shared import shared_dir, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a known language: a null text, or one without a letter, goes. Columns stay as they are.

    Learns from rows with an id and a language that are not held out. Where nothing can be learnt, a text with a letter
    stays. Repeated rows share a fate; an empty table stays empty.
    """
    small_batches(spark)
    seen = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = langid.train(seen.filter(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()))
    return docs.filter(langid.letters() if model is None else langid.predicted(model, spark) != langid.UNKNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the one with the largest doc_id (null ids are smallest; of rows equal in both one).

    A null text counts as empty, so one row of all null and empty texts stays; columns stay as they are, whatever their
    names; very long texts are digested whole; an empty table stays empty.
    """
    return exact.dedup_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (null ids first), then the least hash of its text; of rows equal in both one.

    Null, empty and white texts are in no group and stay; columns stay as they are; an empty table stays empty.
    """
    from cantora.llm import minhash

    return minhash.dedup_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out until each source has its share of words, dealt by output shard and shuffled inside each; no row is cut.

    Texts without words are never taken, a null source is a source like any other, repeated rows are rows like any other;
    columns stay as they are; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document that the mix holds several times is packed as often; a null text would be one end token; other columns go;
    an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Signatures, random splits and tokens have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
