"""From raw documents to packed training sequences.

quality: documents that the classifier rejects go. near_dedup: one document of each group of near copies stays.
pii: personal data is redacted. mixing: documents are dropped or repeated so that sources meet their
weights. packing: what is left is packed into sequences.

Cases: null texts count as empty where they are scored, are never near copies, and are packed as their end id alone if the mix takes them (it
does not: their size is 0); repeated rows are copies, of which one stays; an empty table gives an empty result; further columns are carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlab.llm import minhash, mixing, packing, private
from marketlab.llm import quality as quality_model
from marketlab.llm._spark import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs, F.array("source"), mixing.word_count(F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
            scratch.retain(docs)
    return docs


ORACLE_SQL = None
