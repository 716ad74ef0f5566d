"""The corpus pipeline: from all documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all
but the last return the columns of documents. SQL can't express trained models or
components, so ORACLE_SQL is None and tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import langid, mixing, packing, quality, simhash
from gleaner.llm.common import materialise, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names; those without letters (null and empty texts too) or any likeness to one go.

    Repeated rows and rows of a null id are each decided; an empty table gives an empty one.
    """
    return langid.keep(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as the labels' good ones do; without labels all stay.

    Null and empty texts are scored by statistics of zero; repeated rows and rows of a null
    id are each decided; an empty table gives an empty one.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group.

    Null and empty texts are near duplicates of each other; of repeated rows one stays; a
    group without any id keeps one row; an empty table gives an empty one.
    """
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, dealt into shuffled shards.

    A null source is one more source; null and empty texts have no words and come with
    their block; rows of one id are taken alike; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, each draw of a document on its own.

    Null and empty texts are an end mark alone; repeated and null ids are packed each; an
    empty table gives no rows.
    """
    return packing.pack_documents(docs).withColumn("piece", F.col("piece").cast("int"))


STAGES = [("language ID", known_language), ("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("mixing sources", mixed), ("best-fit packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else materialise(docs, "stage"), sf_dir)
    return docs
