"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, html_extract, langid, licenses, mixing, mtree, packing, quality, simhash
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.withColumn("piece", F.col("piece").cast("int"))


@query
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources takes of every document."""
    return mixing.report(table(spark, sf_dir, "documents"))


ORACLES["op5_mix"] = mixing.ORACLE


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in every document."""
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


ORACLES["op6_licenses"] = licenses.oracle()


@query
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


@query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings found for each twentieth."""
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of each hundredth embedding with all others."""
    return mtree.search(table(spark, sf_dir, "embeddings"))


ORACLES["op4_topk"] = mtree.oracle()


@query
def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference records of every conversation that has a reply: as it went, against a stale last reply, and against a stale first one."""
    pairs = chat.stale_replies(chat.conversations(table(spark, sf_dir, "conversations")))
    return chat.digest(chat.preferences(pairs, keys=("pair_id", "reply")))


ORACLES["op9_preferences"] = chat.oracle()
