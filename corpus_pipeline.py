"""From raw documents to packed batches: quality rules, language, near-duplicates, packing.

Each stage reads what its predecessor kept. The first three return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofgrid.llm import langid, packing, quality, sigtree
from proofgrid.plans.storage import stored
from proofgrid.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes. Ids play no part: rows with a null id and rows that repeat are judged
    one by one. All columns of ``docs`` come back, whatever their names; an empty table stays empty.
    """
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go.

    A text without a word in a known language goes, a null or empty one too. Rows are judged by id and text, so rows that
    repeat stay or go together, and a null id is an id like others. Without any declared language no language is known
    and all rows go.
    """
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; documents without an id or words stay.

    Of rows that repeat an id and its text one stays.
    """
    copies = sigtree.near_duplicates(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    copies = stored(copies, "copies")  # its size is then known: few ids are broadcast, and no text is shuffled
    kept = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    ids = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    repeated = stored(ids, "repeated-ids")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in length buckets and batches.

    A null or empty text is one piece of one token; rows with a null id and rows that repeat are packed one by one;
    an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

# Optimal buckets and likelihood models have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
