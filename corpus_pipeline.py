"""From raw documents to packed sequences, in four stages.

``STAGES`` lists ``(name, function)``; each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``. All stages but the last return the
columns they were given.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from huntspark.llm import jaccard_join, kneser_ney, mixing, packing, queries
from huntspark.llm.common import cut_lineage, shared_dir


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is listed; rows with a NULL id stay.

    The ids are written first, so that Spark knows how few they are.
    """
    return docs.join(cut_lineage(ids.filter("doc_id IS NOT NULL").distinct()), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity exceeds their language's limit."""
    judged = kneser_ney.judged(docs, queries.trusted_ids(spark, sf_dir))
    return without(docs, judged.filter("NOT keep").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group of near copies; texts without words have no copies.

    Rows that share an id and a text are one document. Rows that share an id
    and differ in text go or stay together: the id stays if it heads any group.
    """
    groups = cut_lineage(jaccard_join.near_groups(docs))
    heads = groups.filter("doc_id = component_id").select("doc_id")
    dropped = groups.select("doc_id").distinct().join(heads.distinct(), "doc_id", "left_anti")
    kept = without(docs, dropped)
    repeated = cut_lineage(groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document may appear several times, or cut, or not."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of binary length with a checksum of their ids."""
    pieces = packing.packed(docs, queries.vocabulary("word_bpe_49k.json"), special=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: Perplexity, the sparse product and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
