"""The corpus pipeline. Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.

All stages but the last return the columns of docs. Rows are told apart by doc_id: if one of the rows with a doc_id is rejected, all are.
Rows without doc_id are never rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, passages, quality_rules, simhash, toxicity
from tessera.llm.queries import RANKS
from tessera.llm.shared import read_table, small, written


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in rejected.doc_id. The texts are shuffled only if there are too many of them to broadcast."""
    ids, _ = written(rejected.select(F.col("doc_id").alias("_rejected_id")).where("_rejected_id is not null").distinct(), "rejected")
    return docs.join(small(ids), docs["doc_id"].cast("bigint") == ids["_rejected_id"], "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules reject go."""
    return _without(docs, quality_rules.judged_documents(docs).where(~F.col("kept")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents predicted toxic go. Learns from the labelled ones among docs."""
    return _without(docs, toxicity.score_documents(docs, read_table(spark, sf_dir, "labels")).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near-duplicates the document with the least doc_id stays, once."""
    found, _ = written(simhash.near_duplicates(docs), "near-duplicates")
    kept = _without(docs, found.where("doc_id <> component_id"))
    repeated, _ = written(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_repeated_id")), "repeated")
    if repeated.isEmpty():
        return kept
    again = docs["doc_id"].cast("bigint") == repeated["_repeated_id"]
    once = kept.join(small(repeated), again, "left_semi").dropDuplicates(["doc_id"])
    return kept.join(small(repeated), again, "left_anti").unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that an earlier document has are cut from the text; n_chars follows."""
    return passages.without_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of the packed sequences."""
    return packing.pack(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: no SQL: the toxicity model and the passages' signatures have none
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
