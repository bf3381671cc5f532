"""A training corpus in five stages: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm import quality
from pagespan.llm.common import drop, shared_folder, table, tied
from pagespan.llm.decontamination import contaminated
from pagespan.llm.jaccard_join import similar_documents
from pagespan.llm.line_dedup import EVERY, without_lines
from pagespan.llm.packing import pack_documents


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows outside the held-out fold."""
    model = quality.fit(table(spark, sf_dir, "documents"), quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.accepted(docs, model)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, or nearly so, are cut from the texts."""
    return without_lines(docs, **EVERY)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Rows that share an id, or have none, are told apart by their texts and go by a hash of both; of rows with one id and one
    text the least by all columns stays. Documents without words are near nothing and stay, but for such repeats.
    """
    rows = tied(docs)
    rows = rows.withColumn("_key", F.when(F.col("_tie") == 0, F.col("_id")).otherwise(F.xxhash64("_id", "_tie"))).select(*docs.columns, "_key", "_tie")
    again = rows.where("_tie <> 0").groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*", "_key")
    rows = rows.where("_tie = 0").drop("_tie").unionByName(again)
    later = similar_documents(rows.select(F.col("_key").alias("doc_id"), "text")).where("doc_id <> component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(later, "_key", "left_anti").select(*docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go; rows are told apart by id and text."""
    rows = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    leaks = contaminated(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(leaks, "_key", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of fixed length."""
    return pack_documents(docs)


STAGES = [("quality", good_documents), ("lines", distinct_lines), ("near_duplicates", distinct_documents), ("decontamination", clean_documents), ("packing", packed)]

#: Edit variants, similarity links and token ids are beyond SQL; the stages' operators are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            drop(spark, last)  # the next stage is there
        last = f"{folder}/{name}"
    return docs
