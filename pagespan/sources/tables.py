"""Table-backed sources: the queue, arrays, responses and robots.txt bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def active_queue(queue: DataFrame) -> DataFrame:
    """id and url of the active rows; the filter reaches the scan."""
    return queue.filter("is_active").select("id", "url")


def queue_page(queue: DataFrame, after: int, limit: int) -> DataFrame:
    """The next rows by key. One scan is better; this is for callers that page."""
    return active_queue(queue).filter(F.col("id") > after).orderBy("id").limit(limit)


def from_arrays(spark: SparkSession, ids: list[int], urls: list[str]) -> DataFrame:
    """target_id, request_url of two arrays of one length."""
    one = spark.range(1).select(F.lit(ids).cast("array<bigint>").alias("a"), F.lit(urls).cast("array<string>").alias("b"))
    return one.select(F.inline(F.arrays_zip("a", "b"))).toDF("target_id", "request_url")


def within_limit(body: str, most: int):
    """Whether a body is short enough to be read whole."""
    return F.octet_length(body) <= most


def seeds(spark: SparkSession, urls: list[str]) -> DataFrame:
    return from_arrays(spark, list(range(1, len(urls) + 1)), urls).select(F.col("target_id").alias("id"), F.col("request_url").alias("url"), F.lit(True).alias("is_active"))
