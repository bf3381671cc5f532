"""What the operators of this subpackage share: session settings, chunk counts, durable cuts and safe document views."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside keyed stages; such rows come before all others.
NO_ID = -(1 << 63)


def prepare(spark: SparkSession, batch: int = 16 << 20) -> None:
    """Arrow batches of about `batch` bytes at most, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: null ids stand as NO_ID, null texts are empty. Other columns are not read."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


_SLOTS = 1 << 20


def tied(docs: DataFrame) -> DataFrame:
    """docs with _id (null as NO_ID) and _tie: 0, but for ids that several rows share a hash of the text. So _id and _tie
    name a document: rows that share an id and a text are one, rows that share an id alone are ordered by that hash.

    Whether an id is shared is asked of a table of at most _SLOTS hashes of such ids, which is broadcast; a unique id that
    falls in one of them gets a hash for its tie too, which changes nothing.
    """
    rows = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    slot = F.pmod(F.xxhash64("_id"), F.lit(_SLOTS))
    shared = rows.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select(slot.alias("_slot"), F.lit(True).alias("_hit")).distinct()
    both = rows.withColumn("_slot", slot).join(F.broadcast(shared), "_slot", "left")
    return both.select(*docs.columns, "_id", F.when(F.col("_hit"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0)).cast("long").alias("_tie"))


def keyed(docs: DataFrame) -> DataFrame:
    """documents() with a column tie before text, as of tied()."""
    return tied(documents(docs)).select(F.col("_id").alias("doc_id"), F.col("_tie").alias("tie"), "text")


def public_id(c: str = "doc_id") -> Column:
    """NO_ID back to null."""
    return F.when(F.col(c) != NO_ID, F.col(c)).alias(c)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of its own, but only if driver and executors are
    one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pagespan-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for loops: its plan is a scan, and its size is known. drop() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
