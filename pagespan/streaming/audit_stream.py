"""The audit over a file-backed queue, and run liveness from a stream of heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.operators import audit


def stream_responses(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Responses as they arrive as Parquet files; files_per_trigger bounds what one batch claims."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def audit_stream(responses: DataFrame, out: str, checkpoint: str):
    """Parses all there is and ends; started again, it goes on after the last batch. Returns the query."""
    pages = audit.audit_pages(responses)
    return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heartbeat_counts(beats: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Beats of each run by event-time window; later ones than the watermark are left out. beats: run_id, ts."""
    return beats.withWatermark("ts", late).groupBy("run_id", F.window("ts", window)).agg(F.count("*").alias("beats"), F.max("ts").alias("last_beat"))


class HeartbeatMonitor:
    """Counts failures in a row: the run is lost at `threshold`; a success starts again."""

    def __init__(self, threshold: int) -> None:
        self.threshold, self.failures = threshold, 0

    def beat(self, ok: bool) -> bool:
        """Whether the run is still alive."""
        self.failures = 0 if ok else self.failures + 1
        return self.failures < self.threshold
