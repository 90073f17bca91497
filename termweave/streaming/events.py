"""The review event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.review import latest_decisions
from termweave.sources.store import EVENTS


def read_events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Events of a workspace folder as they come; those written twice within the time count once."""
    raw = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(path)
    return raw.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])


def decisions_by_window(events: DataFrame, window: str = "1 day") -> DataFrame:
    """Number of decisions in each time window, once the watermark has passed it."""
    return events.groupBy(F.window("created_at", window), "decision").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "decision", "n")


def keep_latest(events: DataFrame, target: str, checkpoint: str):
    """Write the latest decision of each surface after every batch; returns the running query.

    The state is the table itself: a batch is merged with what its last version holds, and written beside it under the
    batch's number, so that a repeated batch gives the same files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "decision", "note", "reviewer", "created_at", "seq")
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{target}/batch={number - 1}").select(rows.columns))
        out = latest_decisions(rows).join(rows.groupBy("key").agg(F.max("seq").alias("seq")), "key")
        out.select("key", "decision", "note", "reviewer", F.col("updated_at").alias("created_at"), "seq").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
