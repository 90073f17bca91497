"""The workspace: Parquet tables with keyed upsert, an append-only event log, exports."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.operators.review import latest_decisions

KEYS = {"documents": ["path"], "candidates": ["key"], "packs": ["key"], "snapshots": ["snapshot_id"]}
EVENTS = "event_id string, seq long, key string, decision string, note string, reviewer string, created_at timestamp, snapshot string"


class Workspace:
    """Tables under one folder. A table's current version is the last one that was written whole.

    A new version is written beside the old one and becomes current with Spark's _SUCCESS file, so that readers never
    see half a table and a failed write changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{table}")
        if not fs.exists(p):
            return []
        found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())
        return [v for v in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS"))]

    def read(self, table: str) -> DataFrame | None:
        v = self.versions(table)
        return self.spark.read.parquet(v[-1]) if v else None

    def replace(self, table: str, df: DataFrame) -> None:
        n = len(self.versions(table))
        df.write.parquet(f"{self.root}/{table}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows replace those of equal key; of repeated keys in rows one stays."""
        keys = KEYS[table]
        new, old = rows.dropDuplicates(keys), self.read(table)
        self.replace(table, new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))

    def append_event(self, key: str, decision: str, note: str = "", reviewer: str = "", snapshot: str | None = None) -> str:
        """Each event is a folder of its own, so that many writers never wait for or overwrite each other."""
        import time

        event = uuid.uuid4().hex
        row = self.spark.createDataFrame([(event, time.time_ns(), key, decision, note, reviewer, snapshot)], "event_id string, seq long, key string, decision string, note string, reviewer string, snapshot string")
        row.withColumn("created_at", F.date_trunc("second", F.current_timestamp())).coalesce(1).write.parquet(f"{self.root}/review_events/{event}")
        return event

    def events(self, decision: str | None = None, most: int | None = None) -> DataFrame:
        fs, p = self._fs(f"{self.root}/review_events")
        df = self.spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(p.toString()) if fs.exists(p) else self.spark.createDataFrame([], EVENTS)
        df = df if decision is None else df.where(F.col("decision") == decision)
        return df.orderBy("created_at", "seq") if most is None else df.orderBy("created_at", "seq").limit(most)

    def decisions(self) -> DataFrame:
        return latest_decisions(self.events())

    def export_events(self, path: str, decision: str | None = None) -> None:
        """JSON lines with keys in alphabetical order."""
        e = self.events(decision)
        e.select(F.to_json(F.struct(*sorted(e.columns))).alias("value")).write.mode("overwrite").text(path)

    def summary(self) -> dict[str, int]:
        out = {t: (df.count() if (df := self.read(t)) is not None else 0) for t in KEYS}
        return out | {"review_events": self.events().count()}


def write_text_atomically(path: str, text: str) -> None:
    """A small file on the driver: written beside its place, flushed, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, draft = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, target)
    except BaseException:
        Path(draft).unlink(missing_ok=True)
        raise
