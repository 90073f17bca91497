"""Line dedup over levelled sorted runs of line hashes.

Documents go through in batches of falling doc_id. A batch's keys (128-bit hashes of lines, with the number of documents
and the largest doc_id holding each) are merge-anti-joined with all runs: a key that no run holds is new and is added with
its largest doc_id, which no later batch can raise; a key that some run holds is added as a further count only. So each key
stands with a doc_id in one run. When a level has `fanout` runs they are compacted into one of the next level; a last
compaction merges all levels. Runs are tables in the shared folder, bucketed and sorted by key, so that the joins of later
batches don't shuffle them again.

Defined results: null or empty text is one empty line; repeated rows of a doc_id count as one document, and all of them
keep a line whose largest doc_id is theirs; a row without doc_id keeps all its lines and doesn't count; a key repeated within a document counts once and either keeps or
loses all its lines there; a very long text is as many rows as it has long lines, and only its own lines are put together
again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, persist, with_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: A key held by this share of all lines or more is heavy: at most 1 / share keys are, so that they can be broadcast.
HEAVY = 1 / 4000
#: So many keys (of 16 bytes, with a doc_id) are broadcast, after counting them; beyond that the join shuffles.
BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased, no other letter changed."""
    key = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(key) == F.octet_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


class LineRuns:
    """Levelled sorted runs of (line, n_docs, max_doc): max_doc is null where an older run holds the key."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        """The names of all runs, oldest first."""
        return [r for level in reversed(self.levels) for r in level]

    def table(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = fresh_path(self.spark, "line-run")
        rows.write.format("parquet").bucketBy(self.buckets, "line").sortBy("line").option("path", self.paths[name]).saveAsTable(name)
        return name

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, self.paths.pop(name))

    def add(self, lines: DataFrame) -> None:
        """lines: (line, doc_id) of this batch; all rows of a doc_id are in one batch, after those of larger doc_ids."""
        own = lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        for run in self.runs():
            held = self.table(run).where(F.col("max_doc").isNotNull()).select("line", F.lit(True).alias("held"))
            own = own.join(held.hint("merge"), "line", "left").select("line", "n_docs", F.when(F.col("held").isNull(), F.col("max_doc")).alias("max_doc"))
        self._put(0, self._write(own))

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._compact(runs))

    def _compact(self, runs: list[str]) -> str:
        merged = self._write(self._merged(runs))
        self.drop(*runs)
        return merged

    def _merged(self, runs: list[str]) -> DataFrame:
        # one scan of all files: a union of bucketed scans may be taken for bucketed itself when it no longer is
        every = self.spark.read.schema("line binary, n_docs long, max_doc long").parquet(*[self.paths[r] for r in runs])
        return every.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def finish(self) -> DataFrame:
        """Merge all levels: line, n_docs, max_doc of every key found in at least min_docs documents. The runs go."""
        runs = self.runs()
        often = persist(self._merged(runs).where(F.col("n_docs") >= self.min_docs), "often")
        self.drop(*runs)
        self.levels = []
        return often


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos, line (16 bytes): every line of a text whose key is long enough, by its key's hash."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    each = split.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = each.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.unhex(F.md5("key")).alias("line"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 5, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """doc_id, text, kept_text, n_lines, n_dropped for every row, and the columns named in extra as a struct f0, f1, ...
    (so that no name can clash)."""
    spark, texts = docs.sparkSession, with_text(docs, id_col, text_col)
    bounds = sorted(set(texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)), reverse=True)
    batch = sum((F.when(F.col("doc_id") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    hashed = persist(hashed_lines(texts.where(F.col("doc_id").isNotNull()), min_chars).withColumn("batch", batch), "lines")
    runs = LineRuns(spark, min_docs)
    for k in range(len(bounds) + 1):
        runs.add(hashed.where(F.col("batch") == k).select("line", "doc_id"))
    often = runs.finish()

    lines = hashed.select("doc_id", "text_hash", "pos", "line")
    if often.count() <= BROADCAST_LINES:
        hit = lines.join(F.broadcast(often.select("line", "max_doc")), "line")
    else:
        many = F.lit(max(hashed.count() * HEAVY, 1000))
        heavy = F.broadcast(often.where(F.col("n_docs") >= many).select("line", "max_doc"))
        light = often.where(F.col("n_docs") < many).select("line", "max_doc")
        hit = lines.join(heavy, "line").unionByName(lines.join(heavy.select("line"), "line", "left_anti").join(light, "line"))
    dropped = hit.where(F.col("doc_id") != F.col("max_doc")).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))

    carried = [F.col(c).alias(f"_extra{k}") for k, c in enumerate(extra or [])]
    left = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried)
    left = left.withColumn("text_hash", F.xxhash64("text"))
    both = left.join(dropped, ["doc_id", "text_hash"], "left").withColumn("lines", F.split("text", "\n", -1))
    index = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(index, lambda i: F.get(F.col("lines"), i)), "\n"))
    return both.select("doc_id", "text", kept.alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), *([F.struct(*[F.col(f"_extra{k}").alias(f"f{k}") for k in range(len(extra))]).alias("extra")] if extra else []))
