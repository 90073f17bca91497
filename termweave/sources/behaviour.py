"""Behaviour queries as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALL = "struct<tool_name:string,expected_status:string,expected_action:string,expected_allowed:boolean>"
SCHEMA = f"id string, text string, scopes array<string>, expected_status string, expected_action string, expected_term_ids array<string>, expected_primary_term_id string, tool_calls array<{CALL}>"
STATUSES, ACTIONS = ("unknown", "resolved", "ambiguous"), ("no_match", "use_terms", "ask_clarification")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Queries with missing lists as empty ones."""
    raw = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    empty = {c: F.coalesce(c, F.array().cast(t)) for c, t in (("scopes", "array<string>"), ("expected_term_ids", "array<string>"), ("tool_calls", f"array<{CALL}>"))}
    return raw.withColumns(empty)


def query_problems(queries: DataFrame) -> DataFrame:
    """id, problem: repeated ids, empty fields and unknown values."""
    twice = queries.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    checks = [(F.coalesce(F.trim("id"), F.lit("")) == "", "empty id"), (F.coalesce(F.trim("text"), F.lit("")) == "", "empty text"), (~F.col("expected_status").isin(*STATUSES), "unknown status"), (~F.col("expected_action").isin(*ACTIONS), "unknown action"), (F.exists("tool_calls", lambda c: F.coalesce(F.trim(c["tool_name"]), F.lit("")) == ""), "empty tool name")]
    each = queries.select("id", F.explode(F.filter(F.array(*[F.when(c, m) for c, m in checks]), lambda x: x.isNotNull())).alias("problem"))
    return twice.unionByName(each)
