"""Behaviour evaluation: expectations on resolution and tool gating, checked and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.resolve import guard, resolve
from termweave.sources.vocabulary import Vocabulary


def _check(actual, expected):
    """Null where nothing is expected."""
    return F.when(expected.isNotNull(), actual.eqNullSafe(expected))


def run_evaluation(queries: DataFrame, v: Vocabulary, include_deprecated: bool = True) -> tuple[DataFrame, DataFrame]:
    """Checks of each query, and of each expected tool call. queries: as read by sources.behaviour."""
    asked = queries.withColumn("requested", F.when(F.size("scopes") > 0, F.col("scopes")))
    got = resolve(asked, v, F.col("requested"), include_deprecated, id_col="id").withColumnRenamed("text_id", "id").select("id", "status", "action", "term_ids", "primary_term_id")
    q = queries.join(got, "id")
    same_ids = F.array_sort(F.array_distinct("term_ids")) == F.array_sort(F.array_distinct("expected_term_ids"))
    results = q.select(
        "id", "status", "action", "term_ids", "expected_status", _check(F.col("status"), F.col("expected_status")).alias("status_ok"), _check(F.col("action"), F.col("expected_action")).alias("action_ok"),
        F.when(F.size("expected_term_ids") > 0, same_ids).alias("term_ids_ok"), _check(F.col("primary_term_id"), F.col("expected_primary_term_id")).alias("primary_ok"),
    )
    calls = asked.select("id", "text", "requested", F.posexplode("tool_calls").alias("call_ord", "call")).select("*", F.concat_ws("#", "id", "call_ord").alias("call_id"), "call.*")
    judged = guard(calls, v, F.col("requested"), include_deprecated, id_col="call_id").withColumnRenamed("text_id", "call_id").drop("tool_name")
    tools = calls.join(judged, "call_id").select("id", "call_ord", "tool_name", "status", "action", "is_allowed", "expected_allowed", _check(F.col("status"), F.col("expected_status")).alias("status_ok"), _check(F.col("action"), F.col("expected_action")).alias("action_ok"), _check(F.col("is_allowed"), F.col("expected_allowed")).alias("allowed_ok"))
    return results, tools


def metrics(results: DataFrame, tools: DataFrame) -> DataFrame:
    """One row for each metric: passed, total and their ratio (null where nothing was checked)."""
    ok = lambda df, name, cond, total: df.agg(F.count_if(cond).alias("passed"), F.count_if(total).alias("total")).select(F.lit(name).alias("metric"), "passed", "total")
    by = lambda df, name, c: ok(df, name, F.col(c), F.col(c).isNotNull())
    r = [by(results, "resolution_status", "status_ok"), by(results, "resolution_action", "action_ok"), by(results, "canonicalization", "term_ids_ok")]
    amb = F.coalesce(F.col("expected_status") == "ambiguous", F.lit(False))
    r.append(ok(results, "ambiguity_detection", amb & (F.col("status") == "ambiguous"), amb))
    r += [by(tools, "tool_status", "status_ok"), by(tools, "tool_action", "action_ok"), by(tools, "tool_allowed", "allowed_ok")]
    wrong = F.coalesce(~F.col("expected_allowed"), F.lit(False))
    r.append(ok(tools, "wrong_tool_prevention", wrong & ~F.col("is_allowed"), wrong))
    flags = results.select(F.explode(F.array("status_ok", "action_ok", "term_ids_ok", "primary_ok")).alias("ok")).unionByName(tools.select(F.explode(F.array("status_ok", "action_ok", "allowed_ok")).alias("ok")))
    r.append(by(flags, "overall", "ok"))
    out = r[0]
    for x in r[1:]:
        out = out.unionByName(x)
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("passed") / F.col("total")))
