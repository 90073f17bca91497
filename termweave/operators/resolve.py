"""Texts resolved to terms, and tool calls gated by what a text resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.constants import BROADCAST_ROWS
from termweave.functions.normalize import unicode_metadata
from termweave.operators.match import match_all, selected, surface_dimension
from termweave.sources.vocabulary import Vocabulary


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count shows that the table is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def candidates(matches: DataFrame, v: Vocabulary) -> DataFrame:
    """One row for each text and term: matched surfaces, scopes, counts and the score (length plus 10 for each canonical)."""
    n_ev = v.evidence.where("owner_kind = 'term'").groupBy(F.col("owner_id").alias("term_id")).agg(F.count("*").cast("int").alias("evidence_count"))
    terms = v.terms.select("term_id", "canonical", "description", F.col("scopes").alias("term_scopes"), "tags", "tools", F.col("deprecated").alias("term_deprecated")).join(n_ev, "term_id", "left")
    kept = selected(matches, same_span=True).select("text_id", F.posexplode("ms").alias("ord", "m")).select("text_id", "ord", "m.*")
    seen = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("x")))), lambda s: s["x"])
    by_term = kept.groupBy("text_id", "term_id").agg(
        F.array_distinct(seen("matched_text")).alias("matched_surfaces"), F.array_distinct(F.flatten(seen("scopes"))).alias("scopes"), F.count("*").cast("int").alias("match_count"),
        (F.sum(F.col("end") - F.col("start")) + 10 * F.count_if(F.col("kind") == "canonical")).cast("double").alias("score"), F.bool_or("deprecated").alias("any_deprecated"),
    )
    j = by_term.join(small(terms), "term_id")
    return j.select(
        "text_id", "term_id", "canonical", "description", F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.col("term_scopes")).alias("scopes"), "tags", "tools", "matched_surfaces",
        "match_count", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), (F.col("term_deprecated") | F.col("any_deprecated")).alias("deprecated"), "score",
    )


def _gathered(found: DataFrame) -> DataFrame:
    """text_id and an array of its candidates, by score, then id."""
    one = F.struct((-F.col("score")).alias("neg"), "term_id", "canonical", "description", "scopes", "tags", "tools", "matched_surfaces", "match_count", "evidence_count", "deprecated", "score")
    return found.groupBy("text_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def _tools(cands: str) -> Column:
    return F.coalesce(F.array_distinct(F.flatten(F.transform(cands, lambda c: c["tools"]))), F.array().cast("array<string>"))


def _decided(every: DataFrame, *more: str) -> DataFrame:
    """What candidates (null: none) say about each row, and more columns of the row."""
    n = F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates"))
    status = F.when(n == 0, "unknown").when(n == 1, "resolved").otherwise("ambiguous")
    out = every.withColumn("n_terms", n).withColumn("status", status)
    action = F.when(F.col("status") == "unknown", "no_match").when(F.col("status") == "resolved", "use_terms").otherwise("ask_clarification")
    message = F.when(F.col("n_terms") == 0, "No known terminology surfaces were found.").when(F.col("n_terms") == 1, F.concat(F.lit("Resolved to "), F.col("candidates")[0]["term_id"], F.lit("."))).otherwise(F.concat(F.lit("Found "), F.col("n_terms"), F.lit(" possible canonical terms.")))
    ids = F.coalesce(F.transform("candidates", lambda c: c["term_id"]), F.array().cast("array<string>"))
    return out.select("text_id", "status", action.alias("action"), "n_terms", ids.alias("term_ids"), F.when(F.col("n_terms") == 1, F.col("candidates")[0]["term_id"]).alias("primary_term_id"), _tools("candidates").alias("allowed_tools"), "candidates", message.alias("message"), *more)


def resolve(texts: DataFrame, v: Vocabulary, requested: Column | None = None, include_deprecated: bool = True, id_col: str = "text_id", text_col: str = "text", surfaces: DataFrame | None = None) -> DataFrame:
    """text_id, status, action, candidates (by score, then id), primary_term_id, allowed_tools, message for every text."""
    dim = surfaces if surfaces is not None else surface_dimension(v)
    found = candidates(match_all(texts, dim, requested, include_deprecated, id_col, text_col), v)
    return _decided(texts.select(F.col(id_col).alias("text_id")).join(_gathered(found), "text_id", "left"))


def guard(calls: DataFrame, v: Vocabulary, requested: Column | None = None, include_deprecated: bool = True, block_on_bidi: bool = True, id_col: str = "text_id", text_col: str = "text", tool_col: str = "tool_name") -> DataFrame:
    """Whether each tool call may go on: text_id, tool_name, status, action, is_allowed, allowed_tools, term_ids.

    Each row is one call with its text; equal texts are matched once. Calls that share a text_id are resolved by all
    their texts together, and each comes back once for every one of them; if they resolve to one term, a call may also
    use the tools of the one term that its own text resolves to, whose match another's longer one may have crowded out.
    """
    wanted = requested if requested is not None else F.lit(None).cast("array<string>")
    rows = calls.select(F.col(id_col).alias("text_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), wanted.alias("requested"), F.col(tool_col).alias("tool_name")).where("text_id IS NOT NULL")
    key = F.struct("text", "requested")
    once = rows.select("text", "requested").distinct().select(key.alias("text_id"), "text", "requested")
    matches = match_all(once, surface_dimension(v), F.col("requested"), include_deprecated)
    mine = unicode_metadata(once.select("text_id", "text")).select("text_id", "has_bidi").join(_gathered(candidates(matches, v)), "text_id", "left")
    mine = mine.select(F.col("text_id").alias("_key"), "has_bidi", F.col("candidates").alias("own"))
    # ids of several calls: their texts' matches together
    several = rows.groupBy("text_id").agg(F.count("*").cast("int").alias("_n")).where("_n > 1")
    again = rows.join(several, "text_id", "left_semi").select("text_id", key.alias("_key")).distinct()
    joint = _gathered(candidates(again.join(matches.withColumnRenamed("text_id", "_key"), "_key").drop("_key"), v)).withColumnRenamed("candidates", "joint")
    j = rows.withColumn("_key", key).join(mine, "_key", "left").join(several, "text_id", "left").join(joint, "text_id", "left")
    j = j.withColumn("candidates", F.coalesce("joint", "own")).withColumn("_times", F.coalesce("_n", F.lit(1)))
    decided = _decided(j, "tool_name", "has_bidi", "own", "_times")
    added = F.when((F.col("n_terms") == 1) & (F.size("own") == 1), _tools("own")).otherwise(F.array().cast("array<string>"))
    decided = decided.withColumn("allowed_tools", F.array_union("allowed_tools", added)).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    free, listed = F.size("allowed_tools") == 0, F.array_contains("allowed_tools", F.col("tool_name"))
    hidden = F.col("has_bidi") & F.lit(block_on_bidi)
    status = F.when(hidden, "blocked").when(F.col("status") == "unknown", "no_match").when(F.col("status") == "ambiguous", "needs_clarification").when(free | listed, "allowed").otherwise("blocked")
    out = decided.select("text_id", "tool_name", status.alias("status"), F.when(hidden, F.array().cast("array<string>")).otherwise(F.col("allowed_tools")).alias("allowed_tools"), F.when(hidden, F.array().cast("array<string>")).otherwise(F.col("term_ids")).alias("term_ids"), hidden.alias("unicode_blocked"))
    action = F.when(F.col("status") == "blocked", "block").when(F.col("status") == "needs_clarification", "ask_clarification").otherwise("proceed")
    return out.withColumns({"action": action, "is_allowed": F.col("status").isin("allowed", "no_match")})
