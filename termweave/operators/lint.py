"""Findings about a vocabulary's surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.functions.normalize import with_normalized
from termweave.sources.vocabulary import Vocabulary, alias_scopes


def surface_records(v: Vocabulary) -> DataFrame:
    """term_id, surface, kind, scopes, case_sensitive, deprecated (of alias or term), has_tools."""
    tools = v.terms.select("term_id", (F.size("tools") > 0).alias("has_tools"))
    canon = v.terms.select("term_id", F.col("canonical").alias("surface"), F.lit("canonical").alias("kind"), "scopes", F.lit(False).alias("case_sensitive"), "deprecated")
    alias = alias_scopes(v).select("term_id", "surface", F.lit("alias").alias("kind"), F.col("scopes_used").alias("scopes"), "case_sensitive", (F.col("deprecated") | F.col("term_deprecated")).alias("deprecated"))
    return canon.unionByName(alias).join(tools, "term_id")


def surface_findings(v: Vocabulary) -> DataFrame:
    """code, term_id, surface, kind: broad, short and risky surfaces."""
    r = surface_records(v).withColumns({"broad": T.broad_surface("surface"), "short": T.short_surface("surface")})
    bad = F.col("broad") | F.col("short")
    codes = [(F.col("short"), "short_surface"), (F.col("broad"), "broad_surface"), (F.col("deprecated") & bad, "deprecated_broad_surface"), (F.col("has_tools") & bad, "tool_broad_surface")]
    return r.select(F.explode(F.filter(F.array(*[F.when(c, n) for c, n in codes]), lambda x: x.isNotNull())).alias("code"), "term_id", "surface", "kind")


def surface_collisions(v: Vocabulary) -> DataFrame:
    """term_ids, surfaces, scopes, case_sensitive, search_surfaces: what the matcher cannot tell apart."""
    r = surface_records(v)
    own = F.when(F.col("case_sensitive"), F.array("surface")).otherwise(F.concat(F.array("surface"), T.code_variants("surface")))
    each = with_normalized(r.select("*", F.explode(F.array_distinct(own)).alias("variant")), "variant")
    each = each.withColumn("search", F.when(F.col("case_sensitive"), F.col("norm")).otherwise(F.lower("norm")))
    owners = each.groupBy("search", "scopes", "case_sensitive").agg(F.array_sort(F.collect_set("term_id")).alias("term_ids"), F.array_sort(F.collect_set("surface")).alias("surfaces")).where(F.size("term_ids") > 1)
    return owners.groupBy("term_ids", "surfaces", "scopes", "case_sensitive").agg(F.array_sort(F.collect_set("search")).alias("search_surfaces"))


def lint(v: Vocabulary, has_version: bool = True) -> DataFrame:
    """All findings: code, term_id, surface, detail."""
    a = surface_findings(v).select("code", "term_id", "surface", F.col("kind").alias("detail"))
    b = surface_collisions(v).select(F.lit("normalized_surface_collision").alias("code"), F.array_join("term_ids", ",").alias("term_id"), F.array_join("surfaces", ",").alias("surface"), F.array_join("search_surfaces", ",").alias("detail"))
    out = a.unionByName(b)
    if not has_version:
        out = out.unionByName(v.spark.createDataFrame([("missing_version", None, None, "the document has no version")], "code string, term_id string, surface string, detail string"))
    return out
