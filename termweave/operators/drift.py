"""Naming drift in added source lines: names that are known, may be aliases, or are new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators.match import match_all, match_longest, surface_dimension
from termweave.operators.nearmiss import suggest
from termweave.operators.resolve import small
from termweave.operators.tables import written
from termweave.sources.vocabulary import Vocabulary


def _places(lines: DataFrame) -> DataFrame:
    """Equal lines of a place are one; rows lie by place, so that what is counted by place isn't shuffled again."""
    return lines.select("path", "line_number", "text").where("text IS NOT NULL").repartition("path", "line_number").distinct()


def known_occurrences(lines: DataFrame, v: Vocabulary, requested: Column | None = None, include_deprecated: bool = True) -> DataFrame:
    """path, line_number, term_id, canonical, surface, matched_text, deprecated: longest matches, equal ones of a line once.

    Each distinct text is matched once, whatever the number of lines that hold it.
    """
    asked = [] if requested is None else ["requested"]
    each = _places(lines) if requested is None else _places(lines).withColumn("requested", requested)
    texts = (lines.select("text") if requested is None else each.select("text", "requested")).distinct().where("text IS NOT NULL").withColumn("text_id", F.struct("text", *asked))
    m = match_longest(match_all(texts, surface_dimension(v, include_deprecated), F.col("requested") if asked else None, include_deprecated))
    terms = v.terms.select("term_id", "canonical", F.col("deprecated").alias("term_deprecated"))
    hits = m.join(small(terms), "term_id").select("text_id", "term_id", "canonical", "matched_text", "start", "surface", (F.col("deprecated") | F.col("term_deprecated")).alias("deprecated"))
    by_text = hits.groupBy("text_id", "term_id", "canonical", "matched_text").agg(F.min(F.struct("start", "surface", "deprecated")).alias("x"))
    by_text = written(by_text.groupBy("text_id").agg(F.collect_list(F.struct("term_id", "canonical", "matched_text", "x")).alias("hits")), "drift-known")
    j = each.withColumn("text_id", F.struct("text", *asked)).join(small(by_text), "text_id").select("path", "line_number", F.inline("hits"))
    first = j.groupBy("path", "line_number", "term_id", "canonical", "matched_text").agg(F.min("x").alias("x"))
    return first.select("path", "line_number", "term_id", "canonical", "x.surface", "matched_text", "x.deprecated")


def unknown_identifiers(lines: DataFrame, v: Vocabulary, requested: Column | None = None, include_deprecated: bool = True, most: int = 3, min_confidence: float = 0.42) -> DataFrame:
    """path, line_number, name, text, review_kind, suggestions: names that no surface covers whole.

    Texts are searched, and names matched and scored, once each, whatever the number of lines that hold them.
    """
    named = lines.select("text").distinct().select("text", F.explode(T.unknown_identifiers("text", 25)).alias("name")).where(T.merge_surface("name"))
    names = named.select("name").distinct().withColumn("text_id", F.col("name")).withColumn("text", F.col("name"))
    full = match_longest(match_all(names, surface_dimension(v, include_deprecated), requested, include_deprecated)).where((F.col("start") == 0) & (F.col("end") == F.length("text_id")))
    free = names.join(full.select("text_id"), "text_id", "left_anti").select("name")
    asked = free if requested is None else free.withColumn("requested", requested)
    s = suggest(asked, v, include_deprecated, most, min_confidence).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "term_id", "canonical", "known", "confidence"))).alias("suggestions"))
    j = named.join(free, "name").join(s, "name", "left")
    quiet = T.low_signal("name") | T.call_like("name", "text")
    kind = F.when(F.col("suggestions").isNotNull(), "likely_alias").when(quiet, "unresolved_identifier").otherwise("likely_new_term")
    found = j.select("text", F.struct("name", kind.alias("review_kind"), "suggestions").alias("one"))
    by_text = written(found.groupBy("text").agg(F.collect_list("one").alias("names")), "drift-unknown")
    return _places(lines).join(small(by_text), "text").select("path", "line_number", "text", F.inline("names")).select("path", "line_number", "name", "text", "review_kind", "suggestions")


def summary(lines: DataFrame, known: DataFrame, unknown: DataFrame, show_unresolved: bool = False) -> DataFrame:
    """One row of counts."""
    a = lines.agg(F.count_distinct("path").alias("file_count"), F.count("*").alias("added_line_count"))
    b = known.agg(F.count("*").alias("known_count"))
    by = lambda k: F.count_if(F.col("review_kind") == k)
    hidden = F.lit(0).cast("long") if show_unresolved else by("unresolved_identifier")
    c = unknown.agg(by("likely_alias").alias("likely_alias_count"), by("likely_new_term").alias("likely_new_term_count"), (by("unresolved_identifier") - hidden).alias("unresolved_count"), hidden.alias("hidden_count"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))  # one row each
