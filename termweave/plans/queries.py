"""Queries of the terminology operators for the driver; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.functions.normalize import unicode_metadata
from termweave.operators import drift, evaluate, evidence, lint, match, nearmiss, resolve, review, safety, scout, versions
from termweave.operators.tables import written
from termweave.plans import fixtures as X
from termweave.sources import vocabulary as V

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _csv(c) -> F.Column:
    return F.array_join(c, ",")


@query
def resolve_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every order text resolved against the catalog vocabulary."""
    r = resolve.resolve(X.order_lines(spark, sf_dir), X.catalog(spark, sf_dir))
    return r.select("text_id", "status", "action", "n_terms", F.array_join(F.array_sort("term_ids"), ",").alias("term_ids"), "primary_term_id")


@query
def resolve_scoped(spark, sf_dir):
    t = X.order_lines(spark, sf_dir).withColumn("requested", F.array("adj"))
    r = resolve.resolve(t, X.catalog(spark, sf_dir), F.col("requested"))
    return r.select("text_id", "status", "action", "n_terms", "primary_term_id")


@query
def resolve_candidates(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    c = resolve.candidates(match.match_all(X.order_lines(spark, sf_dir), match.surface_dimension(v)), v)
    return c.select("text_id", "term_id", "match_count", "score", _csv("matched_surfaces").alias("matched"), _csv("scopes").alias("scopes"), "deprecated")


def _matches(m):
    return m.select("text_id", "term_id", "surface", "matched_text", "start", "end", "kind")


@query
def match_all(spark, sf_dir):
    return _matches(match.match_all(X.order_lines(spark, sf_dir), match.surface_dimension(X.catalog(spark, sf_dir))))


@query
def match_scoped(spark, sf_dir):
    m = match.match_all(X.order_lines(spark, sf_dir), match.surface_dimension(X.catalog(spark, sf_dir)), F.array(F.lit("blue"), F.lit("red")))
    return _matches(m)


@query
def match_active_only(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    return _matches(match.match_all(X.order_lines(spark, sf_dir), match.surface_dimension(v, include_deprecated=False), include_deprecated=False))


@query
def match_longest(spark, sf_dir):
    m = match.match_all(X.order_lines(spark, sf_dir), match.surface_dimension(X.catalog(spark, sf_dir)))
    return _matches(match.match_longest(m))


@query
def surface_dimension(spark, sf_dir):
    return match.surface_dimension(X.catalog(spark, sf_dir)).select("term_id", "surface", "kind", _csv("scopes").alias("scopes"), "deprecated", "search_surface")


def _idents(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("HTTPServers"), F.col("p_size").cast("string")).alias("ident"))


@query
def surface_fragments(spark, sf_dir):
    return _idents(spark, sf_dir).select("p_partkey", F.array_join(T.fragments("ident"), " ").alias("fragments"), T.normalized_fragments("ident").alias("normalized"), T.cluster_key("ident").alias("cluster_key"), T.surface_shape("ident").alias("shape"), T.surface_kind("ident").alias("kind"), T.term_id("ident").alias("term_id"), T.canonical_name("ident").alias("name"))


@query
def code_variants(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", _csv(T.code_variants("p_name")).alias("variants"))


@query
def unicode_normalize(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    wide = F.translate("p_name", X.LETTERS, X.WIDE)
    t = p.select("p_partkey", F.when(k == 0, wide).when(k == 1, F.concat(F.lit("​"), F.replace("p_name", F.lit(" "), F.lit("\t ")))).otherwise(F.concat("p_name", F.lit("‮x"))).alias("text"))
    return unicode_metadata(t).select("p_partkey", "norm", "changed", "has_bidi", F.size("findings").alias("n_findings"))


@query
def guard_calls(spark, sf_dir):
    o = X.order_lines(spark, sf_dir).withColumn("tool_name", F.when(F.col("text_id") % 2 == 0, F.concat(F.lit("catalog.update_"), "noun")).otherwise("catalog.delete"))
    o = o.withColumn("text", F.when(F.col("text_id") % 50 == 0, F.concat("text", F.lit("‮"))).otherwise(F.col("text")))
    g = resolve.guard(written(o, "guard-calls"), X.catalog(spark, sf_dir))
    return g.select("text_id", "tool_name", "status", "action", "is_allowed", "unicode_blocked")


@query
def behavior_metrics(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    adj, noun = F.split("canonical", " ")[0], F.split("canonical", " ")[1]
    odd = F.length("canonical") % 5 == 0
    none = F.lit(None).cast("string")
    call = lambda tool, allowed: F.struct(tool.alias("tool_name"), none.alias("expected_status"), none.alias("expected_action"), F.lit(allowed).alias("expected_allowed"))
    q = v.terms.select(
        F.col("term_id").alias("id"), F.concat(F.lit("update "), "canonical").alias("text"), F.array().cast("array<string>").alias("scopes"), F.when(odd, "ambiguous").otherwise("resolved").alias("expected_status"), none.alias("expected_action"),
        F.array("term_id").alias("expected_term_ids"), F.col("term_id").alias("expected_primary_term_id"), F.array(call(F.concat(F.lit("catalog.update_"), noun), True), call(F.concat(F.lit("catalog.drop_"), adj), False)).alias("tool_calls"),
    )
    m = evaluate.metrics(*evaluate.run_evaluation(q, v))
    return m.withColumn("ratio", F.coalesce("ratio", F.lit(-1.0)))  # -1: nothing was checked


def _counted(spark, sf_dir):
    return scout.accumulate(scout.surfaces_of_lines(scout.lines(X.corpus(spark, sf_dir))), scout.existing_surfaces(X.catalog(spark, sf_dir)))


@query
def scout_scored(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    return scout.scored(_counted(spark, sf_dir), docs.count()).select("key", "kind", "occurrence_count", "document_count", "jargon_score", "background_penalty", "score")


def _top(spark, sf_dir, most=50):
    return scout.discover(X.corpus(spark, sf_dir), scout.existing_surfaces(X.catalog(spark, sf_dir)), 0.25, most)


@query
def scout_topk(spark, sf_dir):
    """The top 50 are the feature here."""
    return _top(spark, sf_dir).select("key", "surface", "kind", "score", "cluster_key", "cluster_size", "token_fragmentation_score", "surface_shape_score", "oov_score", "surface_risk_score", "priority_score", "priority", _csv("priority_reasons").alias("reasons"))


@query
def scout_clusters(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    c = scout.clusters(scout.scored(_counted(spark, sf_dir), docs.count()))
    return c.select("cluster_key", "representative", _csv("surfaces").alias("surfaces"), "candidate_count", "top_score", "occurrence_count", "document_count")


@query
def quality_report(spark, sf_dir):
    t = _top(spark, sf_dir)
    return scout.quality_report(t, X.corpus(spark, sf_dir).count(), 0)


@query
def quality_reasons(spark, sf_dir):
    return scout.reason_counts(_top(spark, sf_dir))


def _candidates_of_list(spark):
    """Names to look for that do not depend on the corpus."""
    rows = ["that this", "from the with", "for and", "The", "ION", "nicht eine", "dans pour", "para por"]
    return spark.createDataFrame([(r,) for r in rows], "surface string").withColumn("key", T.surface_key("surface"))


@query
def scout_occurrences(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    return scout.occurrences(docs, _top(spark, sf_dir, 20), 5).select("key", "occ_ord", "doc_ord", "line", "line_text")


@query
def evidence_positive(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    return evidence.positive(docs, scout.occurrences(docs, _top(spark, sf_dir, 20), 20), context=0, most=3).select("key", "ord", "doc_ord", "start_line", "end_line", "text")


@query
def evidence_negative(spark, sf_dir):
    docs = X.corpus(spark, sf_dir)
    none = spark.createDataFrame([], "key string, doc_ord long, start_line int, end_line int")
    return evidence.negative(docs, _candidates_of_list(spark), none, context=0, most=3).select("key", "ord", "doc_ord", "start_line", "text", "matched")


@query
def safety_findings(spark, sf_dir):
    return safety.scan(X.injected(spark, sf_dir)).select("doc_id", "rule_id", "risk", "line_number", "matched_text", "scope")


@query
def safety_rollup(spark, sf_dir):
    d = X.injected(spark, sf_dir)
    return safety.rollup(d, safety.scan(d))


@query
def safety_sanitize(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.sanitize("html").alias("safe"), T.sanitize("html", 400).alias("beginning"))


def _misspelt(spark, sf_dir):
    """Identifiers that miss a letter of a catalog name, or use another adjective."""
    p = X.table(spark, sf_dir, "part").select("p_name").distinct()
    adj, noun = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    return p.select(F.explode(F.array(F.concat(adj, F.initcap(F.expr("substring(split(p_name, ' ')[1], 1, length(split(p_name, ' ')[1]) - 1)"))), F.concat(F.lit("tiny_"), noun), F.concat(adj, F.lit("-limit")))).alias("name"))


@query
def near_miss_components(spark, sf_dir):
    pr = nearmiss.pairs(_misspelt(spark, sf_dir), nearmiss.known_surfaces(X.catalog(spark, sf_dir)), 0.42)
    c = nearmiss.components(pr)
    return c.select("name", "term_id", "known", _csv("shared").alias("shared"), T.round4(F.col("raw_jaccard")).alias("raw_jaccard"), "same_prefix", "same_suffix", "shape_score")


@query
def near_miss_topk(spark, sf_dir):
    return nearmiss.suggest(_misspelt(spark, sf_dir), X.catalog(spark, sf_dir)).select("name", "rank", "term_id", "known", "confidence", _csv("reasons").alias("reasons"), "escalate")


@query
def semantic_rerank(spark, sf_dir):
    """Each vector as a name, the vectors after it as its targets."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s = e.select(F.concat(F.lit("v"), "vec_id").alias("name"), F.explode(F.array(*[F.col("vec_id") + k for k in (1, 2, 3)])).alias("to")).select("name", F.concat(F.lit("v"), "to").alias("canonical"), F.lit(None).cast("array<string>").alias("requested"), (F.col("to") % 4 != 0).alias("escalate"), F.col("to").cast("int").alias("rank"))
    vectors = e.select(F.concat(F.lit("v"), "vec_id").alias("key"), "embedding")
    return nearmiss.rerank(s, vectors, 0.0).select("name", "canonical", "escalate", T.round4(F.col("semantic")).alias("semantic"))


@query
def drift_known(spark, sf_dir):
    return drift.known_occurrences(X.code_lines(spark, sf_dir), X.catalog(spark, sf_dir)).select("path", "line_number", "term_id", "surface", "matched_text")


@query
def drift_unknown(spark, sf_dir):
    u = drift.unknown_identifiers(X.code_lines(spark, sf_dir), X.catalog(spark, sf_dir))
    return u.select("path", "line_number", "name", "review_kind", F.size("suggestions").alias("n_suggestions"))


@query
def drift_summary(spark, sf_dir):
    lines, v = written(X.code_lines(spark, sf_dir), "drift-lines"), X.catalog(spark, sf_dir)
    return drift.summary(lines, drift.known_occurrences(lines, v), drift.unknown_identifiers(lines, v))


@query
def diff_items(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    return versions.diff(v, X.edited(v, "theirs")).select("change", "object_kind", "object_id", "field", F.when(F.col("change") == "changed", F.col("before")).alias("before"), F.when(F.col("change") == "changed", F.col("after")).alias("after"))


@query
def diff_summary(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    return versions.diff_summary(versions.diff(v, X.edited(v, "ours")))


def _three(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    return v, X.edited(v, "ours"), X.edited(v, "theirs")


@query
def merge_terms(spark, sf_dir):
    t, _ = versions.merge_terms(*_three(spark, sf_dir))
    return t.select("term_id", "side", "canonical", "description", _csv("tags").alias("tags"), _csv("tools").alias("tools"), "deprecated", "metadata")


@query
def merge_conflicts(spark, sf_dir):
    _, c = versions.merge_terms(*_three(spark, sf_dir))
    return c.select("object_kind", "object_id", "field", "reason")


@query
def merge_aliases(spark, sf_dir):
    vs = _three(spark, sf_dir)
    a, _ = versions.merge_aliases(*vs, versions.merge_terms(*vs)[0])
    return a.select("term_id", "surface", "case_sensitive")


@query
def merge_warnings(spark, sf_dir):
    return versions.rename_warnings(*_three(spark, sf_dir))


@query
def migrations_explicit(spark, sf_dir):
    return versions.migrations(X.catalog(spark, sf_dir), most=1000).select("term_id", "new_id", "confidence", "risk", "match_kind")


@query
def migrations_similar(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    free = V.Vocabulary(v.scopes, v.terms.withColumn("replacement_id", F.lit(None).cast("string")), v.aliases, v.evidence, v.proposals)
    return versions.migrations(free, most=1000).select("term_id", "new_id", "confidence", "risk", "match_kind")


@query
def lint_findings(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    t = v.terms.withColumn("canonical", F.when(F.contains("canonical", F.lit("gear")), "limit").when(F.contains("canonical", F.lit("rod")), "ab").otherwise(F.col("canonical")))
    return lint.surface_findings(V.Vocabulary(v.scopes, t, v.aliases, v.evidence, v.proposals))


@query
def surface_collisions(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    t = v.terms.withColumn("scopes", F.array(F.lit("all")))
    a = v.aliases.withColumn("scopes", F.array().cast("array<string>"))
    c = lint.surface_collisions(V.Vocabulary(v.scopes, t, a, v.evidence, v.proposals))
    return c.select(_csv("term_ids").alias("term_ids"), _csv("surfaces").alias("surfaces"), _csv("scopes").alias("scopes"), _csv("search_surfaces").alias("search_surfaces"))


@query
def alias_collisions(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    a = v.aliases.withColumn("scopes", F.array().cast("array<string>"))
    c = V.alias_collisions(V.Vocabulary(v.scopes, v.terms, a, v.evidence, v.proposals))
    return c.select("surface_key", _csv("term_ids").alias("term_ids"))


@query
def dangling_refs(spark, sf_dir):
    v = X.catalog(spark, sf_dir)
    return V.integrity_problems(V.Vocabulary(v.scopes.where("scope_id NOT IN ('red', 'small')"), v.terms.where("canonical <> 'new gear'"), v.aliases.where("surface <> 'gear'"), v.evidence, v.proposals))


@query
def latest_decisions(spark, sf_dir):
    return review.latest_decisions(X.review_events(spark, sf_dir)).select("key", "decision", "reviewer", "created_at", "updated_at")


@query
def review_events_filtered(spark, sf_dir):
    return X.review_events(spark, sf_dir).where("decision = 'accepted'").select("event_id", "key", "note", "reviewer")


def _items(spark, sf_dir):
    """Review items from parts."""
    p = X.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    surface = F.when(k % 5 == 0, "limit").when(k % 5 == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_name"))
    return p.select(k.cast("string").alias("key"), surface.alias("surface"), ((k % 100) / 100).alias("score"), ((k % 7) / 10).alias("jargon_score"), (k % 4).cast("int").alias("positive_count"), (k % 3).cast("int").alias("negative_count"), F.when(k % 9 == 0, "high").otherwise("none").alias("highest_risk"))


@query
def review_inbox(spark, sf_dir):
    """The first 100 rows are the feature here."""
    i = _items(spark, sf_dir)
    d = i.where(F.col("key").cast("int") % 3 == 0).select("key", F.lit("accepted").alias("decision"), F.lit("").alias("note"))
    return review.inbox(i.select("key", F.concat("surface", F.lit("#"), "key").alias("surface"), "score"), i, d, 100).select("key", "surface", "score", "positive_count", "decision")


@query
def review_heuristic(spark, sf_dir):
    r = review.heuristic_review(_items(spark, sf_dir))
    return r.select("key", "recommendation", T.round4(F.col("confidence")).alias("confidence"), "canonical_name", _csv("risk_flags").alias("flags"), "llm_review_allowed")


@query
def consensus_votes(spark, sf_dir):
    r = review.heuristic_review(_items(spark, sf_dir).where("highest_risk = 'none'"))
    s = r.select(F.concat(F.lit("g"), F.col("key").cast("int") % 40).alias("key"), F.col("key").cast("int").alias("seq"), "recommendation", "canonical_name", "confidence", "llm_review_allowed")
    return review.consensus(s, 0.3, 0.5).select("key", "status", "recommendation", "sample_count", "agreement_count", "agreement_ratio")


@query
def dataset_quality(spark, sf_dir):
    e = X.review_events(spark, sf_dir).withColumn("key", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("one "), "event_id")).otherwise(F.col("key")))
    return review.dataset_quality(e).select("event_id", "quality", "quality_score", _csv("flags").alias("flags"))


@query
def policy_matrix(spark, sf_dir):
    return review.policy_matrix(spark)


@query
def snapshot_new_terms(spark, sf_dir):
    from termweave.plans.workflows import new_terms

    return new_terms(_items(spark, sf_dir), X.catalog(spark, sf_dir)).select("key", "term_id", "canonical")
