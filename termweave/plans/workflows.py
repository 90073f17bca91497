"""Workflows over the operators: scan, publish, dictionary checks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import evaluate, evidence, safety, scout, versions
from termweave.operators.resolve import small
from termweave.sources import store, vocabulary as V


def scan(documents: DataFrame, v: V.Vocabulary | None = None, min_score: float = 0.25, most: int = 20, context: int = 1) -> dict[str, DataFrame]:
    """Documents to reviewable candidates: findings, candidates, packs. documents: doc_ord, path, text."""
    known = scout.existing_surfaces(v) if v is not None else None
    found = scout.discover(documents, known, min_score, most)
    occ = scout.occurrences(documents, found)
    pos = evidence.positive(documents, occ, context)
    neg = evidence.negative(documents, found, pos, context)
    flags = safety.scan(documents.select(F.col("doc_ord").alias("doc_id"), "text"))
    return {"documents": documents, "findings": flags, "candidates": found, "occurrences": occ, "packs": evidence.packs(found, pos, neg)}


def new_terms(accepted: DataFrame, v: V.Vocabulary) -> DataFrame:
    """key, surface, term_id, canonical of accepted items that the vocabulary lacks; repeated ids are numbered by key."""
    fresh = accepted.withColumn("skey", T.surface_key("surface")).join(small(scout.existing_surfaces(v).withColumnRenamed("key", "skey")), "skey", "left_anti")
    based = fresh.withColumn("base", F.coalesce(T.term_id("surface"), F.concat(F.lit("term_"), F.substring(F.md5("surface"), 1, 8))))
    taken = v.terms.select(F.col("term_id").alias("base"), F.lit(1).alias("used"))
    based = based.join(small(taken), "base", "left").withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("key")) + F.coalesce("used", F.lit(0)))
    return based.select("key", "surface", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), "n")).alias("term_id"), T.canonical_name("surface").alias("canonical"))


def publish(accepted: DataFrame, v: V.Vocabulary, path: str) -> dict:
    """Write the vocabulary with the accepted terms as one JSON document; at most 10,000 accepted items are taken."""
    rows = new_terms(accepted, v).orderBy("key").limit(10_000).collect()
    doc = V.to_document(v) | {"proposals": []}
    doc["terms"] += [{"id": r.term_id, "canonical": r.canonical, "aliases": [r.surface] if r.surface != r.canonical else []} for r in rows]
    store.write_text_atomically(path, json.dumps(doc, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
    return {"term_count": len(doc["terms"]), "generated_term_count": len(rows), "output_path": path}


def check_dictionary(v: V.Vocabulary, queries: DataFrame | None = None, base: V.Vocabulary | None = None, merge: tuple[V.Vocabulary, V.Vocabulary, V.Vocabulary] | None = None, fail_on_change: bool = False) -> list[tuple[str, str, str]]:
    """(check, passed / failed / skipped, detail) for integrity, behaviour, differences and merge."""
    out = []
    bad = V.integrity_problems(v).count()
    out.append(("integrity", "failed" if bad else "passed", f"{bad} problems"))
    if queries is None:
        out.append(("behavior", "skipped", ""))
    else:
        m = {r.metric: r for r in evaluate.metrics(*evaluate.run_evaluation(queries, v)).collect()}["overall"]
        out.append(("behavior", "passed" if m.passed == m.total else "failed", f"{m.passed} of {m.total}"))
    n = versions.diff(base, v).count() if base is not None else None
    out.append(("semantic_diff", "skipped" if n is None else "failed" if n and fail_on_change else "passed", "" if n is None else f"{n} changes"))
    if merge is None:
        out.append(("semantic_merge", "skipped", ""))
    else:
        k = versions.merge(*merge)[1].count()
        out.append(("semantic_merge", "failed" if k else "passed", f"{k} conflicts"))
    return out


def write_merged(base: V.Vocabulary, ours: V.Vocabulary, theirs: V.Vocabulary, path: str) -> dict:
    """Write the merged vocabulary as one JSON document; conflicts are an error and nothing is written."""
    merged, conflicts = versions.merge(base, ours, theirs)
    clash = conflicts.orderBy("object_kind", "object_id").limit(20).collect()
    if clash:
        raise V.VocabularyError("; ".join(f"{x.object_kind} {x.object_id}: {x.reason}" for x in clash))
    doc = V.to_document(merged)
    V.from_mapping(base.spark, doc)  # a merge that breaks a rule is an error, too
    store.write_text_atomically(path, json.dumps(doc, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
    return doc
