"""Vocabulary documents (JSON or YAML) as tables: scopes, terms, aliases, evidence and proposals.

A document is small and read on the driver, from a local path or through Spark from any store. Large vocabularies can be
given as tables right away (``Vocabulary(spark, scopes, terms, ...)``); everything behind works on the tables alone.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {".json": "json", ".yaml": "yaml", ".yml": "yaml"}
EVIDENCE_KINDS = ("positive", "negative", "context")
PROPOSAL_STATUS, RISKS = ("pending", "accepted", "rejected", "needs_review"), ("low", "medium", "high")
REPLACEMENT_KEYS = ("replacement_term_id", "replaced_by", "canonical_replacement_term_id")

EVIDENCE = "source_path string, snippet string, kind string, start_line int, end_line int, source_id string, metadata string"
SCOPE_SCHEMA = "scope_ord int, scope_id string, label string, description string, parents array<string>, metadata string"
TERM_SCHEMA = "term_ord int, term_id string, canonical string, description string, scopes array<string>, tags array<string>, tools array<string>, deprecated boolean, replacement_id string, metadata string"
ALIAS_SCHEMA = "term_ord int, term_id string, alias_ord int, surface string, scopes array<string>, case_sensitive boolean, deprecated boolean, metadata string"
EVIDENCE_SCHEMA = f"owner_kind string, owner_id string, evidence_ord int, {EVIDENCE}"
PROPOSAL_SCHEMA = "proposal_ord int, proposal_id string, kind string, surface string, status string, candidate_term_id string, target_term_id string, confidence double, risk string, scopes array<string>, rationale string, metadata string"


class VocabularyError(ValueError):
    """The document cannot be read or breaks a rule."""


@dataclass(frozen=True)
class Vocabulary:
    scopes: DataFrame
    terms: DataFrame
    aliases: DataFrame
    evidence: DataFrame
    proposals: DataFrame
    fingerprint: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.terms.sparkSession

    def create_views(self, prefix: str = "vocab") -> None:
        """Make the tables known to SQL."""
        for name in ("scopes", "terms", "aliases", "evidence", "proposals"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}_{name}")


def _text(value: Any, what: str) -> str:
    if value is None or not str(value).strip():
        raise VocabularyError(f"{what} must not be empty")
    return str(value).strip()


def _optional(value: Any) -> str | None:
    return str(value).strip() or None if value is not None else None


def _texts(value: Any, what: str) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, (list, tuple)):
        raise VocabularyError(f"{what} must be a list")
    return [str(v).strip() for v in value if str(v).strip()]


def _json(value: Any) -> str:
    return json.dumps({str(k): v for k, v in (value or {}).items()}, sort_keys=True, ensure_ascii=False, default=str)


def _one_of(value: Any, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise VocabularyError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
    return value


def _evidence_rows(items: Any, kind: str, owner: str) -> list[tuple]:
    rows = []
    for k, e in enumerate(items or []):
        start, end = e.get("start_line"), e.get("end_line")
        if start is not None and int(start) < 1 or end is not None and start is not None and int(end) < int(start):
            raise VocabularyError(f"evidence of {owner}: line range {start}-{end}")
        rows.append((kind, owner, k, _optional(e.get("source_path")), _text(e.get("snippet"), f"snippet of {owner}"), _one_of(e.get("kind", "context"), EVIDENCE_KINDS, "evidence kind"), start, end, _optional(e.get("source_id")), _json(e.get("metadata"))))
    return rows


def parse(text: str, form: str) -> dict:
    """A document as a mapping."""
    if form == "json":
        data = json.loads(text)
    elif form == "yaml":
        import yaml

        data = yaml.safe_load(text)
    else:
        raise VocabularyError(f"unknown format {form!r}")
    if not isinstance(data, dict):
        raise VocabularyError("the document must be a mapping")
    return data


def from_mapping(spark: SparkSession, data: dict, check: bool = True) -> Vocabulary:
    """Tables of a document; with check, its integrity rules are enforced."""
    if str(data.get("version", "1")) != "1":
        raise VocabularyError(f"version must be 1; got {data.get('version')!r}")
    scopes, terms, aliases, evidence, proposals = [], [], [], [], []
    for k, s in enumerate(data.get("scopes") or []):
        scopes.append((k, _text(s.get("id"), "scope id"), _optional(s.get("label")), _optional(s.get("description")), _texts(s.get("parents"), "parents"), _json(s.get("metadata"))))
    for k, t in enumerate(data.get("terms") or []):
        tid, meta = _text(t.get("id"), "term id"), t.get("metadata") or {}
        replaced = next((str(meta[key]).strip() for key in REPLACEMENT_KEYS if isinstance(meta.get(key), str) and meta[key].strip()), None)
        terms.append((k, tid, _text(t.get("canonical"), f"canonical of {tid}"), _optional(t.get("description")), _texts(t.get("scopes"), "scopes"), _texts(t.get("tags"), "tags"), _texts(t.get("tools"), "tools"), bool(t.get("deprecated", False)), replaced, _json(meta)))
        for j, a in enumerate(t.get("aliases") or []):
            a = {"surface": a} if isinstance(a, str) else a
            aliases.append((k, str(a.get("term_id") or tid), j, _text(a.get("surface"), f"alias of {tid}"), _texts(a.get("scopes"), "scopes"), bool(a.get("case_sensitive", False)), bool(a.get("deprecated", False)), _json(a.get("metadata"))))
        evidence += _evidence_rows(t.get("evidence"), "term", tid)
    for k, p in enumerate(data.get("proposals") or []):
        pid = _text(p.get("id"), "proposal id")
        confidence = float(p.get("confidence", 0.0))
        if not 0 <= confidence <= 1:
            raise VocabularyError(f"confidence of {pid} must lie between 0 and 1")
        proposals.append((k, pid, _text(p.get("kind"), "proposal kind"), _text(p.get("surface"), "proposal surface"), _one_of(p.get("status", "pending"), PROPOSAL_STATUS, "status"), _optional(p.get("candidate_term_id")), _optional(p.get("target_term_id")), confidence, _one_of(p.get("risk", "medium"), RISKS, "risk"), _texts(p.get("scopes"), "scopes"), _optional(p.get("rationale")), _json(p.get("metadata"))))
        evidence += _evidence_rows(p.get("evidence"), "proposal", pid)
    canonical = json.dumps(data, sort_keys=True, ensure_ascii=False, default=str)
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((scopes, SCOPE_SCHEMA), (terms, TERM_SCHEMA), (aliases, ALIAS_SCHEMA), (evidence, EVIDENCE_SCHEMA), (proposals, PROPOSAL_SCHEMA))]
    v = Vocabulary(*tables, fingerprint=hashlib.sha256(canonical.encode()).hexdigest())
    if check:
        problems = integrity_problems(v).orderBy("problem", "object_id").limit(20).collect()
        if problems:
            raise VocabularyError("; ".join(f"{p.problem}: {p.object_id} ({p.detail})" for p in problems))
    return v


def load(spark: SparkSession, path: str, form: str | None = None, check: bool = True) -> Vocabulary:
    """Read a document by its suffix or the given format; other paths than local ones go through Spark."""
    form = form or FORMATS.get(Path(path).suffix.lower())
    if form is None:
        raise VocabularyError(f"unknown suffix: {path}")
    if "://" in path:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        if not Path(path).is_file():
            raise VocabularyError(f"not a file: {path}")
        text = Path(path).read_text(encoding="utf-8")
    return from_mapping(spark, parse(text, form), check)


def alias_scopes(v: Vocabulary) -> DataFrame:
    """Aliases with the scopes that hold for them: their own, else those of their term."""
    t = v.terms.select("term_id", F.col("scopes").alias("term_scopes"), F.col("deprecated").alias("term_deprecated"), "canonical")
    return v.aliases.join(t, "term_id").withColumn("scopes_used", F.when(F.size("scopes") > 0, F.col("scopes")).otherwise(F.col("term_scopes")))


def _problem(df: DataFrame, what: str, object_id, detail) -> DataFrame:
    return df.select(F.lit(what).alias("problem"), object_id.alias("object_id"), detail.cast("string").alias("detail"))


def duplicates(df: DataFrame, key: str, what: str) -> DataFrame:
    return _problem(df.groupBy(key).count().where("count > 1"), what, F.col(key), F.col("count"))


def dangling_references(v: Vocabulary) -> DataFrame:
    """References to scopes and terms that don't exist."""
    known_scopes, known_terms = v.scopes.select(F.col("scope_id").alias("ref")), v.terms.select(F.col("term_id").alias("ref"))
    uses = [(v.scopes, "scope_id", "parents"), (v.terms, "term_id", "scopes"), (v.aliases, "surface", "scopes"), (v.proposals, "proposal_id", "scopes")]
    out = None
    for df, owner, field in uses:
        found = _problem(df.select(F.col(owner).alias("o"), F.explode(field).alias("ref")).join(known_scopes, "ref", "left_anti"), "unknown scope", F.col("o"), F.col("ref"))
        out = found if out is None else out.unionByName(found)
    for field in ("candidate_term_id", "target_term_id"):
        refs = v.proposals.select(F.col("proposal_id").alias("o"), F.col(field).alias("ref")).where("ref IS NOT NULL")
        out = out.unionByName(_problem(refs.join(known_terms, "ref", "left_anti"), "unknown term", F.col("o"), F.col("ref")))
    return out


def replacement_problems(v: Vocabulary) -> DataFrame:
    """Replacements stand on deprecated terms and name another, active term."""
    r = v.terms.where("replacement_id IS NOT NULL").select("term_id", "deprecated", "replacement_id")
    target = v.terms.select(F.col("term_id").alias("replacement_id"), F.col("deprecated").alias("target_deprecated"))
    j = r.join(target, "replacement_id", "left")
    why = F.when(~F.col("deprecated"), "replacement on an active term").when(F.col("term_id") == F.col("replacement_id"), "replaced by itself").when(F.col("target_deprecated").isNull(), "replacement does not exist").when(F.col("target_deprecated"), "replacement is deprecated")
    return j.withColumn("why", why).where("why IS NOT NULL").select(F.col("why").alias("problem"), F.col("term_id").alias("object_id"), F.col("replacement_id").alias("detail"))


def alias_collisions(v: Vocabulary) -> DataFrame:
    """Active surfaces of several terms under the same scopes and case rule: surface_key, scopes, case_sensitive, term_ids.

    An alias counts under its own scopes, which may be none.
    """
    from termweave.functions.text import casefold

    active = v.terms.where("NOT deprecated")
    canon = active.select("term_id", F.col("canonical").alias("surface"), "scopes", F.lit(False).alias("case_sensitive"))
    alias = v.aliases.where("NOT deprecated").join(active.select("term_id"), "term_id", "left_semi").select("term_id", "surface", "scopes", "case_sensitive")
    each = canon.unionByName(alias).withColumn("surface_key", casefold("surface"))
    return each.groupBy("surface_key", "scopes", "case_sensitive").agg(F.array_sort(F.collect_set("term_id")).alias("term_ids")).where(F.size("term_ids") > 1)


def integrity_problems(v: Vocabulary) -> DataFrame:
    """problem, object_id, detail: every rule that the tables break."""
    out = duplicates(v.scopes, "scope_id", "duplicate scope").unionByName(duplicates(v.terms, "term_id", "duplicate term")).unionByName(duplicates(v.proposals, "proposal_id", "duplicate proposal"))
    out = out.unionByName(dangling_references(v)).unionByName(replacement_problems(v))
    return out.unionByName(_problem(alias_collisions(v), "surface collision", F.col("surface_key"), F.array_join("term_ids", ",")))


def to_document(v: Vocabulary) -> dict:
    """The tables as one document again; for vocabularies that fit one file."""
    drop = lambda d: {k: x for k, x in d.items() if x not in (None, [], {}, "")}
    rows = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    ev: dict[tuple, list] = {}
    for e in rows(v.evidence, "owner_kind", "owner_id", "evidence_ord"):
        ev.setdefault((e.pop("owner_kind"), e.pop("owner_id")), []).append(drop({k: x for k, x in e.items() if k != "evidence_ord"} | {"metadata": json.loads(e["metadata"] or "{}")}))
    al: dict[str, list] = {}
    for a in rows(v.aliases, "term_ord", "term_id", "alias_ord", "surface"):
        al.setdefault(a["term_id"], []).append(drop({k: a[k] for k in ("surface", "scopes")} | {k: a[k] for k in ("case_sensitive", "deprecated") if a[k]} | {"metadata": json.loads(a["metadata"] or "{}")}))
    doc = {"version": 1, "scopes": [], "terms": [], "proposals": []}
    for s in rows(v.scopes, "scope_ord", "scope_id"):
        doc["scopes"].append(drop({"id": s["scope_id"], "label": s["label"], "description": s["description"], "parents": s["parents"], "metadata": json.loads(s["metadata"] or "{}")}))
    for t in rows(v.terms, "term_ord", "term_id"):
        item = {"id": t["term_id"]} | {k: t[k] for k in ("canonical", "description", "scopes", "tags", "tools")} | ({"deprecated": True} if t["deprecated"] else {})
        doc["terms"].append(drop(item | {"aliases": al.get(t["term_id"], []), "evidence": ev.get(("term", t["term_id"]), []), "metadata": json.loads(t["metadata"] or "{}")}))
    for p in rows(v.proposals, "proposal_ord", "proposal_id"):
        item = {"id": p["proposal_id"]} | {k: p[k] for k in ("kind", "surface", "status", "candidate_term_id", "target_term_id", "confidence", "risk", "scopes", "rationale")}
        doc["proposals"].append(drop(item | {"evidence": ev.get(("proposal", p["proposal_id"]), []), "metadata": json.loads(p["metadata"] or "{}")}))
    return doc
