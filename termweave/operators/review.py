"""Review of candidates: inbox, decisions from events, a rule-based reviewer, consensus of samples, training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.constants import ACTIONS, DEFAULT_ROLE, ROLES, TEAM_ROLES
from termweave.functions import text as T

DECISIONS = ("accepted", "rejected", "ambiguous", "needs_split")
RECOMMENDATIONS = ("accept", "reject", "needs_split", "needs_more_evidence")
RESPONSE = "recommendation string, confidence double, canonical_name string, reviewer_note string, risk_flags array<string>"


def latest_decisions(events: DataFrame) -> DataFrame:
    """key, decision, note, reviewer of the last event of each surface, created_at of the first. seq breaks ties."""
    last = F.struct("created_at", "seq")
    return events.groupBy("key").agg(F.max_by("decision", last).alias("decision"), F.max_by("note", last).alias("note"), F.max_by("reviewer", last).alias("reviewer"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def inbox(candidates: DataFrame, packs: DataFrame, decisions: DataFrame, most: int = 100) -> DataFrame:
    """Candidates with evidence counts and decisions, open ones first, best first."""
    e = packs.select("key", "positive_count", "negative_count")
    d = decisions.select("key", "decision", "note")
    j = candidates.join(e, "key", "left").join(d, "key", "left").fillna(0, ["positive_count", "negative_count"])
    return j.orderBy(F.when(F.col("decision").isNull(), 0).otherwise(1), F.desc("score"), "surface").limit(most)


def heuristic_review(items: DataFrame) -> DataFrame:
    """A recommendation by rules for items with surface, score, jargon_score, positive_count, negative_count, highest_risk."""
    s, risky = F.col("score"), F.coalesce("highest_risk", F.lit("none")) == "high"
    name = T.canonical_name("surface")
    ladder = [
        (risky, "needs_more_evidence", F.lit(0.4), name, "prompt_injection_high"),
        (F.col("positive_count") == 0, "needs_more_evidence", F.lit(0.35), name, "missing_positive_evidence"),
        (T.generic_surface("surface") | ((s < 0.3) & (F.col("jargon_score") < 0.35)), "reject", F.lit(0.68), F.lit(""), "generic_surface"),
        ((F.col("negative_count") >= F.col("positive_count")) & (s < 0.65), "needs_split", F.lit(0.62), name, "ambiguous_evidence"),
        ((s >= 0.6) | (F.col("jargon_score") >= 0.65) | T.code_surface("surface"), "accept", F.least(F.lit(0.92), F.greatest(F.lit(0.7), s + 0.15)), name, None),
        (F.lit(True), "needs_more_evidence", F.lit(0.5), name, None),
    ]
    out = F
    for cond, rec, conf, canon, flag in ladder:
        flags = F.array(F.lit(flag)) if flag else F.array().cast("array<string>")
        out = out.when(cond, F.struct(F.lit(rec).alias("recommendation"), conf.cast("double").alias("confidence"), canon.alias("canonical_name"), flags.alias("risk_flags")))
    return items.withColumn("_r", out).select("*", "_r.*", (~risky).alias("llm_review_allowed")).drop("_r")


def parse_responses(responses: DataFrame) -> DataFrame:
    """key, seq and the fields of a reviewer's JSON response; invalid ones keep an error instead."""
    r = responses.withColumn("x", F.from_json("response", RESPONSE))
    good = F.col("x").isNotNull() & F.col("x.recommendation").isin(*RECOMMENDATIONS)
    out = r.select("key", "seq", F.when(good, F.col("x.recommendation")).alias("recommendation"), F.when(good, T.unit(F.coalesce("x.confidence", F.lit(0.0)))).alias("confidence"), F.when(good, F.coalesce(F.trim("x.canonical_name"), F.lit(""))).alias("canonical_name"), F.coalesce("x.reviewer_note", F.lit("")).alias("reviewer_note"), F.coalesce("x.risk_flags", F.array().cast("array<string>")).alias("risk_flags"), F.when(~F.coalesce(good, F.lit(False)), "invalid response").alias("error"))
    return out


def consensus(samples: DataFrame, min_agreement: float = 0.67, min_confidence: float = 0.65) -> DataFrame:
    """key, status (consensus, abstain, blocked), recommendation, canonical_name, sample_count, agreement_ratio, confidence.

    samples: key, seq, recommendation, canonical_name, confidence, llm_review_allowed. Groups of equal recommendation (and
    name, if accepted) compete by size, then mean confidence, then order.
    """
    group = F.when(F.col("recommendation") == "accept", T.surface_key(F.coalesce("canonical_name", F.lit("")))).otherwise("")
    s = samples.withColumn("vote", group)
    by = s.groupBy("key", "recommendation", "vote").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("seq").alias("first"))
    names = s.where("canonical_name <> ''").groupBy("key", "recommendation", "vote", "canonical_name").agg(F.count("*").alias("m"), F.min("seq").alias("f"))
    name = names.groupBy("key", "recommendation", "vote").agg(F.max_by("canonical_name", F.struct("m", -F.col("f"))).alias("canonical_name"))
    total = s.groupBy("key").agg(F.count("*").alias("sample_count"), F.bool_or(~F.col("llm_review_allowed")).alias("blocked"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), F.desc("mean"), "first")
    top = by.withColumn("_r", F.row_number().over(w)).where("_r = 1").join(name, ["key", "recommendation", "vote"], "left").join(total, "key")
    ratio, mean = T.round4(F.col("n") / F.col("sample_count")), T.round4(F.col("mean"))
    agreed = (ratio >= min_agreement) & (mean >= min_confidence)
    status = F.when(F.col("blocked"), "blocked").when(agreed, "consensus").otherwise("abstain")
    return top.select(
        "key", status.alias("status"), F.when(status == "consensus", F.col("recommendation")).otherwise("needs_more_evidence").alias("recommendation"), F.when(status == "consensus", F.coalesce("canonical_name", F.lit(""))).otherwise("").alias("canonical_name"),
        "sample_count", F.when(F.col("blocked"), F.col("sample_count")).otherwise(F.col("n")).alias("agreement_count"), F.when(F.col("blocked"), 1.0).otherwise(ratio).alias("agreement_ratio"),
        F.when(status == "consensus", mean).when(status == "abstain", F.least(mean, F.lit(0.55))).otherwise(0.4).alias("confidence"),
    )


def dataset_quality(events: DataFrame) -> DataFrame:
    """Each review event with quality, quality_score and flags. Events carry the snapshot's fields, null where missing:
    candidate_score, positive_count (null: no evidence), highest_risk, high_count, safety_action, has_candidate."""
    # decisions are counted by surface first, so that a surface with many events is no hot window
    sets = events.groupBy("key").agg(F.count_distinct("decision").alias("n_decisions"))
    e = events.join(sets, "key")
    unsafe = (F.coalesce("safety_action", F.lit("")) == "block_llm_review") | (F.coalesce("highest_risk", F.lit("")) == "high") | (F.coalesce("high_count", F.lit(0)) > 0)
    missing = [(~F.col("has_candidate"), "missing_candidate_snapshot"), (F.col("positive_count").isNull(), "missing_evidence_snapshot"), (F.coalesce(F.col("positive_count") == 0, F.lit(False)), "missing_positive_evidence"), (F.coalesce(F.col("note"), F.lit("")) == "", "missing_review_note")]
    flags = F.filter(F.array(*[F.when(c, n) for c, n in missing]), lambda x: x.isNotNull())
    incomplete = F.exists(flags, lambda f: f != "missing_review_note")
    weak = F.coalesce("candidate_score", F.lit(0.0)) < 0.3
    pick = lambda q, s, f: F.struct(F.lit(q).alias("quality"), s.alias("quality_score"), f.alias("flags"))
    one = lambda x: F.array(F.lit(x))
    q = (
        F.when(unsafe, pick("unsafe", F.lit(0.0), one("unsafe_prompt_evidence"))).when(F.col("n_decisions") > 1, pick("conflicting", F.lit(0.25), one("conflicting_human_decisions")))
        .when(incomplete, pick("incomplete", F.lit(0.35), flags)).when(weak, pick("low_signal", F.lit(0.6), F.concat(flags, one("low_signal_candidate"))))
        .otherwise(pick("usable", F.when(F.size(flags) == 0, 1.0).otherwise(0.85), F.when(F.size(flags) == 0, one("review_example_complete")).otherwise(flags)))
    )
    return e.withColumn("_q", q).select(*events.columns, "_q.*")


def policy_matrix(spark) -> DataFrame:
    """mode, action, role, allowed for every combination."""
    rows = []
    for mode in DEFAULT_ROLE:
        for action in ACTIONS:
            allowed = ROLES if mode == "solo" or action == "read_workspace" else TEAM_ROLES[action] if mode == "team" else ("owner",)
            rows += [(mode, action, role, role in allowed) for role in ROLES]
    return spark.createDataFrame(rows, "mode string, action string, role string, allowed boolean")


def check_policy(requests: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    """requests (mode, action, actor, role): the role that counts and whether it may act.

    A given role counts first, then the actor's, then the mode's default; unknown combinations are refused.
    """
    r = requests
    r = r.withColumn("actor_role", F.lit(None).cast("string")) if actors is None else r.join(actors.select("actor", F.col("role").alias("actor_role")), "actor", "left")
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_ROLE.items() for x in kv])
    r = r.withColumn("role", F.coalesce("role", "actor_role", F.element_at(default, F.col("mode")))).drop("actor_role")
    m = policy_matrix(requests.sparkSession)
    return r.join(F.broadcast(m), ["mode", "action", "role"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


QUALITIES = ("usable", "low_signal", "incomplete", "conflicting", "unsafe")


def quality_counts(examples: DataFrame) -> DataFrame:
    """quality, n for every quality, those without examples too."""
    every = examples.sparkSession.createDataFrame([(q,) for q in QUALITIES], "quality string")
    return every.join(examples.groupBy("quality").agg(F.count("*").alias("n")), "quality", "left").fillna(0, ["n"])


def build_dataset(events: DataFrame, quality: str | None = None, most: int | None = None) -> DataFrame:
    """Training examples of the first `most` events; conflicts are looked for among these, then the quality is filtered."""
    first = events if most is None else events.orderBy("created_at", "seq").limit(most)
    out = dataset_quality(first)
    return out if quality is None else out.where(F.col("quality") == quality)


def export_dataset(examples: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order."""
    examples.select(F.to_json(F.struct(*sorted(examples.columns))).alias("value")).write.mode("overwrite").text(path)


def newest(snapshots: DataFrame, most: int = 5) -> DataFrame:
    """The newest snapshots; seq breaks ties."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("seq")).limit(most)


def find_evidence(requests: DataFrame, lexical: DataFrame, workspace: DataFrame, most: int = 5) -> DataFrame:
    """request_id, rank, source, snippet: evidence of the vocabulary first, then of the workspace.

    requests: request_id, term_id, key; lexical: owner_id, evidence_ord, snippet; workspace: key, ord, text.
    """
    a = requests.join(lexical, requests["term_id"] == lexical["owner_id"]).select("request_id", F.lit(0).alias("source_ord"), F.col("evidence_ord").alias("ord"), "snippet")
    b = requests.join(workspace, "key").select("request_id", F.lit(1).alias("source_ord"), "ord", F.col("text").alias("snippet"))
    w = Window.partitionBy("request_id").orderBy("source_ord", "ord")
    out = a.unionByName(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return out.select("request_id", "rank", F.when(F.col("source_ord") == 0, "vocabulary").otherwise("workspace").alias("source"), "snippet")
