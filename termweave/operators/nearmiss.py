"""Near misses: unknown names and the known surfaces that they may mean.

Scoring is exact without comparing every pair: above NEAR_MISS_UNBRIDGED a pair shares a fragment or has related ones,
so pairs come from an equi-join on fragments. Each distinct name is scored once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.constants import BROAD_FRAGMENTS, NEAR_MISS_BAND, NEAR_MISS_CONFIDENCE, NEAR_MISS_UNBRIDGED, RELATED_FRAGMENTS, WEAK_BRIDGES
from termweave.functions import text as T
from termweave.operators.resolve import small
from termweave.sources.vocabulary import Vocabulary, alias_scopes


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a, b) -> Column:
    """Ratcliff-Obershelp similarity of two strings, as no SQL function has it."""
    return F.pandas_udf(_ratios, "double")(T.col(a), T.col(b))


def known_surfaces(v: Vocabulary, include_deprecated: bool = False) -> DataFrame:
    """term_id, canonical, known, scopes, deprecated: surfaces and their code variants."""
    canon = v.terms.select("term_id", "canonical", F.col("canonical").alias("surface"), "scopes", "deprecated")
    alias = alias_scopes(v).select("term_id", "canonical", "surface", F.col("scopes_used").alias("scopes"), (F.col("term_deprecated") | F.col("deprecated")).alias("deprecated"))
    both = canon.unionByName(alias)
    both = both if include_deprecated else both.where("NOT deprecated")
    each = both.select("term_id", "canonical", "scopes", "deprecated", F.explode(F.array_distinct(F.concat(F.array("surface"), T.code_variants("surface")))).alias("known"))
    return each.withColumns({"tf": T.fragments("known"), "tnorm": T.normalized_fragments("known")}).where(F.size("tf") > 0).distinct()


def related_map() -> Column:
    return F.create_map(*[x for k, vs in RELATED_FRAGMENTS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in sorted(vs)]))])


def related_pairs(qf, tf) -> Column:
    """fragment:related for each fragment of a name whose related ones stand in the other."""
    none = F.array().cast("array<string>")
    per = F.transform(qf, lambda f: F.transform(F.filter(F.coalesce(F.element_at(related_map(), f), none), lambda r: F.array_contains(tf, r)), lambda r: F.concat(f, F.lit(":"), r)))
    return F.array_distinct(F.flatten(per))


def _weight(fs: Column) -> Column:
    return F.aggregate(fs, F.lit(0.0), lambda a, f: a + F.when(T.one_of(f, BROAD_FRAGMENTS), 0.55).otherwise(1.0))


def components(pairs: DataFrame) -> DataFrame:
    """Adds what the confidence is made of; pairs have name, qf, qnorm and a known surface."""
    qf, tf = F.col("qf"), F.col("tf")
    shared = F.array_intersect(qf, tf)
    ends = lambda at: F.get(qf, at(qf)) == F.get(tf, at(tf))
    first, last = (lambda f: F.lit(0)), (lambda f: F.size(f) - 1)
    alike = lambda at: F.length(F.get(qf, at(qf))) == F.length(F.get(tf, at(tf)))
    add = lambda c, p: F.when(c, p).otherwise(0.0)
    shape = T.round4(F.least(F.lit(1.0), add(F.size(qf) == F.size(tf), 0.45) + add(T.surface_shape("name") == T.surface_shape("known"), 0.35) + add(alike(last), 0.10) + add(alike(first), 0.10)))
    return pairs.withColumns({
        "shared": shared, "weighted_jaccard": _weight(shared) / F.greatest(_weight(F.array_union(qf, tf)), F.lit(1.0)), "raw_jaccard": F.size(shared) / F.greatest(F.size(F.array_union(qf, tf)), F.lit(1)),
        "same_prefix": ends(first), "same_suffix": ends(last), "related": related_pairs(qf, tf), "shape_score": shape,
    })


def confidence(df: DataFrame) -> DataFrame:
    """Adds edit_similarity, weak_bridge, confidence and reasons."""
    df = df.withColumn("edit_similarity", sequence_ratio("qnorm", "tnorm"))
    weak = (F.size("related") == 0) & (F.size("shared") == 1) & T.one_of(F.get("shared", F.lit(0)), WEAK_BRIDGES) & (F.col("edit_similarity") < 0.78)
    add = lambda c, p: F.when(c, p).otherwise(0.0)
    total = 0.34 * F.col("weighted_jaccard") + 0.18 * F.col("raw_jaccard") + 0.24 * F.col("edit_similarity") + add(F.col("same_prefix"), 0.08) + add(F.col("same_suffix"), 0.10) + 0.08 * F.col("shape_score") + F.least(F.lit(0.25), F.size("related") * 0.125)
    said = [(F.size("shared") > 0, "shared_fragment"), (F.col("same_prefix"), "same_prefix"), (F.col("same_suffix"), "same_suffix"), (F.col("edit_similarity") >= 0.58, "edit_similarity"), (F.col("shape_score") >= 0.6, "code_shape"), (F.size("related") > 0, "related_fragment"), (F.col("weak_bridge"), "weak_lexical_bridge")]
    df = df.withColumn("weak_bridge", weak)
    df = df.withColumn("confidence", T.round4(T.unit(total - add(F.col("weak_bridge"), 0.14))))
    return df.withColumn("reasons", F.filter(F.array(*[F.when(c, r) for c, r in said]), lambda x: x.isNotNull())).where(F.size("reasons") > 0)


def escalation(df: DataFrame, band: tuple[float, float] = NEAR_MISS_BAND) -> DataFrame:
    """Adds escalation_reasons and escalate: suggestions that a semantic check should look at."""
    why = [(F.col("confidence").between(*band), "confidence_band"), (F.col("weak_bridge"), "weak_lexical_bridge"), ((F.size("shared") == 1) & (F.size("related") == 0), "single_shared_fragment"), (F.size("related") > 0, "related_fragment_bridge")]
    out = df.withColumn("escalation_reasons", F.filter(F.array(*[F.when(c, r) for c, r in why]), lambda x: x.isNotNull()))
    return out.withColumn("escalate", F.size("escalation_reasons") > 0)


def pairs(names: DataFrame, known: DataFrame, min_confidence: float) -> DataFrame:
    """Names (name, and requested scopes if given) with the known surfaces that can reach the confidence."""
    req = F.col("requested") if "requested" in names.columns else F.lit(None).cast("array<string>")
    q = names.select("name", req.alias("requested")).distinct().withColumns({"qf": T.fragments("name"), "qnorm": T.normalized_fragments("name")}).where(F.size("qf") >= 2)
    ok = T.scope_matches(F.col("scopes"), F.col("requested"))
    if min_confidence <= NEAR_MISS_UNBRIDGED:
        # every pair may count: the vocabulary is the small side, and its size is checked
        return q.join(small(known), ok, "inner")
    reach = F.array_distinct(F.concat("qf", F.flatten(F.transform("qf", lambda f: F.coalesce(F.element_at(related_map(), f), F.array().cast("array<string>"))))))
    keyed = q.select("*", F.explode(reach).alias("f"))
    by = known.select("*", F.explode(F.array_distinct("tf")).alias("f"))
    return keyed.join(small(by), "f").where(ok).drop("f").distinct()


def suggest(names: DataFrame, v: Vocabulary, include_deprecated: bool = False, most: int = 3, min_confidence: float = NEAR_MISS_CONFIDENCE) -> DataFrame:
    """The best suggestions for each name: name, rank, term_id, canonical, known, confidence, reasons, ..."""
    scored = confidence(components(pairs(names, known_surfaces(v, include_deprecated), min_confidence))).where(F.col("confidence") >= min_confidence)
    order = [F.desc("confidence"), "term_id", "known"]
    key = ["name", "requested"]
    one = scored.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "term_id").orderBy(*order))).where("_r = 1")
    best = one.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= most)
    return escalation(best.drop("_r"))


def rerank(suggestions: DataFrame, vectors: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Escalated suggestions ordered by the cosine of name and target vectors (key, embedding); others keep -1."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    a = vectors.select(F.col("key").alias("name"), F.col("embedding").alias("va"))
    b = vectors.select(F.col("key").alias("canonical"), F.col("embedding").alias("vb"))
    j = suggestions.join(a, "name", "left").join(b, "canonical", "left")
    norm = F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))
    cosine = F.when(F.col("escalate") & (norm > 0), dot("va", "vb") / norm)
    out = j.withColumn("semantic", F.coalesce(cosine, F.lit(-1.0))).drop("va", "vb").where(~F.col("escalate") | (F.col("semantic") >= threshold) | F.col("semantic").eqNullSafe(-1.0))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("name", "requested").orderBy(F.desc("semantic"), "rank")))


def rerank_with(suggestions: DataFrame, load, threshold: float = 0.35) -> DataFrame:
    """rerank with vectors of a pluggable encoder. load gives a function from a list of texts to vectors; it runs once
    for each task, and only names and targets of escalated suggestions are encoded, each once."""
    asked = suggestions.where("escalate")
    keys = asked.select(F.col("name").alias("key")).unionByName(asked.select(F.col("canonical").alias("key"))).distinct()

    def run(batches):
        encode = load()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "embedding": [list(map(float, v)) for v in encode(list(b["key"]))]})

    return rerank(suggestions, keys.mapInPandas(run, "key string, embedding array<double>"), threshold)
