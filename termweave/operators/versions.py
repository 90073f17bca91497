"""Versions of a vocabulary: differences, three-way merges and migrations of deprecated terms.

All compare tables by key with outer joins; nothing but the reports' final order is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators.nearmiss import sequence_ratio
from termweave.operators.resolve import small
from termweave.operators.tables import written
from termweave.sources.vocabulary import REPLACEMENT_KEYS, Vocabulary

TERM_FIELDS = ("canonical", "description", "scopes", "tags", "deprecated", "metadata")
ALIAS_FIELDS = ("scopes", "case_sensitive", "deprecated", "metadata")
SCOPE_FIELDS = ("label", "description", "parents", "metadata")
EVIDENCE_FIELDS = ("evidence_ord", "source_path", "snippet", "kind", "start_line", "end_line", "source_id", "metadata")
PROPOSAL_FIELDS = ("kind", "surface", "status", "candidate_term_id", "target_term_id", "confidence", "risk", "scopes", "rationale", "metadata")


def _as_json(field: str, df: DataFrame) -> Column:
    """A field's value as JSON text, so that values of all types compare and show alike."""
    if field == "metadata":
        return F.coalesce(field, F.lit("{}"))
    if df.schema[field].dataType.typeName() == "array":
        return F.to_json(F.coalesce(field, F.array().cast(df.schema[field].dataType)))
    if df.schema[field].dataType.typeName() == "string":
        return F.when(F.col(field).isNotNull(), F.concat(F.lit('"'), F.regexp_replace(field, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.col(field).cast("string")


def objects(kind: str, df: DataFrame, key: Column, parent: Column, fields: tuple[str, ...]) -> DataFrame:
    """object_kind, object_id, parent, fields (name to JSON text) of the rows of a table."""
    entries = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(_as_json(f, df), F.lit("null")) for f in fields])) if fields else F.create_map().cast("map<string,string>")
    return df.select(F.lit(kind).alias("object_kind"), key.alias("object_id"), parent.alias("parent"), entries.alias("fields"))


def _under(a: str, b: str) -> Column:
    return F.concat(F.col(a), F.lit(":"), F.col(b))


def _evidence_key() -> Column:
    """What tells one piece of evidence of an owner from another."""
    parts = ("source_path", "start_line", "end_line", "kind", "snippet")
    return F.array_join(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), "|")


def vocabulary_objects(v: Vocabulary) -> DataFrame:
    """Everything that a difference is about."""
    none = F.lit(None).cast("string")
    evidence = v.evidence.withColumn("ev", _evidence_key())
    tools = v.terms.select("term_id", F.explode(F.array_distinct("tools")).alias("tool"))
    all_ = [
        objects("scope", v.scopes, F.col("scope_id"), none, SCOPE_FIELDS),
        objects("term", v.terms, F.col("term_id"), none, TERM_FIELDS),
        objects("alias", v.aliases.dropDuplicates(["term_id", "surface"]), _under("term_id", "surface"), F.concat(F.lit("term:"), F.col("term_id")), ALIAS_FIELDS),
        objects("tool", tools, _under("term_id", "tool"), F.concat(F.lit("term:"), F.col("term_id")), ()),
        objects("evidence", evidence.dropDuplicates(["owner_kind", "owner_id", "ev"]), _under("owner_id", "ev"), _under("owner_kind", "owner_id"), ()),
        objects("proposal", v.proposals, F.col("proposal_id"), none, PROPOSAL_FIELDS),
    ]
    return reduce(DataFrame.unionByName, all_)


def diff(before: Vocabulary, after: Vocabulary) -> DataFrame:
    """change (added, removed, changed), object_kind, object_id, field, before, after.

    Parts of a term or proposal (aliases, tools, evidence) are compared where both sides have it.
    """
    a = vocabulary_objects(before).select("object_kind", "object_id", "parent", F.col("fields").alias("b"))
    z = vocabulary_objects(after).select("object_kind", "object_id", "parent", F.col("fields").alias("a"))
    owners = lambda v: v.terms.select(F.concat(F.lit("term:"), F.col("term_id")).alias("parent")).unionByName(v.proposals.select(F.concat(F.lit("proposal:"), F.col("proposal_id")).alias("parent")))
    common = owners(before).intersect(owners(after)).withColumn("both", F.lit(True))
    j = a.join(z.withColumnRenamed("parent", "parent_a"), ["object_kind", "object_id"], "full_outer").withColumn("parent", F.coalesce("parent", "parent_a"))
    j = j.join(common, "parent", "left").where(F.col("parent").isNull() | F.col("both"))
    whole = j.where("b IS NULL OR a IS NULL").select(F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"), "object_kind", "object_id", F.lit(None).cast("string").alias("field"), F.to_json("b").alias("before"), F.to_json("a").alias("after"))
    each = j.where("b IS NOT NULL AND a IS NOT NULL").select("object_kind", "object_id", "b", "a", F.explode(F.map_keys("b")).alias("field"))
    each = each.withColumns({"before": F.col("b")[F.col("field")], "after": F.col("a")[F.col("field")]}).where("before <> after")
    return whole.unionByName(each.select(F.lit("changed").alias("change"), "object_kind", "object_id", "field", "before", "after"))


def diff_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("object_kind").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")], F.count("*").alias("total"))


# --- three-way merge -------------------------------------------------------------------------------------------------


def merge_scalar(b: Column, o: Column, t: Column) -> tuple[Column, Column]:
    """The merged value, and whether both sides changed it differently (then the base value stays)."""
    value = F.when(o.eqNullSafe(b), t).when(t.eqNullSafe(b), o).when(o.eqNullSafe(t), o).otherwise(b)
    return value, ~o.eqNullSafe(b) & ~t.eqNullSafe(b) & ~o.eqNullSafe(t)


def merge_sequence(b: Column, o: Column, t: Column) -> Column:
    """What both kept of the base, then what ours added, then what theirs added."""
    none = F.array().cast("array<string>")
    b, o, t = (F.coalesce(x, none) for x in (b, o, t))
    kept = F.filter(b, lambda x: F.array_contains(o, x) & F.array_contains(t, x))
    return F.concat(kept, F.array_except(F.array_union(o, t), b))


def side(b: Column, o: Column, t: Column) -> Column:
    """Which side an object comes from, by the contents of its three versions (null: absent).

    ours, theirs, base, none (gone), merge (changed on both sides), or a conflict.
    """
    return (
        F.when(b.isNull() & o.isNull(), "theirs").when(b.isNull() & t.isNull(), "ours").when(b.isNull() & (o == t), "ours").when(b.isNull(), "conflict: both sides added different objects")
        .when(o.isNull() & t.isNull(), "none").when(o.isNull() & (t == b), "none").when(o.isNull(), "conflict: ours removed object while theirs changed it")
        .when(t.isNull() & (o == b), "none").when(t.isNull(), "conflict: theirs removed object while ours changed it")
        .when((o == b) & (t == b), "base").when(t == b, "ours").when(o == b, "theirs").when(o == t, "ours").otherwise("merge")
    )


def _versions(tables: tuple[DataFrame, DataFrame, DataFrame], keys: list[str], fields: tuple[str, ...], sig: str = "sig") -> DataFrame:
    """Three tables joined by key, their columns as structs b, o, t; side tells what to do."""
    named = [df.select(*keys, F.struct(sig, *fields).alias(n)) for df, n in zip(tables, ("b", "o", "t"), strict=True)]
    j = named[0].join(named[1], keys, "full_outer").join(named[2], keys, "full_outer")
    return j.withColumn("side", side(*(F.col(f"{n}.{sig}") for n in ("b", "o", "t"))))


def _evidence_of(v: Vocabulary, kind: str) -> DataFrame:
    """All evidence of each term or proposal (by its id) as one array."""
    rows = v.evidence.where(F.col("owner_kind") == kind)
    return rows.groupBy(F.col("owner_id").alias(f"{kind}_id")).agg(F.array_sort(F.collect_list(F.struct(*EVIDENCE_FIELDS))).alias("ev"))


def term_versions(v: Vocabulary) -> DataFrame:
    """Terms with a signature of all that belongs to them."""
    al = v.aliases.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("surface", "scopes", "case_sensitive", "deprecated", "metadata"))).alias("al"))
    j = v.terms.join(al, "term_id", "left").join(_evidence_of(v, "term"), "term_id", "left")
    return j.withColumn("sig", F.sha2(F.to_json(F.struct("canonical", "description", "scopes", "tags", "tools", "deprecated", "metadata", "al", "ev")), 256))


def _metadata_entries(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Keys and JSON values of a metadata column."""
    return df.where(F.col(n).isNotNull()).select(*keys, F.explode(F.from_json(F.col(f"{n}.metadata"), "map<string,string>")).alias("mkey", n))


def merge_metadata(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The merged metadata of rows with versions b, o, t, and conflicts by metadata key."""
    b, o, t = (_metadata_entries(rows.select(*keys, n), keys, n) for n in ("b", "o", "t"))
    on = [*keys, "mkey"]
    j = b.join(o, on, "full_outer").join(t, on, "full_outer").withColumn("s", side(F.col("b"), F.col("o"), F.col("t")))
    changed = F.col("s") == "merge"
    j = j.withColumn("reason", F.when(changed, "both sides changed metadata key differently").when(F.col("s").startswith("conflict: both"), "both sides added metadata key differently").when(F.col("s").startswith("conflict: ours"), "ours removed metadata key while theirs changed it").when(F.col("s").startswith("conflict: theirs"), "theirs removed metadata key while ours changed it"))
    value = F.when(F.col("s").isin("base", "merge"), F.col("b")).when(F.col("s") == "ours", F.col("o")).when(F.col("s") == "theirs", F.col("t"))
    merged = j.withColumn("v", value).groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct("mkey", "v")), lambda x: x["v"].isNotNull())))).alias("metadata_merged"))
    return merged, j.where("reason IS NOT NULL").select(*keys, F.concat(F.lit("metadata."), F.col("mkey")).alias("field"), "reason", F.col("b").alias("base"), F.col("o").alias("ours"), F.col("t").alias("theirs"))


def merge_terms(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """The merged terms (with the side that each came from) and conflicts: object_kind, object_id, field, reason, base,
    ours, theirs."""
    fields = ("canonical", "description", "scopes", "tags", "tools", "deprecated", "metadata")
    v = _versions(tuple(term_versions(x) for x in (base, ours, theirs)), ["term_id"], fields)
    meta, meta_conflicts = merge_metadata(v.where("side = 'merge'"), ["term_id"])
    v = v.join(meta, "term_id", "left")
    cols, conflicts = {}, []
    for f in fields:
        b, o, t = (F.col(f"{n}.{f}") for n in ("b", "o", "t"))
        if f in ("scopes", "tags", "tools"):
            merged = merge_sequence(b, o, t)
        elif f == "metadata":
            merged = F.coalesce("metadata_merged", F.lit("{}"))
        else:
            merged, clash = merge_scalar(b, o, t)
            conflicts.append(v.where((F.col("side") == "merge") & clash).select("term_id", F.lit(f).alias("field"), F.lit("both sides changed field differently").alias("reason"), b.cast("string").alias("base"), o.cast("string").alias("ours"), t.cast("string").alias("theirs")))
        cols[f] = F.when(F.col("side") == "merge", merged).when(F.col("side") == "ours", o).when(F.col("side") == "theirs", t).otherwise(b)
    whole = v.where(F.col("side").startswith("conflict")).select("term_id", F.lit(None).cast("string").alias("field"), F.substring("side", 11, 200).alias("reason"), F.to_json("b").alias("base"), F.to_json("o").alias("ours"), F.to_json("t").alias("theirs"))
    found = reduce(DataFrame.unionByName, [whole, *conflicts, meta_conflicts])
    terms = v.where(F.col("side").isin("base", "ours", "theirs", "merge")).select("term_id", "side", *[c.alias(f) for f, c in cols.items()])
    return terms, found.select(F.lit("term").alias("object_kind"), F.col("term_id").alias("object_id"), "field", "reason", "base", "ours", "theirs")


def merge_aliases(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases of the merged terms: those of the term's side, or merged one by one; and their conflicts."""
    sig = lambda v: v.aliases.dropDuplicates(["term_id", "surface"]).withColumn("sig", F.sha2(F.to_json(F.struct("scopes", "case_sensitive", "deprecated", "metadata")), 256))
    v = _versions(tuple(sig(x) for x in (base, ours, theirs)), ["term_id", "surface"], ALIAS_FIELDS).withColumnRenamed("side", "own")
    v = v.join(terms.select("term_id", F.col("side").alias("term_side")), "term_id")
    of_term = F.when(F.col("term_side") == "base", F.when(F.col("b").isNotNull(), "base")).when(F.col("term_side") == "ours", F.when(F.col("o").isNotNull(), "ours")).when(F.col("term_side") == "theirs", F.when(F.col("t").isNotNull(), "theirs")).otherwise(F.col("own"))
    v = v.withColumn("side", of_term).where("side IS NOT NULL AND side <> 'none'")
    keys = ["term_id", "surface"]
    meta, meta_conflicts = merge_metadata(v.where("side = 'merge'"), keys)
    v = v.join(meta, keys, "left")
    cols, conflicts = {}, []
    for f in ALIAS_FIELDS:
        b, o, t = (F.col(f"{n}.{f}") for n in ("b", "o", "t"))
        if f == "scopes":
            merged = merge_sequence(b, o, t)
        elif f == "metadata":
            merged = F.coalesce("metadata_merged", F.lit("{}"))
        else:
            merged, clash = merge_scalar(b, o, t)
            conflicts.append(v.where((F.col("side") == "merge") & clash).select(*keys, F.lit(f).alias("field"), F.lit("both sides changed field differently").alias("reason"), b.cast("string").alias("base"), o.cast("string").alias("ours"), t.cast("string").alias("theirs")))
        cols[f] = F.when(F.col("side") == "merge", merged).when(F.col("side") == "ours", o).when(F.col("side") == "theirs", t).otherwise(b)
    whole = v.where(F.col("side").startswith("conflict")).select(*keys, F.lit(None).cast("string").alias("field"), F.substring("side", 11, 200).alias("reason"), F.to_json("b").alias("base"), F.to_json("o").alias("ours"), F.to_json("t").alias("theirs"))
    found = reduce(DataFrame.unionByName, [whole, *conflicts, meta_conflicts]).select(F.lit("alias").alias("object_kind"), _under("term_id", "surface").alias("object_id"), "field", "reason", "base", "ours", "theirs")
    return v.where(~F.col("side").startswith("conflict")).select(*keys, *[c.alias(f) for f, c in cols.items()]), found


def merge_scopes(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary) -> tuple[DataFrame, DataFrame]:
    sig = lambda v: v.scopes.withColumn("sig", F.sha2(F.to_json(F.struct(*SCOPE_FIELDS)), 256))
    v = _versions(tuple(sig(x) for x in (base, ours, theirs)), ["scope_id"], SCOPE_FIELDS)
    cols, conflicts = {}, []
    for f in SCOPE_FIELDS:
        b, o, t = (F.col(f"{n}.{f}") for n in ("b", "o", "t"))
        merged, clash = (merge_sequence(b, o, t), F.lit(False)) if f == "parents" else merge_scalar(b, o, t)
        conflicts.append(v.where((F.col("side") == "merge") & clash).select("scope_id", F.lit(f).alias("field"), F.lit("both sides changed field differently").alias("reason"), b.cast("string").alias("base"), o.cast("string").alias("ours"), t.cast("string").alias("theirs")))
        cols[f] = F.when(F.col("side") == "merge", merged).when(F.col("side") == "ours", o).when(F.col("side") == "theirs", t).otherwise(b)
    whole = v.where(F.col("side").startswith("conflict")).select("scope_id", F.lit(None).cast("string").alias("field"), F.substring("side", 11, 200).alias("reason"), F.to_json("b").alias("base"), F.to_json("o").alias("ours"), F.to_json("t").alias("theirs"))
    found = reduce(DataFrame.unionByName, [whole, *conflicts]).select(F.lit("scope").alias("object_kind"), F.col("scope_id").alias("object_id"), "field", "reason", "base", "ours", "theirs")
    return v.where(F.col("side").isin("base", "ours", "theirs", "merge")).select("scope_id", *[c.alias(f) for f, c in cols.items()]), found


def merge_evidence(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary, owners: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Evidence of the merged terms or proposals (owners: owner_id, side), and its conflicts.

    An owner taken from one side keeps that side's evidence as it is. Where both sides changed the owner, pieces are merged
    one by one, those of the base first, then ours, then theirs; of pieces with equal keys the last counts.
    """
    def of(v: Vocabulary, side: str) -> DataFrame:
        return v.evidence.where(F.col("owner_kind") == kind).join(owners.where(F.col("side") == side).select("owner_id"), "owner_id", "left_semi")

    def by_key(v: Vocabulary) -> DataFrame:
        last = of(v, "merge").groupBy("owner_id", _evidence_key().alias("ev")).agg(F.max_by(F.struct(*EVIDENCE_FIELDS), "evidence_ord").alias("x")).select("owner_id", "ev", "x.*")
        return last.withColumn("sig", F.sha2(F.to_json(F.struct("source_id", "metadata")), 256))

    whole = reduce(DataFrame.unionByName, [of(v, n) for v, n in ((base, "base"), (ours, "ours"), (theirs, "theirs"))])
    v = _versions(tuple(by_key(x) for x in (base, ours, theirs)), ["owner_id", "ev"], EVIDENCE_FIELDS).where("side <> 'none'")
    found = F.col("side").startswith("conflict") | (F.col("side") == "merge")
    reason = F.when(F.col("side") == "merge", "both sides changed object differently").otherwise(F.substring("side", 11, 200))
    conflicts = v.where(found).select(F.lit("evidence").alias("object_kind"), F.col("ev").alias("object_id"), F.lit(None).cast("string").alias("field"), reason.alias("reason"), F.to_json("b").alias("base"), F.to_json("o").alias("ours"), F.to_json("t").alias("theirs"))
    first = F.when(F.col("b").isNotNull(), 0).when(F.col("o").isNotNull(), 1).otherwise(2)
    order = Window.partitionBy("owner_id").orderBy(first, F.coalesce("b.evidence_ord", "o.evidence_ord", "t.evidence_ord"), "ev")
    x = F.when(F.col("side") == "ours", F.col("o")).when(F.col("side") == "theirs", F.col("t")).otherwise(F.col("b"))
    one = v.where(~found).select("owner_id", x.alias("x"), (F.row_number().over(order) - 1).cast("int").alias("evidence_ord"))
    each = one.select(F.lit(kind).alias("owner_kind"), "owner_id", "evidence_ord", *[f"x.{f}" for f in EVIDENCE_FIELDS[1:]])
    return whole.unionByName(each), conflicts


def merge_proposals(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """The merged proposals (with the side that each came from) and their conflicts."""
    sig = lambda v: v.proposals.join(_evidence_of(v, "proposal"), "proposal_id", "left").withColumn("sig", F.sha2(F.to_json(F.struct(*PROPOSAL_FIELDS, "ev")), 256))
    v = _versions(tuple(sig(x) for x in (base, ours, theirs)), ["proposal_id"], PROPOSAL_FIELDS)
    meta, meta_conflicts = merge_metadata(v.where("side = 'merge'"), ["proposal_id"])
    v = v.join(meta, "proposal_id", "left")
    cols, conflicts = {}, []
    for f in PROPOSAL_FIELDS:
        b, o, t = (F.col(f"{n}.{f}") for n in ("b", "o", "t"))
        if f == "scopes":
            merged = merge_sequence(b, o, t)
        elif f == "metadata":
            merged = F.coalesce("metadata_merged", F.lit("{}"))
        else:
            merged, clash = merge_scalar(b, o, t)
            conflicts.append(v.where((F.col("side") == "merge") & clash).select("proposal_id", F.lit(f).alias("field"), F.lit("both sides changed field differently").alias("reason"), b.cast("string").alias("base"), o.cast("string").alias("ours"), t.cast("string").alias("theirs")))
        cols[f] = F.when(F.col("side") == "merge", merged).when(F.col("side") == "ours", o).when(F.col("side") == "theirs", t).otherwise(b)
    whole = v.where(F.col("side").startswith("conflict")).select("proposal_id", F.lit(None).cast("string").alias("field"), F.substring("side", 11, 200).alias("reason"), F.to_json("b").alias("base"), F.to_json("o").alias("ours"), F.to_json("t").alias("theirs"))
    found = reduce(DataFrame.unionByName, [whole, *conflicts, meta_conflicts]).select(F.lit("proposal").alias("object_kind"), F.col("proposal_id").alias("object_id"), "field", "reason", "base", "ours", "theirs")
    return v.where(F.col("side").isin("base", "ours", "theirs", "merge")).select("proposal_id", "side", *[c.alias(f) for f, c in cols.items()]), found


def merge(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary) -> tuple[Vocabulary, DataFrame]:
    """The whole merged vocabulary, and all conflicts. Its objects are ordered by their ids.

    Terms and proposals are written once, as aliases and evidence are chosen by their sides.
    """
    three = (base, ours, theirs)
    scopes, a = merge_scopes(*three)
    terms, b = merge_terms(*three)
    proposals, d = merge_proposals(*three)
    terms, proposals = written(terms, "terms"), written(proposals, "proposals")
    aliases, c = merge_aliases(*three, terms)
    of_terms, e = merge_evidence(*three, terms.select(F.col("term_id").alias("owner_id"), "side"), "term")
    of_proposals, f = merge_evidence(*three, proposals.select(F.col("proposal_id").alias("owner_id"), "side"), "proposal")
    replaced = F.coalesce(*[F.nullif(F.trim(F.get_json_object("metadata", f"$.{k}")), F.lit("")) for k in REPLACEMENT_KEYS])
    zero = F.lit(0)
    merged = Vocabulary(
        scopes.withColumn("scope_ord", zero), terms.withColumns({"term_ord": zero, "replacement_id": replaced}), aliases.withColumns({"term_ord": zero, "alias_ord": zero}),
        of_terms.unionByName(of_proposals), proposals.withColumn("proposal_ord", zero),
    )
    return merged, reduce(DataFrame.unionByName, [a, b, c, d, e, f])


def rename_warnings(base: Vocabulary, ours: Vocabulary, theirs: Vocabulary) -> DataFrame:
    """Terms renamed on one side while the other changed something else: object_id, base, ours, theirs names."""
    def with_rest(v):
        full = term_versions(v)
        return full.withColumn("rest", F.sha2(F.to_json(F.struct("description", "scopes", "tags", "tools", "deprecated", "metadata", "al", "ev")), 256))

    v = _versions(tuple(with_rest(x) for x in (base, ours, theirs)), ["term_id"], ("canonical", "rest")).where("b IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL")
    c = {n: F.col(f"{n}.canonical") for n in "bot"}
    sig, rest = {n: F.col(f"{n}.sig") for n in "bot"}, {n: F.col(f"{n}.rest") for n in "bot"}
    on, tn = c["o"] != c["b"], c["t"] != c["b"]
    other = F.when(on & tn, (c["o"] == c["t"]) & (sig["o"] != sig["t"]) & ((rest["o"] != rest["b"]) | (rest["t"] != rest["b"]))).when(on, rest["t"] != rest["b"]).when(tn, rest["o"] != rest["b"]).otherwise(False)
    return v.where((sig["o"] != sig["b"]) & (sig["t"] != sig["b"]) & other).select(F.lit("canonical_rename_with_parallel_term_change").alias("kind"), F.col("term_id").alias("object_id"), c["b"].alias("base"), c["o"].alias("ours"), c["t"].alias("theirs"))


# --- migrations ------------------------------------------------------------------------------------------------------


def _all_surfaces(v: Vocabulary) -> DataFrame:
    return v.terms.select("term_id", F.col("canonical").alias("surface")).unionByName(v.aliases.select("term_id", "surface"))


def migrations(v: Vocabulary, min_confidence: float = 0.35, most: int = 20) -> DataFrame:
    """Replacements for deprecated terms: declared ones at 0.95, else the most similar active term.

    A declared replacement that is missing or deprecated itself gives none.
    """
    old = v.terms.where("deprecated").select("term_id", "canonical", "scopes", "tags", "replacement_id")
    new = v.terms.where("NOT deprecated").select(F.col("term_id").alias("new_id"), F.col("canonical").alias("new_canonical"), F.col("scopes").alias("new_scopes"), F.col("tags").alias("new_tags"))
    overlap = (F.size("scopes") == 0) | (F.size("new_scopes") == 0) | F.arrays_overlap("scopes", "new_scopes")
    said = old.where("replacement_id IS NOT NULL").join(new, F.col("replacement_id") == F.col("new_id"))
    declared = said.select("term_id", "new_id", "canonical", "new_canonical", F.lit(0.95).alias("confidence"), F.when(overlap, "low").otherwise("medium").alias("risk"), F.lit("explicit_replacement").alias("match_kind"))

    # similarity is largest for some pair of surfaces; a pair without a common token stays under 0.35 by itself,
    # but bonuses can lift it, so every surface of the (small) vocabulary is compared
    left = old.where("replacement_id IS NULL").join(_all_surfaces(v), "term_id")
    right = new.join(_all_surfaces(v).withColumnRenamed("surface", "new_surface").withColumnRenamed("term_id", "new_id"), "new_id")
    sure = F.lit(True) if min_confidence <= 0.5 else F.arrays_overlap(T.tokens("surface"), T.tokens("new_surface"))
    p = left.join(small(right), sure)
    a, b = T.tokens("surface"), T.tokens("new_surface")
    jac = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    p = p.withColumns({"fa": T.casefold("surface"), "fb": T.casefold("new_surface"), "jac": jac}).where((F.size(a) > 0) & (F.size(b) > 0))
    p = p.withColumn("sim", T.round4(0.65 * F.col("jac") + 0.35 * sequence_ratio("fa", "fb")))
    keys = ["term_id", "new_id", "canonical", "new_canonical", "scopes", "new_scopes", "tags", "new_tags"]
    best = p.groupBy(*keys).agg(F.max("sim").alias("sim"))
    lift = F.when(overlap, 0.10).otherwise(0.0) + F.when(F.arrays_overlap("tags", "new_tags"), 0.05).otherwise(0.0)
    scored = best.withColumns({"confidence": T.round4(F.least(F.lit(1.0), F.col("sim") + lift)), "risk": F.when(overlap, "medium").otherwise("high")})
    one = scored.groupBy("term_id", "canonical").agg(F.min_by(F.struct("new_id", "new_canonical", "confidence", "risk"), F.struct(-F.col("confidence"), "new_id")).alias("x")).where(F.col("x.confidence") >= min_confidence)
    similar = one.select("term_id", "x.new_id", "canonical", "x.new_canonical", "x.confidence", "x.risk", F.lit("surface_similarity").alias("match_kind"))
    return declared.unionByName(similar).orderBy(F.desc("confidence"), "term_id", "new_id").limit(most)
