"""Personal data by patterns, and information-theoretic sanitisation of the terms that reveal it.

Base spans come from four patterns. What they find is protected at several levels: that a text holds any personal data, the
kind, the value, the domain and the local part of an e-mail address, the network of an ip. A term is a word of at least MIN_LETTERS letters, lower-cased,
outside of e-mail addresses. Counting texts over the whole corpus, N in all, n(e) with the entity, n(t) with the term and
n(t, e) with both, an entity is worth ic(e) = log2(N / n(e)) bits, and whoever sees the term expects it with

    P(e | t) = (n(t, e) + STRENGTH * n(e) / N) / (n(t) + STRENGTH),  so that  pmi(t, e) = log2(P(e | t) * N / n(e))

where STRENGTH texts that only follow the base rate keep few observations from counting as evidence. A term discloses an
entity if it gives away at least half of its bits (pmi >= ic / 2) and leaves at most GENERALISE bits to be known
(ic - pmi = -log2 P). Where at most REMOVE bits are left it is removed wherever it stands, else generalised: replaced by
the kind of entity that it points to. The rule is the same at every size of the corpus; with these values a term needs
eight texts at least. Base spans always stay. Only DataFrame functions are used; texts are never shuffled with words.

Offsets are code points, the end exclusive. Defined results: null and empty texts have no spans; every row counts as a text
of its own, and repeated rows get equal results, also where one doc_id has different texts; a very long text is one set of
words; of entities of which a term tells equally many bits it points to that of the greater kind; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist, with_text

# The patterns of the contract, written so that Java's matcher neither recurses nor tries a run of characters twice:
# a match starts at the beginning of its run or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")

MIN_LETTERS = 4
#: Bits left to be known about an entity, up to which a term is removed or generalised: probabilities of 0.71 and 1/2.
REMOVE, GENERALISE = 0.5, 1.0
#: So many texts at the base rate are added to what was observed of a term.
STRENGTH = 8
#: Terms, entities and texts up to so many are broadcast, after counting them; beyond that the join shuffles.
BROADCAST_TERMS = 200_000
#: Where words are shuffled, each goes to so many places: a common word is no hot task.
SALT = 16
WORD = rf"\p{{L}}{{{MIN_LETTERS},}}"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def step(total, i):
        x = F.substring(d, n - i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0).otherwise(False)


def _small_parts(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


BASE = {
    "email": (EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True)),
    "ip": (IP, lambda t: F.contains(t, F.lit(".")), _small_parts),
    "card": (CARD, lambda t: F.lit(True), _luhn),
    "phone": (PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(8, 15)),
}
SPANS = "array<struct<start:int,end:int,value:string>>"


def base_spans(texts: DataFrame) -> DataFrame:
    """Adds a column of (start, end, value) for each kind: leftmost matches that pass their test."""
    cols = {}
    for kind, (pattern, maybe, _) in BASE.items():
        can = maybe(F.col("text"))
        cols[f"_m_{kind}"] = F.when(can, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = texts.withColumns(cols)
    # what stands between the matches gives their places
    gaps = {f"_p_{kind}": F.when(F.size(f"_m_{kind}") > 0, F.transform(F.split("text", pattern, -1), lambda s: F.length(s))).otherwise(F.array().cast("array<int>")) for kind, (pattern, _, _) in BASE.items()}
    out = out.withColumns(gaps)
    return out.withColumns({kind: _placed(F.col(f"_m_{kind}"), F.col(f"_p_{kind}"), passes) for kind, (_, _, passes) in BASE.items()}).drop(*cols, *gaps)


def _placed(matches: Column, gaps: Column, passes) -> Column:
    """Places of the matches that pass, from the lengths of matches and of what stands between them."""

    def step(acc, i):
        start, value = acc["at"] + F.get(gaps, i), F.get(matches, i)
        end = start + F.length(value)
        more = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), value.alias("value"))))
        return F.struct(end.alias("at"), F.when(passes(value), more).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, step)["out"]).otherwise(none)


def _entities(kind: str) -> Column:
    """What the spans of a kind protect, at all levels."""

    def levels(v: Column) -> Column:
        low = F.lower(v)
        parts = {"kind": F.lit(""), "value": low}
        if kind == "email":
            parts |= {"domain": F.substring_index(low, "@", -1), "local": F.substring_index(low, "@", 1)}
        elif kind == "ip":
            parts["network"] = F.substring_index(low, ".", 3)
        any_ = F.struct(F.lit("any").alias("kind"), F.lit("kind").alias("level"), F.lit("").alias("value"))
        return F.array(any_, *[F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), x.alias("value")) for level, x in parts.items()])

    return F.flatten(F.transform(kind, lambda s: levels(s["value"])))


def _words(text: Column) -> Column:
    """The terms of a text, once each."""
    outside = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit(WORD), F.lit(0)))


def _side(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table to join with, and whether it is broadcast: where a count shows that it is small."""
    few = df.count() <= BROADCAST_TERMS
    return (F.broadcast(df) if few else df), few


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The given terms with n_t: the number of texts that hold them.

    All words are counted (partly before the shuffle) and then looked up: the work grows with the texts alone, where
    joining every word with the terms would grow with both.
    """
    each = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    return each.join(_side(terms)[0], "term")


def _posterior(n_both: Column, n_t: Column, n_e: Column, total: int) -> Column:
    return (n_both + STRENGTH * n_e / total) / (n_t + STRENGTH)


def disclosing(near: DataFrame, texts: DataFrame, total: int, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """term, kind ("removed" or "generalised"), points_to (the kind of the entity of which it tells the
    most bits). near: entities and words of the texts that have entities."""
    least, total = 2.0**-generalise, max(total, 1)
    n_e = near.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    # an entity that isn't found often enough to be learnt can't be disclosed, by any term
    n_e = persist(n_e.where(_posterior(F.col("n_e"), F.col("n_e"), F.col("n_e"), total) >= least), "entities")
    most = n_e.agg(F.max("n_e")).first()[0] or 0
    # neither can a term that stands elsewhere too often, whatever the entity: n(t, e) is at most n_near
    bound = lambda n_t: _posterior(F.col("n_near"), n_t, F.lit(most), total) >= least
    n_near = near.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    likely = persist(n_near.where((F.lit(most) > 0) & bound(F.col("n_near"))), "terms")
    terms = persist(term_counts(texts, likely).where(bound(F.col("n_t"))).select("term", "n_t"), "terms")
    pairs = near.select("entities", F.explode("words").alias("term")).join(_side(terms)[0], "term").select("term", "n_t", F.explode("entities").alias("e"))
    pairs = pairs.join(_side(n_e)[0], "e").groupBy("term", "e", "n_t", "n_e").agg(F.count("*").alias("n_te"))
    p = pairs.withColumn("ic", F.log2(F.lit(float(total)) / F.col("n_e"))).withColumn("left", -F.log2(_posterior(F.col("n_te"), F.col("n_t"), F.col("n_e"), total)))
    told = p.where((F.col("left") <= generalise) & (F.col("ic") > 0) & (F.col("ic") - F.col("left") >= F.col("ic") / 2))
    best = told.groupBy("term").agg(F.min("left").alias("left"), F.max(F.struct(F.round(F.col("ic") - F.col("left"), 9).alias("pmi"), F.col("e.kind").alias("kind"))).alias("x"))
    return best.select("term", F.when(F.col("left") <= remove, "removed").otherwise("generalised").alias("kind"), F.col("x.kind").alias("points_to"))


def texts_with(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, h and the flagged terms of every text that holds some. texts: doc_id, h, text."""
    each = texts.select("doc_id", "h", F.explode(_words(F.col("text"))).alias("term"))
    side, few = _side(terms)
    if not few:
        each = each.withColumn("salt", F.pmod("h", F.lit(SALT)).cast("int"))
        side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hit = each.join(side, ["term"] if few else ["term", "salt"]).select("doc_id", "h", F.struct("term", "kind", "points_to").alias("t"))
    return hit.groupBy("doc_id", "h").agg(F.collect_set("t").alias("terms"))


def term_places(texts: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, h, kind and s (start, end, points_to as value): where the flagged terms stand. A text is split once, by all
    terms that it holds."""
    side, _ = _side(found.withColumnsRenamed({"doc_id": "_id", "h": "_h"}))
    own = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    any_term = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    own = own.select("doc_id", "h", "text", "terms", any_term.alias("pattern"))
    cut = own.withColumns({"m": F.expr("regexp_extract_all(text, pattern, 0)"), "g": F.expr("transform(split(text, pattern, -1), s -> length(s))")})
    each = cut.select("doc_id", "h", "terms", F.explode(_placed(F.col("m"), F.col("g"), lambda m: F.lit(True))).alias("s"))
    each = each.withColumn("t", F.get(F.filter("terms", lambda t: t["term"] == F.lower(F.col("s.value"))), F.lit(0))).where(F.col("t").isNotNull())
    return each.select("doc_id", "h", "t.kind", F.struct("s.start", "s.end", F.col("t.points_to").alias("value")).alias("s"))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def find_personal_data(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a column of spans for each kind in KINDS and TERM_KINDS, base_spans and spans as strings, for every row."""
    texts = with_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    any_span = F.size(F.concat(*KINDS)) > 0
    based = base_spans(texts).withColumn("words", F.when(any_span, _words(F.col("text"))))
    based = persist(based.select("doc_id", "h", *KINDS, "words"), "base-spans")
    near = based.where(F.col("words").isNotNull()).select(F.array_distinct(F.concat(*[_entities(k) for k in KINDS])).alias("entities"), "words")
    flagged = persist(disclosing(near, texts, based.count(), remove, generalise), "flagged")
    places = term_places(texts, persist(texts_with(texts, flagged), "texts-with-terms"))
    of_kind = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("s")))).alias(k)
    hits = places.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(*[of_kind(k) for k in TERM_KINDS])
    found = based.drop("words").join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    outside = lambda k: F.filter(k, lambda s: ~F.exists("email", lambda e: (s["start"] < e["end"]) & (s["end"] > e["start"])))
    found = found.withColumns({k: F.coalesce(outside(k), F.array().cast(SPANS)) for k in TERM_KINDS})
    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])
    every = F.concat(base, *[_joined(k, F.col(k)) for k in TERM_KINDS])
    return found.select("doc_id", *KINDS, *TERM_KINDS, F.array_join(base, ",").alias("base_spans"), F.array_join(every, ",").alias("spans"))


def _replaced(kind: str) -> Column:
    """The spans of a kind with what stands in their place."""

    def one(s):
        by = F.lit("") if kind == "removed" else F.upper(F.concat(F.lit("["), s["value"], F.lit("]"))) if kind == "generalised" else F.lit(f"[{kind.upper()}]")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))

    return F.transform(kind, one)


def sanitise(text: Column, *kinds: str) -> Column:
    """The text with the spans of these columns replaced: [KIND] for entities and generalised terms, nothing for removed.

    Of overlapping spans the one that starts first is replaced.
    """
    every = F.array_sort(F.flatten(F.array(*[_replaced(k) for k in kinds])))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        free = s["start"] >= acc["at"]
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, put).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
