"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.constants import (
    BACKGROUND_WORDS,
    
    GENERIC_SURFACES,
    IDENTIFIER,
    LINT_BROAD_WORDS,
    LOW_SIGNAL_FRAGMENTS,
    WORD,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_of(c: Column, words) -> Column:
    return c.isin(*words)


def round4(c: Column) -> Column:
    """Half up on the fourth decimal; the same rule in any SQL engine."""
    return F.floor(c * 10000 + 0.5) / 10000


def unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def casefold(c) -> Column:
    """Lower case with the German sharp s written out."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def surface_key(c) -> Column:
    """Trimmed, case-folded, white space collapsed."""
    return F.trim(F.regexp_replace(casefold(c), r"(?U)\s+", " "))


def fragments(c) -> Column:
    """Parts of a name at case boundaries and anything but ASCII letters and digits, lower-cased."""
    spaced = F.regexp_replace(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^A-Za-z0-9]+"), lambda x: x != "")


def code_variants(c) -> Column:
    """The name as identifiers in five styles, where it has two fragments or more; never the name itself."""
    f = fragments(c)
    caps = F.transform(f, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))
    pascal = F.array_join(caps, "")
    camel = F.concat(F.get(f, F.lit(0)), F.array_join(F.slice(caps, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), ""))
    snake = F.array_join(f, "_")
    styles = F.array(camel, pascal, snake, F.upper(snake), F.array_join(f, "-"))
    return F.when(F.size(f) >= 2, F.array_remove(F.array_distinct(styles), F.trim(col(c)))).otherwise(F.array().cast("array<string>"))


def normalized_fragments(c) -> Column:
    """Fragments joined by blanks; the surface key where there are none."""
    f = fragments(c)
    return F.when(F.size(f) > 0, F.array_join(f, " ")).otherwise(surface_key(c))


def singular(c: Column) -> Column:
    return (
        F.when(c.endswith("ies") & (F.length(c) > 4), F.regexp_replace(c, "ies$", "y"))
        .when(c.endswith("s") & ~c.endswith("ss") & (F.length(c) > 3), F.regexp_replace(c, "s$", ""))
        .otherwise(c)
    )


def cluster_key(c) -> Column:
    """Fragments in the singular."""
    f = fragments(c)
    return F.when(F.size(f) > 0, F.array_join(F.transform(f, singular), " ")).otherwise(surface_key(c))


def identifiers(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(IDENTIFIER), F.lit(0))


def backticked(c, longest: int = 80) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"`([^`\\n]{{2,{longest}}})`"), F.lit(1))


def words(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


def clean_surface(c) -> Column:
    """Without quotes and punctuation around it; null where nothing or a web address is left."""
    s = F.btrim(F.trim(col(c)), F.lit("'\".,;:()[]{}"))
    return F.when((s == "") | s.startswith("http://") | s.startswith("https://"), F.lit(None)).otherwise(s)


def tokens(c) -> Column:
    """Runs of ASCII letters and digits of a surface key."""
    return F.filter(F.split(casefold(c), "[^a-z0-9]+"), lambda x: x != "")


def overlap_tokens(c) -> Column:
    """Tokens of three characters or more, split at case boundaries, repeats kept."""
    return F.filter(F.split(F.lower(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2")), "[^A-Za-z0-9]+"), lambda x: F.length(x) >= 3)


def compact(c, longest: int = 220) -> Column:
    """White space collapsed, cut to a length with an ellipsis."""
    s = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.when(F.length(s) <= longest, s).otherwise(F.concat(F.substring(s, 1, longest - 1), F.lit("…")))


def sanitize(c, longest: int | None = None) -> Column:
    """Text that a model may read as data: no control characters, fences or tags."""
    s = F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    for old, new in (("```", "` ` `"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s if longest is None else F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 1), F.lit("…"))).otherwise(s)


def canonical_name(c) -> Column:
    return F.array_join(F.filter(F.split(F.trim(col(c)), "[._-]+"), lambda x: x != ""), " ")


def term_id(c) -> Column:
    """An identifier-shaped surface becomes a dotted id, any other its tokens joined; null where none is left."""
    s = F.trim(col(c))
    joined = F.array_join(tokens(s), "_")
    return F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9]*([._:/-][A-Za-z0-9]+)+$"), F.translate(F.lower(s), "/:-", ".._")).when(joined != "", joined)


def surface_shape(c) -> Column:
    s = col(c)
    return (
        F.when(s.contains("_"), "snake").when(s.contains("-"), "kebab").when(s.contains("."), "dotted")
        .when(s.contains("/") | s.contains(":"), "path").when(s.rlike("[a-z][A-Z]"), "camel")
        .when((F.upper(s) == s) & s.rlike(r"\p{L}"), "upper").when(s.contains(" "), "phrase").otherwise("word")
    )


def surface_kind(c, from_code: bool = True) -> Column:
    s = col(c)
    return F.when(s.rlike("^[A-Z][A-Z0-9]{2,}$"), "acronym").when(s.rlike("[_.:/-]") | s.rlike("[a-z][A-Z]"), "identifier").otherwise("code" if from_code else "phrase")


def unknown_identifiers(c, most: int = 10) -> Column:
    """Names in a text: those in backticks that look like one, then all others; else the whole text if it is one."""
    text = col(c)
    like = lambda s: (F.size(fragments(s)) >= 2) & (s.rlike(IDENTIFIER) | s.rlike("[_.:/-]"))
    quoted = F.filter(F.transform(backticked(text, 120), lambda s: F.trim(s)), like)
    found = F.concat(quoted, identifiers(text))
    whole = F.when(like(F.trim(text)), F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.slice(F.when(F.size(found) > 0, found).otherwise(whole), 1, most))


def low_signal(c) -> Column:
    f = fragments(c)
    return (F.size(f) == 0) | F.exists(f, lambda x: F.length(x) == 1) | F.forall(f, lambda x: one_of(x, LOW_SIGNAL_FRAGMENTS))


def quoted(c) -> Column:
    """A surface as a regular expression for itself."""
    return F.regexp_replace(col(c), r"([^A-Za-z0-9_])", r"\\$1")


def call_like(surface, text) -> Column:
    """Every free-standing occurrence in the text is followed by an opening parenthesis."""
    name = F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted(surface), F.lit("(?![A-Za-z0-9_])"))
    all_ = F.regexp_count(col(text), name)
    return (all_ > 0) & (all_ == F.regexp_count(col(text), F.concat(name, F.lit(r"\s*\("))))


def merge_surface(c) -> Column:
    s = col(c)
    return (F.trim(s) != "") & ~s.rlike(r"(?U)[\s(){}\[\]='\"]")


def rejectable(surface, key) -> Column:
    """Too short or long, too common, or of too many tokens to be a candidate."""
    s, k = col(surface), col(key)
    t = tokens(k)
    return (F.length(s) < 3) | (F.length(s) > 80) | one_of(k, BACKGROUND_WORDS) | (F.size(t) == 0) | ((F.size(t) == 1) & one_of(F.get(t, F.lit(0)), BACKGROUND_WORDS)) | (F.size(t) > 6)


def broad_surface(c) -> Column:
    f = fragments(c)
    return (F.size(f) == 1) & one_of(F.get(f, F.lit(0)), LINT_BROAD_WORDS)


def short_surface(c) -> Column:
    f = fragments(c)
    return (F.size(f) == 1) & (F.length(F.get(f, F.lit(0))) < 3)


def generic_surface(c) -> Column:
    s = F.lower(F.trim(col(c)))
    return (F.length(s) < 3) | one_of(s, GENERIC_SURFACES)


def code_surface(c) -> Column:
    s = col(c)
    return s.rlike("[._-]") | s.rlike("[A-Z][a-z]+[A-Z]") | ((F.upper(s) == s) & s.rlike(r"\p{L}"))


def negative_overlap(n_tokens: Column, n_overlap: Column, first: Column) -> Column:
    """Enough shared tokens to be contrasting evidence."""
    return F.when(n_overlap == 0, False).when(n_tokens == 1, F.length(first) >= 4).otherwise(n_overlap >= F.greatest(F.lit(1), F.least(F.lit(2), n_tokens - 1)))


def scope_matches(entry: Column, requested: Column) -> Column:
    """Nothing requested, an entry without scopes, or a common scope."""
    return requested.isNull() | (F.size(requested) == 0) | (F.size(entry) == 0) | F.arrays_overlap(entry, requested)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
