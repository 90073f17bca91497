"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Every window of SPAN tokens is hashed once for each mask; a mask ignores fixed positions, so that a window with another
token there still meets its original. Hashes of benchmark and documents are joined; each hit gives a shift at which an item
lies over a document. Around each distinct shift the two texts are compared token by token: +1 for equal tokens, -2 for
others, the best stretch counts. A document is contaminated by an item if that score reaches NEED, or 0.7 of the item's
tokens where that is less (items of up to 17 tokens). Items of fewer than SPAN tokens have no window: they must stand in the
document whole, found by a hash of all their tokens; those of fewer than SHORTEST tokens are words rather than questions
and match nothing.

Tokens are runs of letters and numbers, lower-cased. Defined results: null and empty texts match nothing; items of equal
tokens are one item, named by the smallest item_id; repeated rows of a document count once, and where one doc_id has
different texts a match of any of them counts; ties between places of equal score go to the earliest; a very long text is
one array of token hashes; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist

#: 1: the token counts, 0: any token may stand there.
MASKS = ("11011011101", "10110111011", "11100011111")
SPAN, NEED, SHORTEST = 11, 12, 3
#: Benchmark hashes are broadcast up to so many rows and tokens, after counting them; beyond that the join shuffles.
BROADCAST_ROWS, BROADCAST_TOKENS = 400_000, 2_000_000
#: Hits up to so many are broadcast, after counting them.
BROADCAST_PAIRS = 200_000
#: Where windows are shuffled, each key goes to so many places: a passage that many documents share is no hot task.
SALT = 32


def token_hashes(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed_keys(hashes: Column, at: Column) -> Column:
    """For each mask the hash of the tokens that it selects from the window at this place."""
    return F.array(*[F.xxhash64(F.lit(m), *[F.get(hashes, at + k) for k, x in enumerate(mask) if x == "1"]) for m, mask in enumerate(MASKS)])


def seeds(df: DataFrame) -> DataFrame:
    """Adds at and key: every window and mask of the column h."""
    windows = df.where(F.size("h") >= SPAN).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - SPAN)))
    return windows.withColumn("key", F.explode(seed_keys(F.col("h"), F.col("at"))))


def short_keys(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds at and key: every window of the given lengths of the column h, hashed whole."""
    each = df.withColumn("n", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.size("h") >= F.col("n"))
    windows = each.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("n"))))
    return windows.withColumn("key", F.xxhash64(F.lit("short"), F.slice("h", F.col("at") + 1, F.col("n")))).drop("n")


def _overlap(h: Column, b: Column, shift: Column) -> Column:
    """Best stretch of the item laid over the document at this shift: its score, end and length in tokens."""
    lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size(b), F.size(h) - shift) - 1
    zero = F.struct(*[F.lit(0).alias(n) for n in ("run", "len", "best", "end", "long")])

    def step(acc, k):
        gain = F.when(F.get(h, shift + k) == F.get(b, k), F.lit(1)).otherwise(F.lit(-2))
        run = F.greatest(acc["run"] + gain, F.lit(0))
        length = F.when(run == 0, F.lit(0)).otherwise(acc["len"] + 1)
        better = run > acc["best"]
        return F.struct(run.alias("run"), length.alias("len"), F.greatest(run, acc["best"]).alias("best"), F.when(better, shift + k + 1).otherwise(acc["end"]).alias("end"), F.when(better, length).otherwise(acc["long"]).alias("long"))

    return F.aggregate(F.sequence(lo, hi), zero, step)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, score, start, end (tokens)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), token_hashes(F.col(item_text)).alias("b")).where(F.size("b") >= SHORTEST)
    items = items.groupBy(F.md5(F.array_join("b", ",")).alias("same")).agg(F.min("item_id").alias("item_id"), F.min_by("b", "item_id").alias("b")).drop("same")
    items = persist(items, "items")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), token_hashes(F.col(text_col)).alias("h"))
    own, found = seeds(items.select("item_id", F.col("b").alias("h"))), seeds(texts)
    lengths = [r.n for r in items.where(F.size("b") < SPAN).select(F.size("b").alias("n")).distinct().collect()]
    if lengths:
        short = items.where(F.size("b") < SPAN).select("item_id", F.col("b").alias("h"), F.lit(0).alias("at"), F.xxhash64(F.lit("short"), "b").alias("key"))
        own, found = own.unionByName(short), found.unionByName(short_keys(texts, lengths))
    keys = persist(own.groupBy("item_id", "key").agg(F.min("at").alias("j")), "keys")
    found = found.select("doc_id", "text_hash", "at", "key")
    n_keys, tokens = keys.count(), items.agg(F.sum(F.size("b"))).first()[0] or 0
    if n_keys <= BROADCAST_ROWS:
        met = found.join(F.broadcast(keys), "key")
    else:
        spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = found.withColumn("salt", F.pmod("text_hash", F.lit(SALT)).cast("int")).join(spread, ["key", "salt"])
    hits = persist(met.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("j")).alias("shift")).distinct(), "hits")
    # only documents with a hit are read again; their tokens are compared once for each item and shift
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    that = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    grouped = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("item_id", "shift")).alias("at"))
    grouped = F.broadcast(grouped) if hits.count() <= BROADCAST_PAIRS else grouped
    again = raw.join(grouped, that).select("doc_id", token_hashes(F.col("text")).alias("h"), "at").select("doc_id", "h", F.explode("at").alias("x")).select("doc_id", "h", "x.*")
    again = again.join(F.broadcast(items) if tokens <= BROADCAST_TOKENS else items, "item_id")
    o = again.withColumn("o", _overlap(F.col("h"), F.col("b"), F.col("shift")))
    need = F.when(F.size("b") < SPAN, F.size("b")).otherwise(F.least(F.lit(NEED), F.ceil(F.size("b") * 0.7)))
    good = o.where(F.col("o.best") >= need).select("doc_id", "item_id", F.struct(F.col("o.best").alias("score"), (-F.col("o.end")).alias("last"), F.col("o.long").alias("long")).alias("x"))
    best = good.groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", F.col("x.score").alias("score"), (-F.col("x.last") - F.col("x.long")).alias("start"), (-F.col("x.last")).alias("end"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without the contaminated ones, all columns kept."""
    bad = persist(find_leaks(docs, benchmark, id_col=id_col).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_PAIRS else bad
    return docs.join(side, docs[id_col].eqNullSafe(side["_leak"]), "left_anti")
