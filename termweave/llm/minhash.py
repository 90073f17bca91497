"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. Every document becomes a set of hashed 5-word shingles; documents of equal word sequences form a class, named by its
   smallest doc_id, and only that one goes on.
2. One permutation: a set's hashes fall into BINS bins by their leading bits, the least of each bin is kept. Empty bins
   borrow from bins chosen by a fixed random walk of their own (optimal densification). BANDS bands of ROWS bins make
   buckets; two sets of similarity 0.75 share none with a chance of about 5e-6.
3. In a bucket every member is paired with HUBS hubs only (the least under different orders): a bucket of m members gives
   at most HUBS * m star-shaped edges. Pairs whose sizes or 128-bit sketches rule a link out are left away.
4. These pairs are verified on full sets: first the likeliest hub of each member, then those that still lie between
   different components.
5. Buckets that then still hold several components can hide links between members that are no hubs. They are solved
   exactly: the members outside the bucket's largest component are compared with all members of other components, in
   blocks, by one product of 0/1 matrices for each pair of blocks. Only links that join components leave a block, so that
   no pairs are emitted. The work grows with the members outside the largest component times all members.
6. Components are found by large-star / small-star steps over written tables.

So every two documents that share a bucket and aren't linked through others were compared, by sketch or in full.
Verification streams a hub's set and blocks of at most BLOCK members, so that a hub with many members is no hot task.

Defined results: null, empty and blank texts have the empty set and link with nothing; fewer than five words make one
shingle; a very long text is one set of as many hashes as it has shingles, held by one task at a time; repeated rows of a
doc_id come back as often as they were, with one component, and where their texts differ a link of any of them is a link
of the doc_id; a row without doc_id takes the component of its class; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, persist, slices, with_text

SHINGLE, PERCENT = 5, 75
BINS, BANDS, ROWS, HUBS = 128, 32, 4, 3
#: Sketch bits in which a linked pair may differ: expected 16 of 128 at similarity 0.75, deviation 3.7.
SKETCH_DIFFERS = 40
#: Sets of at most so many shingles skip the sketch: it is less sure for them.
SMALL_SET = 24
BLOCK = 64
#: A block of a crowded bucket has about so many members and so many shingles at most, unless one text has more.
CROWD, WEIGHT = 256, 500_000
#: Classes of equal texts with this share of all rows or more are broadcast: at most 1 / HEAVY are.
HEAVY = 1 / 2000
#: Ids wanted for verification are broadcast up to so many, after counting; beyond that the join shuffles.
BROADCAST_IDS = 300_000
_U = np.uint64
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    m, s = n - k + 1, np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = _mix(s * _P + h[i : i + m])
    return np.unique(s)


def _walks(bins: int, steps: int = 64) -> np.ndarray:
    """For each bin the bins that it asks in turn when it is empty."""
    return _mix(np.arange(bins * steps, dtype=np.uint64) * _P + _U(7)).reshape(steps, bins) % _U(bins)


def signature(s: np.ndarray, bins: int = BINS, walks: np.ndarray | None = None) -> np.ndarray:
    """The least hash of each bin, empty bins filled by optimal densification; s is sorted and not empty."""
    where = (s >> _U(64 - int(bins).bit_length() + 1)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = where[1:] != where[:-1]
    sig, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    sig[where[first]] = s[first]
    full[where[first]] = True
    if not full.all():
        out, open_ = sig.copy(), np.flatnonzero(~full)
        for step in _walks(bins) if walks is None else walks:
            ask = step[open_].astype(np.int64)
            got = full[ask]
            out[open_[got]] = sig[ask[got]]
            open_ = open_[~got]
            if not len(open_):
                break
        out[open_] = s[0]
        sig = out
    return sig


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket number for each band."""
    x = np.arange(bands, dtype=np.uint64) + _U(1)
    for k in range(rows):
        x = _mix(x * _P + sig[k : bands * rows : rows])
    return x.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each bin, in two 64-bit words."""
    return np.packbits((_mix(sig) & _U(1)).astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (hash of the word sequence), bands, s1, s2 for every row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        walks, none = _walks(BINS), None
        for b in slices(batches):
            n, same, bands, s1, s2 = [], [], [], [], []
            for t in column_of(b, "text").to_pylist():
                w = words_of(t)
                s = shingle_set(w)
                n.append(len(s))
                if not len(s):
                    same.append(none), bands.append(none), s1.append(none), s2.append(none)
                    continue
                sig = signature(s, BINS, walks)
                a, c = sketch(sig).tolist()
                same.append(xxh3_128_digest(b" ".join(w))), bands.append(bands_of(sig)), s1.append(a), s2.append(c)
            cols = [pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())]
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), *cols], ["doc_id", "n_shingles", "same", "bands", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, same binary, bands array<long>, s1 long, s2 long")


def _plausible(a, b):
    """Sizes and sketches of two rows allow a link."""
    lo, hi = F.least(a["n_shingles"], b["n_shingles"]), F.greatest(a["n_shingles"], b["n_shingles"])
    differ = F.bit_count(a["s1"].bitwiseXOR(b["s1"])) + F.bit_count(a["s2"].bitwiseXOR(b["s2"]))
    return (lo * 100 >= hi * PERCENT) & ((hi <= SMALL_SET) | (differ <= SKETCH_DIFFERS)), differ


def star_pairs(members: DataFrame) -> DataFrame:
    """members: bucket, doc_id, n_shingles, s1, s2. Pairs hub < member or member < hub as (u, v), with the sketch distance."""
    me = F.struct("doc_id", "n_shingles", "s1", "s2")
    orders = [F.col("doc_id"), *(F.xxhash64("doc_id", F.lit(k)) for k in range(1, HUBS))]
    hubs = members.groupBy("bucket").agg(F.count("*").alias("size"), *[F.min_by(me, o).alias(f"hub{k}") for k, o in enumerate(orders)])
    hubs = hubs.where(F.col("size") > 1).select("bucket", F.array_distinct(F.array(*[f"hub{k}" for k in range(HUBS)])).alias("hubs"))
    each = members.join(hubs, "bucket").select("doc_id", "n_shingles", "s1", "s2", F.explode("hubs").alias("hub")).where(F.col("hub.doc_id") != F.col("doc_id"))
    mine = {c: F.col(c) for c in ("n_shingles", "s1", "s2")}
    ok, differ = _plausible(mine, F.col("hub"))
    pairs = each.where(ok).select(F.least("doc_id", "hub.doc_id").alias("u"), F.greatest("doc_id", "hub.doc_id").alias("v"), differ.alias("differ"))
    return pairs.groupBy("u", "v").agg(F.min("differ").alias("differ"))


def unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """bucket, doc_id, component, a, b, mine: the members of buckets with several components, dealt to pairs of blocks.

    Members outside the bucket's largest component are the rest, in blocks 0 to rest - 1; the largest component's members
    are the bulk, in the blocks after them. A rest block meets every block, a bulk block every rest block. Buckets of two
    are settled: their only pair was a star's.
    """
    crowd = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 2").select("bucket")
    placed = members.join(crowd, "bucket", "left_semi").join(_side(parts), "doc_id", "left").select("bucket", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    placed = persist(placed, "placed")
    by_part = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    large = F.max(F.struct("n", "component", "w"))
    shape = by_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("w").alias("w"), large.alias("l")).where("parts > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / CROWD), F.ceil(w / WEIGHT))
    one = (F.col("n") <= CROWD) & (F.col("w") <= WEIGHT)  # small buckets are one block
    rest = F.when(one, 1).otherwise(blocks(F.col("n") - F.col("l.n"), F.col("w") - F.col("l.w")))
    bulk = F.when(one, 0).otherwise(blocks(F.col("l.n"), F.col("l.w")))
    shape = persist(shape.select("bucket", rest.cast("int").alias("rest"), bulk.cast("int").alias("bulk"), F.col("l.component").alias("largest")), "shape")
    spread = F.pmod(F.xxhash64("doc_id", "bucket"), F.lit(1 << 30))
    is_bulk = (F.col("bulk") > 0) & (F.col("component") == F.col("largest"))
    dealt = placed.join(_side(shape), "bucket").withColumn("mine", F.when(is_bulk, F.col("rest") + spread % F.greatest("bulk", F.lit(1))).otherwise(spread % F.col("rest")).cast("int"))
    every = F.sequence(F.lit(0), F.col("rest") + F.col("bulk") - 1)
    meets = F.when(F.col("mine") >= F.col("rest"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(every)
    dealt = dealt.select("bucket", "doc_id", "component", "mine", F.explode(meets).alias("other"))
    return dealt.select("bucket", "doc_id", "component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine")


def linked(sets: list[np.ndarray], names: list, sides: list, chunk: int = 4096) -> list[tuple[int, int]]:
    """Places of linked sets of different names that join all names which any such link joins: a forest of the links.

    Where two sides are given, only sets of different sides are compared. The sizes of all intersections come from a
    product of 0/1 matrices, over the hashes that more than one set has.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, column = np.repeat(np.arange(n), size)[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both, width = np.zeros((n, n), np.float32), int((held > 1).sum())
    for lo in range(0, width, chunk):
        p, q = np.searchsorted(column, [lo, lo + chunk])
        x = np.zeros((n, min(chunk, width - lo)), np.float32)
        x[row[p:q], column[p:q] - lo] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    ok = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    name = np.unique(np.array(names, np.int64), return_inverse=True)[1]
    side = np.array(sides)
    ok &= name[:, None] != name[None, :]
    if (side != side[0]).any():
        ok &= side[:, None] != side[None, :]
    out, root = [], list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(ok)))):
        p, q = find(int(name[i])), find(int(name[j]))
        if p != q:
            root[p] = q
            out.append((i, j))
    return out


def links_between(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join components, of the members dealt by `unsettled`. Each text's set is made once, then dealt."""

    def make(batches):
        for b in slices(batches):
            made = [shingle_set(words_of(t)).tobytes() for t in column_of(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(made, pa.binary())], ["doc_id", "set"])

    def run(batches):
        at, group = None, []

        def solve():
            if len(group) > 1:
                docs, names, sides, data = zip(*group, strict=True)
                for i, j in linked([np.frombuffer(x, np.uint64) for x in data], names, sides):
                    yield docs[i], docs[j]

        def batch(found):
            u, v = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in slices(batches):
            found = []
            for bucket, lo, hi, *row in zip(*(column_of(b, c).to_pylist() for c in ("bucket", "a", "b", "doc_id", "component", "mine", "set")), strict=True):
                if at != (bucket, lo, hi):
                    found.extend(solve())
                    at, group = (bucket, lo, hi), []
                group.append(row)
            yield batch(found)
        yield batch(list(solve()))

    wanted = persist(dealt.select("doc_id").distinct(), "wanted")
    sets = persist(texts.join(_side(wanted), "doc_id", "left_semi").mapInArrow(make, "doc_id long, set binary").where(F.octet_length("set") > 0), "sets")
    rows = dealt.join(sets, "doc_id").repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return rows.select("bucket", "a", "b", "doc_id", "component", "mine", "set").mapInArrow(run, "u long, v long").distinct()


def _side(df: DataFrame) -> DataFrame:
    """A table to join with: broadcast where a count shows that it is small, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links on full sets; u is the hub whose set is held, v streams by."""
    size = persist(pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("u", "hub"), "hubs")
    members = pairs.select(F.col("v").alias("doc_id"), F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.lit(1 << 20)).alias("spread")).join(_side(size), "hub")
    members = members.select("doc_id", "hub", (F.col("spread") % F.col("blocks")).alias("block"), F.lit(1).alias("kind"))
    hubs = size.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    wanted = persist(members.unionByName(hubs), "wanted")
    rows = texts.join(_side(wanted), "doc_id").repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")

    def run(batches):
        key, held = None, []
        for b in slices(batches):
            u, v = [], []
            for hub, block, kind, doc, t in zip(*(column_of(b, c).to_pylist() for c in ("hub", "block", "kind", "doc_id", "text")), strict=True):
                if kind == 0:
                    if key != (hub, block):
                        key, held = (hub, block), []
                    held.append(shingle_set(words_of(t)))
                    continue
                s = shingle_set(words_of(t))
                for h in held:
                    both = len(np.intersect1d(h, s, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(h) + len(s) - both):
                        u.append(hub), v.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.select("hub", "block", "kind", "doc_id", "text").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (its smallest doc_id) of all ids in edges (u, v), by alternating large and small stars.

    The least neighbours of a step have at most two rows for each edge: where the count of the edges shows that they are
    few, they are broadcast as they are made, else they are written and counted themselves.
    """
    current = persist(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark, before = _mark(current), None
    while mark[0] and mark != before:
        side = F.broadcast if 2 * mark[0] <= BROADCAST_IDS else lambda df: _side(persist(df, "least"))
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(side(low), "u").select(F.col("m").alias("u"), "v").where("u <> v")
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(side(least), "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v")
        current = persist(small.distinct(), "edges")
        mark, before = _mark(current), mark
    one = current.select(F.col("v").alias("doc_id"), F.col("u").alias("component"))
    return one.unionByName(current.select(F.col("u").alias("doc_id"), F.col("u").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """The count of the edges and a sum that tells whether they changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _placed(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with the components c_u and c_v of their ends."""
    for c in ("u", "v"):
        pairs = pairs.join(_side(parts.select(F.col("doc_id").alias(c), F.col("component").alias(f"c_{c}"))), c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    return pairs


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: only components that the links join are worked on."""
    between = components(_placed(links, parts).select(F.col("c_u").alias("u"), F.col("c_v").alias("v")))
    moved = persist(between.select(F.col("doc_id").alias("was"), F.col("component").alias("now")), "moved")
    old = parts.join(_side(moved), F.col("component") == F.col("was"), "left").select("doc_id", F.coalesce("now", "component").alias("component"))
    fresh = moved.select(F.col("was").alias("doc_id"), F.col("now").alias("component")).join(_side(parts.select("doc_id")), "doc_id", "left_anti")
    return persist(old.unionByName(fresh), "parts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    texts = with_text(docs, id_col, text_col)
    all_rows = persist(describe(texts), "sets")
    classes = all_rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = all_rows.join(classes.select(F.col("rep").alias("doc_id"), "same"), ["doc_id", "same"], "left_semi").dropDuplicates(["doc_id", "same"])
    members = persist(reps.select(F.explode("bands").alias("bucket"), "doc_id", "n_shingles", "s1", "s2"), "buckets")

    pairs = persist(star_pairs(members), "pairs")
    best = persist(pairs.groupBy("v").agg(F.min_by("u", F.struct("differ", "u")).alias("u")).select("u", "v"), "best")
    links = persist(verify(best, texts), "links")
    # rows of one doc_id with different texts: their classes belong together
    several = all_rows.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").select("doc_id")
    several = persist(several, "several")
    if not several.isEmpty():
        of = all_rows.join(_side(several), "doc_id", "left_semi").select("doc_id", "same").distinct().join(classes, "same").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        links = links.unionByName(of.where("u <> v"))
    parts = persist(components(links), "parts")
    left = _placed(pairs, parts).where("c_u <> c_v").select("u", "v").join(_side(best), ["u", "v"], "left_anti")
    parts = _merged(parts, persist(verify(persist(left, "left"), texts), "links"))
    parts = _merged(parts, persist(links_between(persist(unsettled(members, parts), "dealt"), texts), "links"))

    by_rep = parts.withColumnRenamed("doc_id", "rep")
    of_class = persist(classes.join(by_rep, "rep", "left").select("same", "copies", F.coalesce("component", "rep").alias("component")), "classes")
    # a class that holds many rows would be one task's: at most 1 / HEAVY classes hold so many, and they are broadcast
    many = max(HEAVY * (of_class.agg(F.sum("copies")).first()[0] or 0), 64)
    heavy = F.broadcast(of_class.where(F.col("copies") >= many).select("same", "component"))
    rows = all_rows.select("doc_id", "n_shingles", "same")
    light = rows.join(heavy.select("same"), "same", "left_anti").join(of_class.where(F.col("copies") < many).select("same", "component"), "same", "left")
    out = rows.join(heavy, "same").unionByName(light)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
