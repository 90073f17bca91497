"""Best-fit packing of documents into token sequences, certified by lower bounds.

Every partition is packed by best-fit decreasing. Dual feasible functions give a lower bound on the number of bins that
any packing of the same pieces needs. Where the two agree, the partition is certified and final. Other partitions keep
their (nearly) full bins and give the pieces of their looser bins to an exchange: these are dealt anew over fewer
partitions and packed again, until every bin is certified, one partition is left, or an exchange saves nothing.

Defined results: null text counts as empty; with the end id an empty document has one token; only documents longer than
a sequence are cut, the last piece may be shorter; a very long text is encoded whole and becomes as many rows as it has
pieces; repeated rows are packed once each; pieces of equal length are taken by doc_id and piece; an empty table packs to
nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import codec, kind_of
from .common import column_of, persist, slices, with_text

CAPACITY = 2048
#: Pieces for each partition: enough for bins to fill well, few enough for one task.
PIECES = 20_000
#: Bins of a partition with a gap that have at most this share free are kept.
TIGHT = 1 / 512
ROUNDS = 8
#: Pre-tokens that a worker keeps; it keeps them while later stages run, too.
CACHED = 300_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, cut only where longer than a sequence."""
    kind = kind_of(tokenizer)

    def run(batches):
        c = codec(tokenizer, kind, "ids", CACHED)
        for b in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for d, a in zip(column_of(b, "doc_id").to_pylist(), c.ids(column_of(b, "text").to_pylist()), strict=True):
                ids = np.append(a, end_id).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for col, x in zip(rows, (d, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit over lengths in the given (decreasing) order: bin and offset of each, and what is free in each bin.

    Open bins are kept by free space; a bit set finds the tightest one that fits.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = mask >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            k = by_free[f].pop()
            if not by_free[f]:
                mask ^= 1 << f
        else:
            f, k = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = k, capacity - f
        free[k] = f = f - n
        if f:
            by_free[f].append(k)
            mask |= 1 << f
    return bins, offsets, np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 64) -> int:
    """The best bound on the number of bins that these dual feasible functions certify.

    - the identity: total length over capacity
    - for each e up to half: lengths over capacity - e count as whole, those under e as nothing
    - for k = 1, 2, ...: u_k(x) = x where (k+1)x is whole, else floor((k+1)x) / k
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(total[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, steps + 1):
        exact, floors = (k + 1) * size % capacity == 0, (k + 1) * size // capacity
        worth = np.where(exact, size * k, floors * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((worth * count).sum()) // (k * capacity)))
    return best


def _round(items: DataFrame, partitions: int, number: int, capacity: int) -> DataFrame:
    """One round: sequence_id and offset, done (final or not), and each partition's bins and bound."""

    def run(batches):
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        doc, piece, length = (t.column(c).to_numpy() for c in ("doc_id", "piece", "length"))
        order = np.lexsort((piece, doc, -length))
        bins, offsets, free = best_fit(length[order], capacity)
        bound = lower_bound(length, capacity)
        final = (free <= capacity * TIGHT) | (bound == len(free))
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        t = t.take(pa.array(order))
        for name, x in (("sequence_id", base + bins), ("offset", offsets), ("done", final[bins]), ("bins", np.full(len(bins), len(free))), ("bound", np.full(len(bins), bound)), ("first", offsets == 0)):
            t = t.append_column(name, pa.array(x))
        yield from t.to_batches(50_000)

    # dealt by place in the written table: rows without doc_id or with the same one are spread like all others
    placed = items.withColumn("_place", F.xxhash64(F.monotonically_increasing_id(), F.lit(number)))
    keyed = placed.repartition(partitions, "_place")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return keyed.select(*kept).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean, bins long, bound long, first boolean")


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to doc_id, piece, start, length, ids_crc32."""
    n, out, before = items.count(), None, None
    for number in range(rounds):
        partitions = max(1, -(-n // per_partition))
        packed = persist(_round(items, partitions, number, capacity), f"packing-{number}")
        loose, open_bins, used = packed.agg(F.count_if(~F.col("done")), F.count_if(~F.col("done") & F.col("first")), F.count_if("first")).first()
        saved = before is None or used < before  # before: the bins from which these pieces came
        last = partitions == 1 or not saved or number == rounds - 1
        final = packed if last or not loose else packed.where("done")
        out = final if out is None else out.unionByName(final)
        if last or not loose:
            break
        items, n, before = packed.where(~F.col("done")), loose, open_bins
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once and packed from there."""
    return pack(persist(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
