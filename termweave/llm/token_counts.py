"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens, broadcast once. Tier two is a bounded
cache in each Python worker for all other pre-tokens. Both only save time: every text is split and counted whole, and
the counts are those of the tokenizers library whatever the tables hold. No pre-token is shuffled: tier one comes from one
bounded table of each task, which are merged FAN at a time, level by level, until one is left.

Defined results: null text counts as empty; empty text has 0 tokens; a very long text is split and counted whole, by one
task; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import codec, kind_of
from .common import column_of, slices, with_text

#: At most so many pre-tokens are broadcast, of at most so many characters each: a proven bound of a few MB.
FREQUENT, LONGEST = 30_000, 32
#: A task that counts pre-tokens holds at most so many and then keeps the more frequent half.
HELD = 400_000
#: So many tables are merged at a time.
FAN = 16


def _packed(part: int, seen: Counter, size: int) -> pa.RecordBatch:
    """The `size` most frequent entries as one row: words joined by NUL, and their numbers."""
    top = heapq.nlargest(size, seen.items(), key=lambda x: (x[1], x[0]))
    words, numbers = "\0".join(w for w, _ in top).encode(), np.array([n for _, n in top], "<i8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([words]), pa.array([numbers])], ["part", "words", "numbers"])


def _unpacked(words: bytes, numbers: bytes) -> dict[str, int]:
    return dict(zip(words.decode().split("\0"), np.frombuffer(numbers, "<i8").tolist(), strict=True)) if numbers else {}


def frequent_lengths(texts: DataFrame, tokenizer: str, size: int = FREQUENT) -> tuple[bytes, bytes]:
    """The frequent pre-tokens of all texts and their lengths: words joined by NUL, and one byte for each.

    Each task counts what it reads and hands on one table of its 2 * `size` most frequent pre-tokens.
    """
    kind, schema = kind_of(tokenizer), "part int, words binary, numbers binary"
    if kind == "whole":
        return b"", b""

    def count(batches):
        from pyspark import TaskContext

        c, seen = codec(tokenizer, kind, "count"), Counter()
        for b in slices(batches):
            for t in column_of(b, "text").to_pylist():
                seen.update(c.split(t) or ())
            if len(seen) > HELD:
                seen = Counter(dict(seen.most_common(HELD // 2)))
        yield _packed(TaskContext.get().partitionId(), Counter({w: n for w, n in seen.items() if len(w) <= LONGEST and "\0" not in w}), 2 * size)

    def merge(key, table):
        seen = Counter()
        for words, numbers in zip(table["words"].to_pylist(), table["numbers"].to_pylist(), strict=True):
            seen.update(_unpacked(words, numbers))
        return pa.Table.from_batches([_packed(key[0].as_py(), seen, 2 * size)])

    tables, left = texts.select("text").mapInArrow(count, schema), texts.rdd.getNumPartitions()
    while left > 1:
        tables, left = tables.groupBy((F.col("part") / FAN).cast("int").alias("into")).applyInArrow(merge, schema), -(-left // FAN)
    counted = Counter()
    for r in tables.collect():  # one row
        counted.update(_unpacked(bytes(r.words), bytes(r.numbers)))
    words = [w for w, _ in heapq.nlargest(size, counted.items(), key=lambda x: (x[1], x[0]))]
    lengths = [len(ids) for ids in codec(tokenizer, kind, "driver").whole(words)]
    kept = [(w, n) for w, n in zip(words, lengths, strict=True) if n < 256]
    return "\0".join(w for w, _ in kept).encode(), bytes(n for _, n in kept)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    spark = docs.sparkSession
    kind, texts = kind_of(tokenizer), with_text(docs, id_col, text_col)
    table = spark.sparkContext.broadcast(frequent_lengths(texts, tokenizer))

    def run(batches):
        c = codec(tokenizer, kind, "count")
        if not c.pinned and table.value[1]:
            words, lengths = table.value
            c.pinned = dict(zip(words.decode().split("\0"), lengths, strict=True))
            c.cache = c.cache | c.pinned
        for b in slices(batches):
            n = c.counts(column_of(b, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
