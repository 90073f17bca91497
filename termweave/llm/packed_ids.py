"""Token ids as binary shards: fixed-width bit packing with block offsets.

A shard holds one range of documents in ascending doc_id order:

    magic  "TWPI" + version, bits, block size (u32 each)
    blocks of BLOCK ids, each id in `bits` bits, most significant bit first; a block starts at a whole byte
    doc_id  int64 for each document
    first   uint64 for each document: index of its first id in the shard, then the total
    offset  uint64 for each block: its first byte in the file, then the end
    footer  n_docs, n_blocks, where the three tables start (uint64), magic

All numbers are little-endian. Any id can be found from the offsets without reading what stands before it. Each attempt of
a task writes a file of its own name; the list of shards names the files of the attempts that succeeded, and only those
count: nothing is renamed, which object stores can't do at once.

Defined results: null text counts as empty; each document gets the end id, so an empty one has 1 id; documents of equal
doc_id stand next to each other, ordered by their texts, those without one first; a very long text is encoded whole, and a
shard holds at most a block of ids besides one batch; an empty table gives no shard and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import codec, kind_of
from .common import column_of, fresh_path, slices, with_text

MAGIC, VERSION, BLOCK = b"TWPI", 1, 8192
#: Stands for a missing doc_id.
NO_ID = -(1 << 63)


def bits_for(vocab_size: int) -> int:
    """The least number of bits that hold every id of a vocabulary."""
    return max(1, (max(vocab_size, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    as_bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(as_bits).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


#: Names that Hadoop and pyarrow give to the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(uri: str):
    """The file system of a path and the path in it."""
    scheme, mark, rest = uri.partition("://")
    try:
        return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)
    except pa.ArrowInvalid as e:
        raise ValueError(f"shards can't be written to {uri}: give a folder of a store that pyarrow can reach") from e


class ShardWriter:
    """Streams documents into one shard; holds at most a block of ids and the tables."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.doc_ids, self.first, self.offsets, self.total = [], [0], [], 0
        self.left = np.zeros(0, "<u4")
        self.at = out.write(MAGIC + struct.pack("<3I", VERSION, bits, block))

    def add(self, doc_ids: list[int], arrays: list[np.ndarray]) -> None:
        for d, a in zip(doc_ids, arrays, strict=True):
            self.doc_ids.append(d)
            self.total += len(a)
            self.first.append(self.total)
        ids = np.concatenate([self.left, *arrays])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._put(ids[i : i + self.block])
        self.left = ids[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.at += self.out.write(pack(ids, self.bits))

    def close(self) -> None:
        if len(self.left):
            self._put(self.left)
        tables, places = [np.array([NO_ID if d is None else d for d in self.doc_ids], "<i8"), np.array(self.first, "<u8"), np.array([*self.offsets, self.at], "<u8")], []
        for t in tables:
            places.append(self.at)
            self.at += self.out.write(t.tobytes())
        self.out.write(struct.pack("<5Q", len(self.doc_ids), len(self.offsets), *places) + MAGIC)


class ShardReader:
    """Random access to one shard."""

    def __init__(self, source):
        self.f = source
        head, foot = self._at(0, 16), self._at(source.size() - 44, 44)
        if head[:4] != MAGIC or foot[-4:] != MAGIC:
            raise ValueError("not a shard of packed ids")
        version, self.bits, self.block = struct.unpack("<3I", head[4:])
        if version != VERSION:
            raise ValueError(f"unknown version {version}")
        self.n_docs, n_blocks, a, b, c = struct.unpack("<5Q", foot[:40])
        self.doc_ids = np.frombuffer(self._at(a, 8 * self.n_docs), "<i8")
        self.first = np.frombuffer(self._at(b, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(self._at(c, 8 * (n_blocks + 1)), "<u8").astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.f.seek(start)
        return self.f.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard: only their blocks are read."""
        if end <= start:
            return np.zeros(0, "<u4")
        lo, hi, total = start // self.block, (end - 1) // self.block + 1, int(self.first[-1])
        data, base = self._at(int(self.offsets[lo]), int(self.offsets[hi] - self.offsets[lo])), int(self.offsets[lo])
        got = [unpack(data[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], min(self.block, total - k * self.block), self.bits) for k in range(lo, hi)]
        return np.concatenate(got)[start - lo * self.block : end - lo * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append end_id and write shards; returns their list: path, shard, n_docs, n_tokens, start.

    The list has one row per shard. Documents are dealt by ranges of doc_id, so that shards follow each other in order.
    """
    spark = docs.sparkSession
    folder, kind = folder or fresh_path(spark, "packed-ids"), kind_of(tokenizer)
    bits = bits_for(codec(tokenizer, kind, "driver").tok.get_vocab_size())

    def run(batches):
        from pyspark import TaskContext

        part, writer, sink = TaskContext.get().partitionId(), None, None
        c = codec(tokenizer, kind, "ids")
        for b in slices(batches):
            if not b.num_rows:
                continue
            if writer is None:
                files, base = file_system(folder)
                files.create_dir(base, recursive=True)
                name = f"shard-{part:06d}-{uuid.uuid4().hex}.twpi"
                sink = files.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(sink, bits)
            arrays = [np.append(a, end_id).astype("<u4") for a in c.ids(column_of(b, "text").to_pylist())]
            writer.add(column_of(b, "doc_id").to_pylist(), arrays)
        if writer is not None:
            writer.close()
            sink.close()
            row = [f"{folder}/{name}", part, len(writer.doc_ids), writer.total]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["path", "shard", "n_docs", "n_tokens"])

    ordered = with_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = sorted(ordered.mapInArrow(run, "path string, shard long, n_docs long, n_tokens long").collect(), key=lambda r: r.shard)
    start, listed = 0, []
    for r in rows:
        listed.append((r.path, r.shard, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(listed, "path string, shard long, n_docs long, n_tokens long, start long")


def read_shards(shards: DataFrame, docs_at_once: int = 256) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches):
        for b in slices(batches):
            for path, start in zip(column_of(b, "path").to_pylist(), column_of(b, "start").to_pylist(), strict=True):
                files, base = file_system(path)
                with files.open_input_file(base) as f:
                    r = ShardReader(f)
                    for lo in range(0, r.n_docs, docs_at_once):
                        hi = min(lo + docs_at_once, r.n_docs)
                        first = r.first[lo : hi + 1]
                        data = memoryview(r.ids(int(first[0]), int(first[-1])).tobytes())
                        cuts = (4 * (first - first[0])).tolist()
                        crc = [zlib.crc32(data[p:q]) for p, q in zip(cuts, cuts[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[lo:hi], mask=r.doc_ids[lo:hi] == NO_ID), pa.array(first[:-1] + start), pa.array(np.diff(first)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = shards.count()
    dealt = shards.select("path", "start").repartition(max(1, min(n, 4096)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
