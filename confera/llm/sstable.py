"""Token ids in sorted-string-table shards: a binary store with lookup of a document by its id.

A shard holds the documents of a range of ids, in ascending order: blocks of entries whose keys are prefix-compressed
against the entry before, a sparse index with the first key of each block, a Bloom filter of the keys, and a footer.
A lookup asks the Bloom filter, finds the block by binary search in the index and reads that block alone.

    entry   varint shared, varint unshared, varint bytes of value, rest of key, value
    value   byte width (2 or 4), ids as little-endian unsigned integers of that width
    block   entries, crc32 of them
    index   per block: u16 bytes of key, key, u64 offset, u32 bytes, u32 entries
    bloom   u32 hashes, u64 bits, bits
    footer  u64 offset and bytes of index, u64 offset and bytes of bloom, u64 documents, u64 ids, u32 crc32 of the six, magic

Keys are a byte (0: null id, 1: any other) and the id with its sign bit turned, big-endian, so bytes sort as ids do.
Each task writes its shards under names of its own in the shared folder, and only shards that the finished job reports are
read, so a lost executor or a second attempt leaves no trace. A task begins a new shard when one is full, so what a shard
keeps in memory until its end (16 bytes a document for the filter, and the index) is bounded; of the values one block is in
memory at a time. Texts are dealt by ranges of (id, hash of the text), so rows of one hot id spread over shards.

Defined results: ids are whole numbers; any other kind is an error. A null text has the end id alone. A null id sorts first.
Repeated rows are stored once each, by id, then by text. A very long text is one entry, alone in its block. An empty table
writes no shard and gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.llm.common import shared_dir, text_batches
from confera.llm.tokens import encoder

MAGIC = b"CFSST001"
BLOCK_BYTES = 1 << 16
#: Bytes of values after which a task begins another shard.
SHARD_BYTES = 1 << 28
#: Shards that a lookup's catalogue may have (paths and key ranges, about 50 MB); more are refused with an error.
MAX_SHARDS = 200_000
BITS_PER_KEY, HASHES = 10, 7
_FOOTER = struct.Struct("<6QI8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2)


def _bloom_places(a: np.ndarray, b: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    m = np.uint64(bits)
    return (a[:, None] % m + np.arange(hashes, dtype=np.uint64) * (b[:, None] % m)) % m


def _bloom(a: np.ndarray, b: np.ndarray, bits: int) -> bytes:
    """The packed bits, filled by a part of the keys at a time."""
    filled = np.zeros((bits + 7) // 8, dtype=np.uint8)
    for at in range(0, len(a), 1 << 16):
        places = _bloom_places(a[at : at + (1 << 16)], b[at : at + (1 << 16)], bits, HASHES).ravel()
        np.bitwise_or.at(filled, (places >> np.uint64(3)).astype(np.int64), (np.uint64(1) << (places & np.uint64(7))).astype(np.uint8))
    return filled.tobytes()


class Writer:
    """Takes (key, ids as little-endian 32-bit bytes) in ascending order of the keys."""

    def __init__(self, stream, block_bytes: int = BLOCK_BYTES):
        self.stream, self.block_bytes = stream, block_bytes
        self.block, self.size, self.entries, self.first, self.last = [], 0, 0, b"", b""
        self.index: list[bytes] = []
        self.hashes = array("Q")  # two of each key, for the filter
        self.low = b""
        self.at = self.docs = self.ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        self.low = self.low if self.docs else key
        wide = np.frombuffer(ids, dtype="<u4")
        value = b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids
        shared = 0
        if not self.entries:
            self.first = key
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), len(key))
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.entries, self.last = self.entries + 1, key
        self.hashes.extend(_hashes(key))
        self.docs, self.ids = self.docs + 1, self.ids + len(wide)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            body = b"".join(self.block)
            body += struct.pack("<I", zlib.crc32(body))
            self.stream.write(body)
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QII", self.at, len(body), self.entries))
            self.at += len(body)
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, self.docs * BITS_PER_KEY)
        both = np.frombuffer(self.hashes, dtype=np.uint64).reshape(-1, 2) if self.docs else np.zeros((0, 2), dtype=np.uint64)
        bloom = struct.pack("<IQ", HASHES, bits) + _bloom(both[:, 0], both[:, 1], bits)
        body = (self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids)
        self.stream.write(index + bloom + _FOOTER.pack(*body, zlib.crc32(struct.pack("<6Q", *body)), MAGIC))


class Shard:
    """A shard opened for reading; stream: seekable and binary."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2)
        *body, crc, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or crc != zlib.crc32(struct.pack("<6Q", *body)):
            raise ValueError("not a whole shard")
        index_at, index_bytes, bloom_at, bloom_bytes, self.docs, self.ids = body
        raw, at, self.blocks = self._read(index_at, index_bytes), 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.blocks.append((raw[at + 2 : at + 2 + n], *struct.unpack_from("<QII", raw, at + 2 + n)))
            at += 2 + n + 16
        self.firsts = [b[0] for b in self.blocks]
        self._bloom_at, self._bloom_bytes, self._bloom = bloom_at, bloom_bytes, None

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, size, entries = self.blocks[block]
        body = self._read(offset, size)
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError(f"block {block} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            value = body[at + 1 : at + n]
            yield key, (np.frombuffer(value, dtype="<u2").astype("<u4").tobytes() if body[at] == 2 else value)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.blocks)):
            for key, ids in self._entries(k):
                yield id_of(key), ids

    def may_have(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            raw = self._read(self._bloom_at, self._bloom_bytes)
            self._bloom = (*struct.unpack_from("<IQ", raw), raw[12:])
        hashes, bits, filled = self._bloom
        a, b = (np.array([h], dtype=np.uint64) for h in _hashes(key_of(doc_id)))
        return all(filled[int(p) >> 3] >> (int(p) & 7) & 1 for p in _bloom_places(a, b, bits, hashes)[0])

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every row with this doc_id; none if there is none."""
        key, out = key_of(doc_id), []
        if not self.blocks or not self.may_have(doc_id):
            return out
        at = bisect_right(self.firsts, key) - 1
        while at > 0 and self.firsts[at] == key:  # equal keys may begin in an earlier block
            at -= 1
        for k in range(max(at, 0), len(self.blocks)):
            if self.firsts[k] > key:
                break
            out += [ids for x, ids in self._entries(k) if x == key]
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Writes the shards and gives one small record for each, in the order of the ids: path, docs, ids, first and last key."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be a whole number")
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        writer = stream = None
        done: list[tuple] = []

        def close() -> None:
            writer.close()
            stream.close()
            done.append((name, writer.docs, writer.ids, writer.low, writer.last))

        for batch in batches:
            for doc_id, ids in zip(batch.column("id").to_pylist(), encode(batch.column("text").to_pylist())):
                if writer is None:
                    name = f"{folder}/{uuid.uuid4().hex}.sst"
                    store, path = _filesystem(name)
                    stream = store.open_output_stream(path)
                    writer = Writer(stream)
                writer.add(key_of(doc_id), ids + end)
                if writer.at + writer.size >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["path", "docs", "ids", "first", "last"])

    order = [F.col("id").asc_nulls_first(), F.col("h").asc_nulls_first()]
    by_id = text_batches(docs).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    by_id = by_id.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = [r.asDict() for r in by_id.select("id", "text").mapInArrow(write, "path string, docs bigint, ids bigint, first binary, last binary").collect()]
    return sorted(shards, key=lambda r: (bytes(r["first"]), bytes(r["last"])))


def read_shards(spark, shards: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    start, rows = 0, []
    for r in shards:
        rows.append((r["path"], start))
        start += r["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frame(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for name, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, path = _filesystem(name)
                out = []
                with store.open_input_file(path) as stream:
                    for doc_id, ids in Shard(stream):
                        out.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(out) >= 10_000:
                            yield frame(out)
                            out = []
                if out:
                    yield frame(out)

    files = spark.createDataFrame(rows, "path string, start bigint")
    return files.repartition(max(1, len(rows))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(ids: DataFrame, shards: list[dict], id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every stored document whose id is in ids; an id's copies give a row each.

    Distinct ids are dealt to the shards whose range of keys holds them; a shard's filter turns most absent ones away, and
    for the rest one block is read.
    """
    if len(shards) > MAX_SHARDS:
        raise ValueError(f"{len(shards)} shards; raise MAX_SHARDS ({MAX_SHARDS})")
    spark = ids.sparkSession
    ranges = [(r["path"], bytes(r["first"]), bytes(r["last"])) for r in shards]
    files = spark.createDataFrame(ranges, "path string, first binary, last binary")
    wanted = ids.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    turned = F.unhex(F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    key = F.when(F.col("id").isNull(), F.lit(b"\0" * 9)).otherwise(F.concat(F.lit(b"\1"), turned))
    met = wanted.withColumn("key", key).join(F.broadcast(files), (F.col("key") >= F.col("first")) & (F.col("key") <= F.col("last")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = stream = at = None
        for batch in batches:
            out = []
            for name, doc_id in zip(batch.column("path").to_pylist(), batch.column("id").to_pylist()):
                if name != at:
                    if stream is not None:
                        stream.close()
                    store, path = _filesystem(name)
                    stream = store.open_input_file(path)
                    shard, at = Shard(stream), name
                out += [(doc_id, v) for v in shard.get(doc_id)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["doc_id", "ids"])
        if stream is not None:
            stream.close()

    dealt = met.select("path", "id").repartition("path").sortWithinPartitions("path", "id")
    return text_batches(dealt).mapInArrow(read, "doc_id bigint, ids binary")


def token_store(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1) -> DataFrame:
    """Encodes, writes below the shared folder, and reads back."""
    folder = f"{shared_dir(docs.sparkSession)}/sstable-{uuid.uuid4().hex}"
    return read_shards(docs.sparkSession, write_shards(docs, tokenizer, folder, id_col, text_col, end_id=end_id))
