"""Sorted-string-table shards of token ids, written and read by all executors.

A shard holds a range of document ids in ascending order:

    block*      Zstandard-compressed; entries of varint(shared), varint(rest), varint(length),
                the key without the ``shared`` bytes that it has in common with the key before,
                and the value
    index       for each block: its last key, place, compressed length and number of entries
    Bloom       bits over all keys
    footer      places of index and Bloom filter, counts, checksum and magic, of fixed length

A key is the id as eight big-endian bytes with the sign flipped, so keys sort as ids do; a null id
is the empty key and sorts first. A value is one byte for the width of an id in bytes (2 or 4) and
the ids, little-endian. ``lookup`` reads the footer, asks the Bloom filter, finds the block by
binary search in the index and decodes that block alone.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosemill.llm.common import materialize, shared_path, shuffle_partitions, text_bytes, text_or_empty

MAGIC = b"PMSSTAB1"
FOOTER = struct.Struct("<QQQQIQQI8s")
BLOCK_BYTES = 256 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Bytes of text for each shard, about; there are at most so many shards.
SHARD_BYTES, MOST_SHARDS = 64 * 1024 * 1024, 1 << 20
#: Signs of a text that deal out rows of one id.
DEALT_BY = 64


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


def pack_value(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return b"\x04" + ids if len(wide) and wide.max() > 0xFFFF else b"\x02" + wide.astype("<u2").tobytes()


def unpack_value(value: bytes) -> bytes:
    return value[1:] if value[0] == 4 else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()


class TableWriter:
    """Writes entries, given in key order, to a binary stream. Holds one block at a time."""

    def __init__(self, out):
        import zstandard

        self.out, self.compress = out, zstandard.ZstdCompressor(level=1).compress
        self.at, self.block, self.size, self.entries, self.last = 0, [], 0, 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in order")
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        value = pack_value(ids)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // 4
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append(struct.pack("<B", len(self.last)) + self.last + struct.pack("<QII", self.at, len(data), self.entries))
            self.at += len(data)
            self.block, self.size, self.entries, self.last = [], 0, 0, b""

    def finish(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        index, packed = b"".join(self.index), np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(struct.pack("<Q", bits) + packed)
        crc = zlib.crc32(packed, zlib.crc32(index))
        self.out.write(
            FOOTER.pack(self.at, len(index), self.at + len(index), 8 + len(packed), BLOOM_HASHES, len(self.keys), self.tokens, crc, MAGIC)
        )


class TableReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor().decompress
        end = file.seek(0, 2)
        file.seek(end - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.hashes, self.docs, self.tokens, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(index_at)
        index = file.read(index_len)
        file.seek(bloom_at)
        bloom = file.read(bloom_len)
        if crc != zlib.crc32(bloom[8:], zlib.crc32(index)):
            raise ValueError("the shard is damaged")
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.last_keys, self.blocks, at = [], [], 0
        while at < len(index):
            n = index[at]
            self.last_keys.append(index[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QII", index, at + 1 + n))
            at += 1 + n + 16

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        place, length, _ = self.blocks[k]
        self.file.seek(place)
        data, at, key = self.expand(self.file.read(length)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, unpack_value(data[at : at + size])
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The ids of every document with this id, as little-endian unsigned 32-bit bytes."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            hits = [v for x, v in self.block(k) if x == key]
            found += hits
            if self.last_keys[k] > key:
                break
        return found


#: Names that Hadoop has for stores, and those that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}


def _file(uri: str, write: bool = False):
    """A stream on any store that pyarrow knows, by URI."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    store, path = fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)
    if write:
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def open_shard(uri: str) -> TableReader:
    return TableReader(_file(uri))


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards below ``out``; ``shard, path, n_docs, n_tokens`` of those that count.

    A task writes to a name of its own, so a task that is run again never touches the file of
    another attempt; the manifest that is returned names the files of the attempts that succeeded,
    and the others are removed. Rows of one id are dealt out by the beginnings of their texts, so
    that an id of very many rows takes several shards.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from prosemill.llm.encoding import id_encoder

        encoder, end, writer = id_encoder(tokenizer), int(end_id).to_bytes(4, "little"), None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("t"), strict=True):
                if writer is None:
                    shard = TaskContext.get().partitionId()
                    path = f"{out}/shard-{shard:08d}-{uuid.uuid4().hex}.sst"
                    stream = _file(path, write=True)
                    writer = TableWriter(stream)
                writer.add(key_of(doc_id), encoder.encode(text.as_py()) + end)
        if writer is not None:
            writer.finish()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.keys)], "n_tokens": [writer.tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    rows = rows.withColumn("begins", F.substring("t", 1, DEALT_BY))
    ordered = rows.repartitionByRange(shards, "doc_id", "begins").sortWithinPartitions("doc_id", "begins", "t")
    written = ordered.select("doc_id", "t").mapInArrow(run, "shard long, path string, n_docs long, n_tokens long")
    manifest = materialize(written, "sst-manifest")
    _sweep(manifest, out)
    return manifest


def _sweep(manifest: DataFrame, out: str) -> None:
    """Remove shards in ``out`` that no successful attempt wrote. At most MOST_SHARDS names are held."""
    spark = manifest.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return
    counted = {r["path"].rpartition("/")[2] for r in manifest.select("path").toLocalIterator()}
    there = store.listStatusIterator(folder)
    while there.hasNext():
        path = there.next().getPath()
        if path.getName().endswith(".sst") and path.getName() not in counted:
            store.delete(path, False)


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``, from the files."""
    # A window without a key: one short row a shard, so at most MOST_SHARDS.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
        for batch in batches:
            for row in batch.to_pylist():
                at = row["first"]
                reader = open_shard(row["path"])
                for k in range(len(reader.blocks)):
                    out = []
                    for key, ids in reader.block(k):
                        out.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids), ids))
                        at += len(ids) // 4
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)
                reader.file.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    # One row a file: dealt by range, so that each task gets about as many files.
    return files.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(run, schema)


def token_tables(docs: DataFrame, tokenizer: str, end_id: int = 2, out: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of ``docs`` as shards and return what ``read_shards`` reads back.

    ``start`` is the number of ids before the document in ascending order of id, nulls first.
    A null text counts as empty and is its end id alone. Repeated ids keep all their rows, ordered
    by text. Other columns are ignored. An empty table gives no shard and an empty result.
    ``shards`` is by default the number of shuffle partitions or, if that is more, the texts' bytes
    as they are counted over ``SHARD_BYTES``.
    """
    spark = docs.sparkSession
    if shards is None:
        shards = min(MOST_SHARDS, max(shuffle_partitions(spark), text_bytes(docs, text_col) // SHARD_BYTES))
    return read_shards(write_shards(docs, out or shared_path(spark, "sst"), tokenizer, end_id, shards, id_col, text_col))
