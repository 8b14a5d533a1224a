"""Token-id files: documents' ids in ascending doc_id order, range-coded in checksummed blocks.

A file is a magic number, an index (doc_id, null flag and number of ids of each document, deflated,
with a checksum) and the blocks of :mod:`.rangecoder`, each coded on its own. Files are cut at
document ends once they hold ``FILE_IDS`` ids, so their contents follow from the rows and the shard
size alone. A file is written under a temporary name and renamed; its row in the manifest, itself a
table that Spark commits, comes after. A task that runs twice writes the same bytes twice.

Defined results: a null or empty text is the end id alone; rows without doc_id come first; rows that
share a doc_id stand side by side, in the order of their texts' hashes; extra columns are not read;
an empty table writes no file and reads as no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .shared import attempt_name, deal_by_shard, deal_files, range_shards, read_file, work_folder, write_file
from .tokenizing import encoder

#: UTF-8 bytes of text that go to one shard, and so to one task.
SHARD_BYTES = 24 << 20
FILE_IDS = 4 << 20
_HEAD = struct.Struct("<4sIIQII")  # magic, ids in the vocabulary, documents, ids, index bytes, index checksum
_MAGIC = b"TKF1"
MANIFEST = "shard int, file int, path string, n_docs bigint, n_ids bigint, n_bytes bigint, sha256 string"


def pack_file(doc_ids: list[int | None], docs: list[bytes], n_ids: int) -> bytes:
    """A file's bytes. docs: each document's ids, little-endian unsigned 32-bit; the list is emptied."""
    counts = np.array([len(d) // 4 for d in docs], "<u4")
    index = np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([i is None for i in doc_ids], np.uint8).tobytes() + counts.tobytes()
    index = zlib.compress(index, 6)
    ids = np.frombuffer(b"".join(docs), "<u4")
    docs.clear()
    blocks = [rangecoder.encode_block(ids[a : a + rangecoder.BLOCK_IDS], n_ids) for a in range(0, len(ids), rangecoder.BLOCK_IDS)]
    return b"".join([_HEAD.pack(_MAGIC, n_ids, len(counts), len(ids), len(index), zlib.crc32(index)), index, *blocks])


def unpack_file(data: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, ids before it in the file, its ids), decoding a block at a time; ValueError on damage."""
    magic, n_ids, n_docs, total, size, crc = _HEAD.unpack_from(data)
    index = data[_HEAD.size : _HEAD.size + size]
    if magic != _MAGIC or zlib.crc32(index) != crc:
        raise ValueError("a damaged file")
    index = zlib.decompress(index)
    doc_ids = np.frombuffer(index, "<i8", n_docs)
    null = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    if int(counts.sum()) != total:
        raise ValueError("a damaged index")
    at, start, block, pos = _HEAD.size + size, 0, b"", 0
    for doc, is_null, n in zip(doc_ids.tolist(), null.tolist(), counts.tolist(), strict=True):
        parts, need = [], 4 * n
        while need:
            if pos == len(block):
                ids, at = rangecoder.decode_block(data, n_ids, at)
                block, pos = ids.tobytes(), 0
            parts.append(block[pos : pos + need])  # only the document's own part is copied
            pos, need = pos + len(parts[-1]), need - len(parts[-1])
        yield (None if is_null else doc), start, parts[0] if len(parts) == 1 else b"".join(parts)
        start += n


def write(docs: DataFrame, file: str, folder: str, *, text: str = "text", end_id: int = 2, n_ids: int = 50257, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents' ids below ``folder``; the manifest, read back from the table that commits it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    shards = range_shards(rows, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(16), shard_bytes)
    dealt = deal_by_shard(shards.assign(rows, tie), shards.n, F.col("doc_id").asc_nulls_first(), tie, F.col("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end, attempt = encoder(file, False), np.array([end_id], "<u4").tobytes(), attempt_name()
        shard, number, ids, held, size, made = None, 0, [], [], 0, []

        def close() -> None:
            nonlocal number, ids, held, size
            if held:
                data = pack_file(ids, held, n_ids)
                path = f"{folder}/shard-{shard:06d}-{number:04d}.tkf"
                write_file(path, data, attempt)
                made.append((shard, number, path, len(ids), size // 4, len(data), hashlib.sha256(data).hexdigest()))
                number, ids, held, size = number + 1, [], [], 0

        for b in batches:
            for at in range(0, b.num_rows, 128):  # some documents at a time, so that a batch isn't held as text and as ids
                shards, docs_, texts = (c.to_pylist() for c in b.slice(at, 128).columns)
                for s, d, x in zip(shards, docs_, enc.encode(texts), strict=True):
                    if s != shard or size >= 4 * FILE_IDS:
                        close()
                        shard, number = s, number if s == shard else 0
                    ids.append(d)
                    held.append(x + end)
                    size += len(held[-1])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 7, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["shard", "file", "path", "n_docs", "n_ids", "n_bytes", "sha256"])

    manifest = f"{folder}/_manifest"
    dealt.select(F.col("_shard").cast("int"), "doc_id", "text").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids of all files before. Shards are summed first; of shards there is a bounded number."""
    spark = manifest.sparkSession
    total, rows = 0, []
    for s, n in sorted((r[0], r[1]) for r in manifest.groupBy("shard").agg(F.sum("n_ids")).collect()):
        rows.append((s, total))
        total += n
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    first = spark.createDataFrame(rows, "shard int, _first bigint")
    return manifest.withColumn("_in", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(F.broadcast(first), "shard").withColumn("start", F.col("_first") + F.col("_in")).drop("_first", "_in")


def read(manifest: DataFrame, *, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files, checksums verified."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds, names = [pa.int64()] * 4 + [pa.list_(pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        for b in batches:
            for path, first, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = read_file(path)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} isn't what the manifest says")
                rows: list[list] = [[] for _ in range(5)]
                for doc, start, x in unpack_file(data):
                    for k, v in enumerate((doc, first + start, len(x) // 4, zlib.crc32(x))):
                        rows[k].append(v)
                    if ids:
                        rows[4].append(np.frombuffer(x, "<u4").astype(np.int32))
                    if len(rows[0]) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds[k]) for k in range(4 + ids)], names[: 4 + ids])
                        rows = [[] for _ in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds[k]) for k in range(4 + ids)], names[: 4 + ids])

    return deal_files(starts(manifest)).select("path", "start", "sha256").mapInArrow(run, schema)


def round_trip(docs: DataFrame, file: str, *, text: str = "text", end_id: int = 2) -> DataFrame:
    folder = work_folder(docs.sparkSession, "tokenbin")
    return read(write(docs, file, folder, text=text, end_id=end_id))
