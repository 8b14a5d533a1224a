"""Deterministic sharded WARC archives: writer and reader.

Records are sorted by page_id and dealt to shards by ranges of it that follow from the rows alone
(:func:`.shared.range_shards`). A shard's writer compresses each record as a gzip member of its own
and starts a new file when the compressed size reaches ``FILE_BYTES``. Headers are made anew: record
ids from page and digest, digests from the bytes, lengths from the block. A file is written under a
temporary name and renamed; the manifest (path, size, SHA-256, records) is a table that Spark
commits after all files are there, and the reader reads what the manifest names.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page_id is
the response, the others are revisits without payload. Which these are is found on (digest, page_id)
alone; the writer merges those few marks with the pages, so payloads move once.

Defined results: a null html is an empty payload; a null url gets a urn of the page's id; null
page_ids come first, and are smaller than any other; of repeated rows (same page_id, same payload)
one counts as the largest; extra columns are not read; an empty table writes no file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b16encode, b32decode, b32encode
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attempt_name, deal_by_shard, deal_files, range_shards, read_file, work_folder, write_file

MIN_REVISIT = 1000
#: Bytes of html that go to one shard, and so to one task; compressed bytes at which a file is closed.
SHARD_BYTES = 24 << 20
FILE_BYTES = 4 << 20
LEVEL = 5
#: Salts over which the pages of one digest are spread where they meet its largest page_id.
SALTS = 64
MANIFEST = "shard int, file int, path string, n_records bigint, n_bytes bigint, sha256 string"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's digest


def _record_id(page_id: int | None, digest: str, serial: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{serial}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, *, refers_to: int | None = None, revisit: bool = False, serial: int = 0) -> bytes:
    """One uncompressed WARC/1.1 record. The HTTP header of a revisit still tells the payload's length."""
    digest = _sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest, serial)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url, page_id)),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))] if revisit else []),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip member; zlib writes no time into its header
    return z.compress(data) + z.flush()


def _plain(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    view = memoryview(data)
    while view:
        z = zlib.decompressobj(31)
        yield z.decompress(view)
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        view = view[len(view) - len(z.unused_data) :]


_LINE = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(data: bytes) -> dict:
    """A record's fields; ValueError where a length or digest doesn't hold."""
    end = data.index(b"\r\n\r\n") + 2
    first = data.index(b"\r\n") + 2
    if not data.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    head = {k.lower().decode(): v.decode() for k, v in _LINE.findall(data[first:end])}
    size = int(head["content-length"])
    block = data[end + 2 : end + 2 + size]
    if len(block) != size or data[end + 2 + size :] != b"\r\n\r\n" or _sha1(block) != head["warc-block-digest"]:
        raise ValueError(f"a damaged record: {head.get('warc-record-id')}")
    cut = block.index(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", block[: cut + 2])[1])
    payload = block[cut + 4 :]
    revisit = head["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or _sha1(payload) != head["warc-payload-digest"]):
        raise ValueError(f"a damaged payload: {head.get('warc-record-id')}")
    number = lambda k: int(head[k]) if head.get(k) else None
    return {
        "page_id": number("x-page-id"),
        "payload_bytes": length,
        "payload_digest": b16encode(b32decode(head["warc-payload-digest"].removeprefix("sha1:"))).decode().lower(),
        "record_type": head["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
        "url": head["warc-target-uri"],
        "payload": None if revisit else payload,
    }


def duplicates(pages: DataFrame) -> DataFrame:
    """page_id, digest and the largest page_id of their payload, for all payloads that more than one row has.

    Only (digest, page_id) moves. A digest's rows are counted with partial aggregation and meet the
    result under SALTS keys, so a payload that a third of all pages share is no task's burden.
    """
    keys = pages.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    many = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response_id")).filter("n > 1")
    many = many.select("digest", "response_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(many, ["digest", "salt"]).select("page_id", "digest", "response_id")


def write(pages: DataFrame, folder: str, *, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages below ``folder``; the manifest, read back from the table that commits it."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    shards = range_shards(rows, "page_id", F.octet_length(F.coalesce("html", F.lit(""))) + F.lit(64), shard_bytes)
    marks = shards.everywhere(duplicates(rows).dropDuplicates())
    page_rows = shards.assign(rows, F.xxhash64("html")).select("_shard", "page_id", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("response_id"), F.lit(None).cast("string").alias("digest"), "url", "html")
    mark_rows = marks.select("_shard", "page_id", F.lit(0).alias("kind"), "response_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    dealt = deal_by_shard(page_rows.unionByName(mark_rows), shards.n, F.col("page_id").asc_nulls_first(), F.col("kind"), F.xxhash64("html"), F.col("url"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        attempt, shard, number = attempt_name(), None, 0
        held, size, made, at_page, marked, seen = [], 0, [], (None,), {}, {}

        def close() -> None:
            nonlocal number, held, size
            if held:
                data = b"".join(held)
                path = f"{folder}/shard-{shard:06d}-{number:04d}.warc.gz"
                write_file(path, data, attempt)
                made.append((shard, number, path, len(held), len(data), hashlib.sha256(data).hexdigest()))
                number, held, size = number + 1, [], 0

        for b in batches:
            for s, page, kind, response, digest, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, page) != at_page:
                    at_page, marked, seen = (s, page), {}, {}
                if s != shard or size >= file_bytes:
                    close()
                    shard, number = s, number if s == shard else 0
                if kind == 0:
                    marked[digest] = response
                    continue
                payload = (html or "").encode()
                sha = hashlib.sha1(payload).hexdigest()  # noqa: S324
                serial = seen.get(sha, 0)
                seen[sha] = serial + 1
                revisit = sha in marked and (marked[sha] != page or serial > 0)
                held.append(_member(record(page, url, payload, revisit=revisit, refers_to=marked.get(sha) if revisit else None, serial=serial)))
                size += len(held[-1])
        close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True) if made else [[]] * 6, kinds, strict=True)], ["shard", "file", "path", "n_records", "n_bytes", "sha256"])

    manifest = f"{folder}/_manifest"
    dealt.select(F.col("_shard").cast("int"), "page_id", "kind", "response_id", "digest", "url", "html").mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest)
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read(manifest: DataFrame, *, payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of every record, digests verified."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string" + ", payload binary" * payload

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())][: 6 + payload]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], [k for k, _ in fields])
        for b in batches:
            for path, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = read_file(path)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} isn't what the manifest says")
                rows, load = [], 0
                for plain in _plain(data):
                    rows.append(parse(plain))
                    load += len(plain) if payload else 400
                    if load >= 8 << 20:
                        yield made(rows)
                        rows, load = [], 0
                yield made(rows)

    return deal_files(manifest).select("path", "sha256").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    return read(write(pages, work_folder(pages.sparkSession, "warc")))
