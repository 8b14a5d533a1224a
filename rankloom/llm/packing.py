"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Lengths are small integers, so the whole problem is its histogram: how many pieces have each of the
``capacity`` lengths. Best-fit decreasing runs over that histogram, a segment tree over remaining
capacities finding the tightest open sequence in logarithmic time. Pieces of one length and
sequences with one remaining capacity are interchangeable, so a step places as many as fit at once.
The outcome, a few rows for each length, says for each rank among the pieces of a length which
sequence and offset it gets; it depends on ``capacity``, not on how many documents there are.

Defined results: a null or empty text is one piece that holds the end id only; repeated rows are
packed each for itself; rows without a ``doc_id`` are packed too; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint
from .tokenizing import encoder

CAPACITY = 4096
#: Shares that the pieces of one length are dealt to, at least, before they are numbered, and pieces a share: no length meets in one task.
SHARES = 256
SHARE_PIECES = 1 << 20
#: Rows of a batch that are in Python at a time.
SLICE = 1024


class SegmentTree:
    """Over capacities 0..n: which have an open sequence; the smallest such capacity of at least a given one."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, there: bool) -> None:
        at += self.size
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:  # up until a right neighbour holds something, then down its left side
            if not at & 1 and self.any[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, each, offset).

    The pieces of ``length`` with rank_from <= rank < rank_to fill sequences from first_sequence on,
    ``each`` to a sequence, the first of them at ``offset``.
    """
    tree, open_, rows, fresh = SegmentTree(capacity), {}, [], 0

    def put(cap: int, first: int, n: int) -> None:
        if cap and n:
            open_.setdefault(cap, []).append((first, n))
            tree.set(cap, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        while left:
            cap = tree.tightest(length)
            if cap is None:
                cap, first, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            else:
                first, n = open_[cap].pop()
                if not open_[cap]:
                    tree.set(cap, False)
            each = cap // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, rank + whole * each, first, each, capacity - cap))
                put(cap - each * length, first, whole)
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and left and left < each:
                rows.append((length, rank, rank + left, first, left, capacity - cap))
                put(cap - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            put(cap, first, n)
    return rows


def tokenize_pieces(docs: DataFrame, file: str, *, text: str = "text", end_id: int = 1, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, on demand, the ids themselves."""
    schema = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint" + ", ids array<int>" * ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = encoder(file, True), np.array([end_id], "<u4").tobytes()
        for b in (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE)):
            rows: list[list] = [[] for _ in range(6)]
            for doc, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = data[4 * start : 4 * (start + capacity)]
                    for k, v in enumerate((doc, piece, start, len(part) // 4, zlib.crc32(part))):
                        rows[k].append(v)
                    if ids:
                        rows[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 5 + ids
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], kinds[k]) for k in range(n)], names[:n])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).alias("text")).mapInArrow(run, schema)


def assign_sequences(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, piece and length."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    shares = max(SHARES, -(-max(histogram.values(), default=0) // SHARE_PIECES))
    own = [c for c in pieces.columns if c != "ids"]  # rows without an id differ by what they hold
    dealt = pieces.withColumn("_share", F.pmod(F.xxhash64(*own), F.lit(shares)).cast("int"))
    counts = dealt.groupBy("length", "_share").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # at most a row for each share of a length
    rows = plan_packing(histogram, capacity)
    plan = spark.createDataFrame(rows, "length int, _from bigint, _to bigint, _seq bigint, _each bigint, _off bigint")
    order = Window.partitionBy("length", "_share").orderBy(*own)
    ranked = dealt.withColumn("_k", F.row_number().over(order).cast("bigint") - 1).join(starts, ["length", "_share"]).withColumn("_rank", F.col("_k") + F.col("_first"))
    # The plan's size is bounded by the capacity alone.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(plan["length"])
    step = F.col("_rank") - F.col("_from")
    return (
        placed.withColumn("sequence_id", F.col("_seq") + F.floor(step / F.col("_each")))
        .withColumn("offset", F.col("_off") + F.pmod(step, F.col("_each")) * F.col("length"))
        .drop("_share", "_k", "_first", "_rank", "_from", "_to", "_seq", "_each", "_off")
    )


def pack(docs: DataFrame, file: str, *, text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise once into the shared folder, then pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = checkpoint(tokenize_pieces(docs, file, text=text, end_id=end_id, capacity=capacity))
    out = assign_sequences(pieces, capacity=capacity)
    return out.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")
