"""Embedding near-duplicates over an inverted multi-index.

Vectors are cut in halves; a codebook for each half, fitted by k-means on a bounded sample, names
the nearest centroid, and the pair of names is the vector's cell in the product grid. Every row is
in the grid. Two unit vectors with cosine c are sqrt(2 - 2c) apart, so a vector's partners lie in
cells that near to it. How near a cell can be follows from the planes between centroids, half by half.
The multi-sequence traversal goes through both halves' bounds in ascending order and visits a cell
while the sum of the two squared bounds allows a partner; it stops where none is possible, which
makes the target recall 1. A vector visits only cells numbered above its own: no pair meets twice.

Cells are dealt in blocks of bounded size, and pairs of blocks are verified by matrix products in
double precision. A block pair returns, for each vector that has a link, how many, and the smallest
id it reaches there: what leaves is linear in the vectors however many links there are. Equal
vectors are one class with a weight, so copies are counted, not compared. The grid grows with the
largest label, so that its cells hold about ``CELL`` rows each at any size.

Defined results: rows without label, vector or id, with null or non-finite components or of zero
length link with nothing; vectors of different dimensions don't link; a row without id has no
component and is kept; rows that share an id are one node, linked if any of their values is, and its
n_links adds up the vectors that its distinct values link with; rows equal in id and value count once;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import checkpoint, scratch

THRESHOLD = 0.98
#: Rows the codebooks are fitted on, at most about so many; rows a cell, on average; rows a block.
SAMPLE = 16_384
CELL = 4096
BLOCK = 4096
#: Rows of a block that are multiplied at a time, which bounds what a task holds beside the block's vectors.
TILE = 512
#: Planes between centroids that a bound looks at: those of the nearest centroids.
PLANES = 64
ROUNDS = 10


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of the rows of x; fewer where there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _squares(x, centers).argmin(axis=1)
        for j in range(k):
            own = x[near == j]
            centers[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return np.unique(centers, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :], 0)


def cell_bounds(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared lower bound of the distance to every centroid's cell) for each row."""
    d = _squares(x, centers)
    gap = np.sqrt(_squares(centers, centers))
    np.fill_diagonal(gap, np.inf)
    low = np.zeros_like(d)
    near = np.argsort(d, axis=1)[:, :PLANES]
    for k in near.T:  # the planes between a near centroid and every other one; any of them bounds from below
        np.maximum(low, (d - np.take_along_axis(d, k[:, None], 1)) / (2 * np.maximum(gap[k], 1e-12)), out=low)
    return d.argmin(axis=1), np.maximum(low - 1e-9, 0) ** 2


def multi_sequence(bounds1: np.ndarray, bounds2: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of all visited cells. Both halves' cells in ascending order of bound; a row's walk

    along the second half ends at the first sum over the limit, and its walk along the first half
    where even the nearest cell of the second is too far: the staircase that the priority queue of
    the multi-sequence algorithm would empty, for all rows at once.
    """
    order1, order2 = np.argsort(bounds1, axis=1), np.argsort(bounds2, axis=1)
    sorted1, sorted2 = np.take_along_axis(bounds1, order1, 1), np.take_along_axis(bounds2, order2, 1)
    rows, firsts, seconds = [], [], []
    live = np.arange(len(bounds1))
    for step in range(bounds1.shape[1]):
        room = limit - sorted1[live, step]
        live, room = live[room >= sorted2[live, 0]], room[room >= sorted2[live, 0]]
        if not len(live):
            break
        reach = (sorted2[live] <= room[:, None]).sum(axis=1)
        who = np.repeat(live, reach)
        at = np.arange(len(who)) - np.repeat(np.cumsum(reach) - reach, reach)
        rows.append(who)
        firsts.append(np.repeat(order1[live, step], reach))
        seconds.append(order2[who, at])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(rows), cat(firsts), cat(seconds)


class Codebooks:
    """For each dimension of the sample: centroids of the first and of the second half of unit vectors."""

    def __init__(self, sample: list[np.ndarray], k: int):
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims: dict[int, list[np.ndarray]] = {}
        for v in sample:
            dims.setdefault(len(v), []).append(v)
        for dim, rows in dims.items():
            if dim >= 2:
                x = _unit(np.array(rows, np.float64))
                self.by[dim] = _kmeans(x[:, : dim // 2], k, 1), _kmeans(x[:, dim // 2 :], k, 2)

    def cells(self, x: np.ndarray, radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, visitor) for rows of one dimension: each in its own cell, and as a visitor in higher ones."""
        n = len(x)
        books = self.by.get(x.shape[1])
        if books is None:  # a dimension that the sample hasn't: one cell
            return np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
        half = x.shape[1] // 2
        own1, low1 = cell_bounds(x[:, :half], books[0])
        own2, low2 = cell_bounds(x[:, half:], books[1])
        own = own1 * len(books[1]) + own2
        row, i, j = multi_sequence(low1, low2, radius2)
        cell = i * len(books[1]) + j
        more = cell > own[row]
        return np.concatenate([np.arange(n), row[more]]), np.concatenate([own, cell[more]]), np.concatenate([np.zeros(n, bool), np.ones(int(more.sum()), bool)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kind(df: DataFrame, vector: str) -> str:
    return "float" if "float" in dict(df.dtypes)[vector] else "double"


def _classes(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows that can link: vec_id, label, embedding, two hashes that name equal vectors, and ``h``, which tells the values of one id apart."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast(f"array<{_kind(vectors, vector)}>").alias("embedding"))
    fine = "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double(\'infinity\')) and exists(embedding, x -> x <> 0)"
    return v.filter(fine).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.reverse("embedding"), F.lit(1))).dropDuplicates(["vec_id", "label", "h1", "h2"]).withColumn("h", F.xxhash64("label", "h1", "h2"))


def place(reps: DataFrame, books: Codebooks, threshold: float) -> DataFrame:
    """A row for each rep in its own cell and in each cell that it visits."""
    shared = reps.sparkSession.sparkContext.broadcast(books)  # bounded by SAMPLE
    radius2 = 2 - 2 * threshold + 1e-9

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                dims = pa.compute.list_value_length(b.column(3)).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    own = b.filter(pa.array(dims == dim))
                    x = _unit(own.column(3).flatten().to_numpy().astype(np.float64).reshape(-1, dim))
                    row, cell, visitor = shared.value.cells(x, radius2)
                    got = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array(cell, pa.int32()), pa.array(visitor)], ["vec_id", "h", "label", "embedding", "weight", "cell", "visitor"])

    return reps.select("vec_id", "h", "label", "embedding", "weight").mapInArrow(run, "vec_id bigint, h bigint, label string, embedding array<%s>, weight bigint, cell int, visitor boolean" % _kind(reps, "embedding"))


def linked_rows(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tile: int = TILE) -> np.ndarray:
    """Which rows ``left`` of x link with which rows ``right``, in double precision; no row links with itself."""
    norm, facing = np.linalg.norm(x, axis=1), x[right].T
    link = np.empty((len(left), len(right)), bool)
    for at in range(0, len(left), tile):
        own = left[at : at + tile]
        cosine = x[own] @ facing
        cosine /= norm[own][:, None] * norm[right][None, :]
        link[at : at + tile] = (cosine >= threshold) & (own[:, None] != right[None, :])
    return link


def least_reached(link: np.ndarray, top: np.ndarray, other: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of the ids ``top`` (of rows) and ``other`` (of columns) that each row and column reaches by links."""
    far = np.iinfo(np.int64).max
    while link.size:
        low, low_other = top.copy(), other.copy()
        for at in range(0, len(top), tile):
            part, own = link[at : at + tile], slice(at, at + tile)
            low[own] = np.minimum(low[own], np.where(part, low_other[None, :], far).min(axis=1))
            low_other = np.minimum(low_other, np.where(part, low[own][:, None], far).min(axis=0))
        if (low == top).all() and (low_other == other).all():
            break
        top, other = low, low_other
    return top, other


def weights_linked(link: np.ndarray, rows: np.ndarray, columns: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the weights of the columns that it links with, and the other way round."""
    of_rows, of_columns = np.zeros(len(rows), np.int64), np.zeros(len(columns), np.int64)
    for at in range(0, len(rows), tile):
        part = link[at : at + tile]
        of_rows[at : at + tile] = part @ columns
        of_columns += rows[at : at + tile] @ part
    return of_rows, of_columns


def verify(placed: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """vec_id, h, n (weights of linked vectors in a block pair) and root (the smallest id it reaches there).

    A cell's own rows are dealt in blocks, its visitors in chunks twice as large. Every pair of
    blocks meets once, and every block meets every chunk; visitors don't meet each other.
    """
    key = ["label", "_dim", "cell"]
    rows = placed.withColumn("_dim", F.size("embedding"))
    share = lambda visits, size: F.ceil(F.sum(F.when(F.col("visitor") == visits, 1).otherwise(0)) / F.lit(size)).cast("int")
    counts = checkpoint(rows.groupBy(*key).agg(share(False, block).alias("_blocks"), share(True, 2 * block).alias("_chunks")).filter("_blocks > 0"))
    dealt = rows.join(counts, key).withColumn("_mine", F.pmod(F.xxhash64("vec_id", "h"), F.when(F.col("visitor"), F.col("_chunks")).otherwise(F.col("_blocks"))).cast("int"))
    each = lambda n, x: f"if({n} > 0, transform(sequence(0, {n} - 1), o -> {x}), cast(array() as array<struct<p: int, q: int, c: int>>))"
    of_member = f"concat({each('_blocks', 'struct(least(_mine, o) as p, greatest(_mine, o) as q, -1 as c)')}, {each('_chunks', 'struct(_mine as p, -1 as q, o as c)')})"
    of_visitor = each("_blocks", "struct(o as p, -1 as q, _mine as c)")
    dealt = dealt.withColumn("_to", F.explode(F.expr(f"if(visitor, {of_visitor}, {of_member})")))
    dealt = dealt.select(*key, "_to.p", "_to.q", "_to.c", "_mine", "vec_id", "h", "weight", "visitor", "embedding")

    def run(table):
        import pyarrow as pa

        ids, own, weight, visitor, mine = (table.column(c).to_numpy() for c in ("vec_id", "h", "weight", "visitor", "_mine"))
        p, q, c = (table.column(x)[0].as_py() for x in ("p", "q", "c"))
        x = table.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
        left = np.flatnonzero(~visitor & (mine == p) if c < 0 else ~visitor)
        right = np.flatnonzero(mine == q if c < 0 else visitor)
        link = linked_rows(x, left, right, threshold)
        some, other = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
        link, left, right = link[np.ix_(some, other)], left[some], right[other]
        n, n_other = weights_linked(link, weight[left], weight[right])
        top, top_other = least_reached(link, ids[left], ids[right])
        out = [(ids[left], own[left], n, top)]
        if c >= 0 or p != q:  # else both sides are the same rows
            out.append((ids[right], own[right], n_other, top_other))
        cat = lambda k: pa.array(np.concatenate([o[k] for o in out]), pa.int64())
        return pa.table({"vec_id": cat(0), "h": cat(1), "n": cat(2), "root": cat(3)})

    return dealt.groupBy(*key, "p", "q", "c").applyInArrow(run, "vec_id bigint, h bigint, n bigint, root bigint")


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, vector: str = "embedding", label: str = "label", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    with scratch(vectors.sparkSession) as keep:
        have = _classes(vectors, vector, label)
        key = ["label", "h1", "h2"]
        sizes = have.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
        classes = checkpoint(sizes.filter("weight > 1"))
        copies = checkpoint(have.select("vec_id", "h", *key).join(classes, key).select("vec_id", "rep", "weight", "h", *key))
        firsts = copies.filter("vec_id = rep").select("vec_id", *key, "weight")
        others = copies.filter("vec_id <> rep").select("vec_id", *key)
        reps = have.join(others, ["vec_id", *key], "left_anti").join(firsts, ["vec_id", *key], "left")
        reps = checkpoint(reps.select("vec_id", "h", "label", "embedding", F.coalesce("weight", F.lit(1)).alias("weight")))
        n, most = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        k = int(max(2, np.ceil(np.sqrt(most / CELL))))
        share = F.pmod(F.xxhash64("vec_id", "h"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(1, n))))
        fitted = reps.filter(share).select("embedding").toArrow().column(0)  # about SAMPLE rows, as packed floats
        books = Codebooks([v.values.to_numpy() for v in fitted], k)
        found = checkpoint(verify(checkpoint(place(reps, books, threshold)), threshold, block))
        linked = checkpoint(found.groupBy("vec_id", "h").agg(F.sum("n").alias("n")))
        edges = found.filter("root <> vec_id").select(F.col("root").alias("a"), F.col("vec_id").alias("b"))
        edges = edges.unionByName(copies.filter("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
        component = keep(connected_components(edges)).withColumnRenamed("node", "vec_id")
        # A copy has its class's links and, beside them, the rest of the class; an id adds up its values.
        shared = copies.filter("vec_id <> rep").join(linked.withColumnRenamed("vec_id", "rep"), ["rep", "h"]).select("vec_id", "n")
        parts = linked.select("vec_id", "n").unionByName(shared).unionByName(copies.select("vec_id", (F.col("weight") - 1).alias("n")))
        links = keep(checkpoint(parts.groupBy("vec_id").agg(F.sum("n").alias("_n"))))
    out = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(links, "vec_id", "left").join(component, "vec_id", "left")
    cid = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))
