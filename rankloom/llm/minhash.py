"""Near-duplicate detection by b-bit MinHash.

* A document's set is its distinct word shingles, hashed to 64 bits. Documents with one set (a
  128-bit digest of it) are one class, of which the smallest doc_id goes on.
* ``ROWS * BANDS`` minima are taken. Each band of ROWS minima is a bucket key; of every minimum the
  low ``BITS`` bits are kept, packed into 64-bit words.
* In each bucket every member is paired with the smallest; pairs meet their packed signatures, and
  the share of equal lanes, counted as bits and corrected for chance agreement, estimates their
  similarity. The sizes of the sets bound it too. What could reach the threshold is confirmed on the
  full sets (all shingles as sorted 64-bit hashes), made again from the whole texts.
* Confirmed links give components. A pair in a bucket whose ends lie in one component already needs
  no more work. Members of buckets that aren't one component yet are gathered under the smallest
  member of their bucket, which most buckets of a group share, dealt in blocks of bounded size, and
  pairs of blocks are looked at whole: signatures for all pairs; then full sets, fetched only for
  documents that could have a link, none for ends that a link has joined meanwhile. Only links leave
  a block.

With 36 bands of 5 a link at similarity 0.8 escapes all buckets with probability 7e-7. The estimate
drops a pair below 0.64; of 180 two-bit lanes a link at 0.8 does so with probability 4e-6.

Defined results: documents without words have an empty set and link with nothing; a document with
fewer words than a shingle is one shingle; rows without doc_id link with nothing, have no component
and are kept; rows that share a doc_id are one document, linked if any of their texts is; a row's
n_shingles is that of its own text; extra columns are not read. A text is shingled ``BYTES`` bytes at
a time, so beyond a very long text itself only its shingles' hashes, 8 bytes each, are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import checkpoint, scratch

ROWS, BANDS, BITS = 5, 36, 2
LANES = ROWS * BANDS
WORDS64 = -(-LANES * BITS // 64)
#: Estimates below this aren't confirmed.
LEAST = 0.64
#: Documents in a block of those that their bucket's smallest member didn't settle.
BLOCK = 128
#: Bytes of text that are shingled at a time; shingles of the partners that meet a document in one task.
BYTES = 1 << 18
LOAD = 1 << 20
U64, U32 = np.uint64, np.uint32
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX, _RADIX_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(_RADIX) + U64(seed))
    return (x[:n] >> U64(32)).astype(U32) | U32(1), (x[n:] >> U64(32)).astype(U32)


def _powers(r: int, n: int) -> np.ndarray:
    p = np.ones(1, U64)
    while len(p) < n:
        p = np.concatenate([p, p * U64(pow(r, len(p), 1 << 64))])
    return p[:n]


class Shingler:
    """Shingle sets and signatures of blocks of texts, on flat arrays. What it holds follows from BYTES, not from the texts."""

    def __init__(self, size: int):
        self.size = size
        self.mul, self.add = _factors(LANES, 7)
        self.powers, self.inverse = _powers(_RADIX, BYTES + 1), _powers(_RADIX_INVERSE, BYTES + 1)

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, polynomials) of the words of at most BYTES bytes; no word crosses an offset."""
        n = len(data)
        word = ~_SPACES[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        begin[edges] = word[edges]
        finish = word.copy()
        finish[:-1] &= ~word[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        finish[last] = word[last]
        start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        total = np.zeros(n + 1, U64)
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * self.powers[:n], out=total[1:])
        return start, end - start, (total[end] - total[start]) * self.inverse[start]

    def _long(self, text: bytes) -> np.ndarray:
        """Word hashes of one text of any length, BYTES bytes at a time; a word may cross from one block to the next."""
        out, held, n = [], 0, 0  # polynomial and length of the word that the last block left open
        for at in range(0, len(text), BYTES):
            data = np.frombuffer(text, np.uint8, min(BYTES, len(text) - at), at)
            start, length, poly = self._spans(data, np.array([0, len(data)]))
            whole = length.astype(U64)
            if n and len(start) and start[0] == 0:
                poly[:1] = poly[:1] * U64(pow(_RADIX, n, 1 << 64)) + U64(held)
                whole[0] += U64(n)
            elif n:
                out.append(_mix(np.array([held], U64) + U64(n)))
            held = n = 0
            if len(start) and start[-1] + length[-1] == len(data):
                held, n = int(poly[-1]), int(whole[-1])
                poly, whole = poly[:-1], whole[:-1]
            out.append(_mix(poly + whole))
        if n:
            out.append(_mix(np.array([held], U64) + U64(n)))
        return np.concatenate(out)

    def _shingles(self, words: np.ndarray) -> np.ndarray:
        """The shingle that starts at each word; the last ones reach into nothing."""
        shingle = words * U64(3)
        for j in range(1, self.size):
            step = np.zeros(len(words), U64)
            step[: max(0, len(words) - j)] = words[j:]
            shingle = _mix(shingle ^ (step * U64(2 * j + 3) + U64(j)))
        return shingle

    def _short(self, words: np.ndarray) -> np.uint64:
        """Fewer words than a shingle: all of them."""
        h = U64(len(words))
        for w in words:
            h = _mix(np.array([h ^ w], U64))[0]
        return h

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): each text's distinct shingles, sorted. UTF-8; together at most BYTES bytes, or a single text of any length."""
        k = self.size
        if len(texts) == 1 and len(texts[0]) > BYTES:
            words, parts = self._long(texts[0]), []
            if 0 < len(words) < k:
                parts = [np.array([self._short(words)], U64)]
            for at in range(0, max(0, len(words) - k + 1), 1 << 16):
                part = words[at : at + (1 << 16) + k - 1]
                parts.append(np.unique(self._shingles(part)[: len(part) - k + 1]))
            found = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)
            return found, np.array([len(found)])
        offsets = np.cumsum([0, *map(len, texts)])
        start, length, poly = self._spans(np.frombuffer(b"".join(texts), np.uint8), offsets)
        words = _mix(poly + length.astype(U64))
        bounds = np.searchsorted(start, offsets)
        counts = np.diff(bounds)
        # A shingle at every word; those that would leave their document are dropped, but a short one stands for itself.
        shingle = self._shingles(words)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) - bounds[:-1][doc]
        keep = place + k <= counts[doc]
        for d in np.flatnonzero((counts > 0) & (counts < k)).tolist():
            a, b = bounds[d], bounds[d + 1]
            shingle[a], keep[a] = self._short(words[a:b]), True
        shingle, doc = shingle[keep], doc[keep]
        per = np.bincount(doc, minlength=len(counts))
        out, ends, at = [], np.zeros(len(counts), np.int64), 0
        for d, c in enumerate(per.tolist()):
            if c:
                s = np.sort(shingle[at : at + c])
                at += c
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if c > 1 else s)
                ends[d] = len(out[-1])
        return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(ends)

    def minima(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(documents with a shingle, LANES) minima."""
        starts = np.concatenate(([0], ends[:-1]))
        starts = starts[ends > starts]
        out = np.empty((len(starts), LANES), U32)
        x = (hashes >> U64(32)).astype(U32)
        if len(starts):
            h = np.empty_like(x)
            for lane in range(LANES):
                np.multiply(x, self.mul[lane], out=h)
                np.add(h, self.add[lane], out=h)
                out[:, lane] = np.minimum.reduceat(h, starts)
        return out


def _blocks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of an Arrow array, at most BYTES bytes or one text at a time."""
    import pyarrow.compute

    sizes = pyarrow.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at, n = 0, len(texts)
    while at < n:
        to = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1 : at + 1024]), BYTES - int(sizes[at]), "right")) if sizes[at] <= BYTES else at + 1
        yield at, [t.encode() if t else b"" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def signatures(docs: DataFrame, *, shingle: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest, keys (one 64-bit key a band) and sig (packed low bits); null digest without words."""
    schema = "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>, sig array<bigint>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        work = Shingler(shingle)
        band = _mix(np.arange(1, BANDS + 1, dtype=U64) * U64(_RADIX))
        shift = np.arange(64 // BITS, dtype=U64) * U64(BITS)
        longs = pa.list_(pa.int64())

        def block(doc, raw: list[bytes]):
            hashes, ends = work.sets(raw)
            sizes = np.diff(np.concatenate(([0], ends)))
            full = np.flatnonzero(sizes)
            mins = np.empty((len(full), LANES), U32)
            at = 0
            while at < len(full):  # some thousand shingles at a time stay in the cache while all lanes pass over them
                to = int(np.searchsorted(ends[full], (ends[full[at]] - sizes[full[at]]) + (1 << 15), "right"))
                to = max(at + 1, min(to, len(full)))
                a = int(ends[full[at]] - sizes[full[at]])
                mins[at:to] = work.minima(hashes[a : ends[full[to - 1]]], ends[full[at:to]] - a)
                at = to
            key = np.broadcast_to(band, (len(full), BANDS)).copy()
            for r in range(ROWS):
                key = _mix(key ^ (mins[:, r::ROWS][:, :BANDS].astype(U64) * U64(2 * r + 0x5851F42D4C957F2D)))
            lanes = np.zeros((len(full), WORDS64 * 64 // BITS), U64)
            lanes[:, :LANES] = mins & U32((1 << BITS) - 1)
            packed = np.bitwise_or.reduce(lanes.reshape(len(full), WORDS64, 64 // BITS) << shift, axis=2)
            digest, keys, sig = [None] * len(raw), [None] * len(raw), [None] * len(raw)
            for k, d in enumerate(full.tolist()):
                digest[d] = xxhash.xxh3_128_digest(hashes[ends[d] - sizes[d] : ends[d]].tobytes())
                keys[d], sig[d] = key[k].view(np.int64), packed[k].view(np.int64)
            return pa.RecordBatch.from_arrays([doc, pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, longs), pa.array(sig, longs)], ["doc_id", "n_shingles", "digest", "keys", "sig"])

        for b in batches:
            for at, raw in _blocks(b.column(1)):
                yield block(b.column(0).slice(at, len(raw)), raw)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, ids: DataFrame, *, shingle: int, text: str = "text") -> DataFrame:
    """doc_id and ``shingles``, the sorted 64-bit hashes of the full set, of every non-empty text of the ids; made from whole texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        work = Shingler(shingle)
        for b in batches:
            for at, raw in _blocks(b.column(1)):
                hashes, ends = work.sets(raw)
                begins = np.concatenate(([0], ends[:-1]))
                full = np.flatnonzero(ends > begins)
                sets = [hashes[begins[d] : ends[d]].tobytes() for d in full.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(raw)).take(pa.array(full)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, shingles binary")


def estimate(a: str, b: str) -> Column:
    """Similarity estimated from two packed signatures by bit counts, corrected for lanes that agree by chance."""
    lanes = 64 // BITS
    ones = sum(1 << (BITS * i) for i in range(lanes))
    ones -= 1 << 64 if ones >= 1 << 63 else 0
    differ = None
    for w in range(WORDS64):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        n = F.bit_count(any_bit.bitwiseAND(F.lit(ones).cast("bigint")))
        differ = n if differ is None else differ + n
    chance = 1 / (1 << BITS)
    return (F.lit(1.0) - differ / F.lit(float(LANES)) - F.lit(chance)) / F.lit(1 - chance)


def _possible(percent: int) -> Column:
    """Whether sizes (_na, _nb) and signatures (_sa, _sb) leave the threshold possible."""
    sizes = F.lit(100) * F.least("_na", "_nb") >= F.lit(percent) * F.greatest("_na", "_nb")
    return sizes & (estimate("_sa", "_sb") >= F.lit(LEAST))


def _candidates(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that could reach the threshold, with the size of b's set."""
    left = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("_sa"), F.col("n_shingles").alias("_na"))
    right = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("_sb"), F.col("n_shingles").alias("_nb"))
    near = checkpoint(pairs.join(left, "a")).join(right, "b")
    return checkpoint(near.filter(_possible(percent)).groupBy("a", "b").agg(F.max("_nb").alias("n")))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets one after the other, lengths) of a binary Arrow column."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), U64), np.array([len(r) // 8 for r in raw], np.int64)


def _common(one: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many hashes each set of ``flat`` shares with ``one``; all are sorted and not empty."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(lengths) - lengths)


def confirm(pairs: DataFrame, sets: DataFrame, *, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, n) whose full sets reach the threshold.

    A document's partners are dealt in parts of about ``LOAD`` shingles and two ``BLOCK``s of documents
    at most, and its own set travels once for each part, so neither a document with very many partners nor long ones fill a task.
    """
    parts = checkpoint(pairs.groupBy("a").agg(F.ceil(F.greatest(F.sum("n") / F.lit(LOAD), F.count(F.lit(1)) / F.lit(2 * BLOCK))).cast("int").alias("_parts")))
    dealt = checkpoint(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int").alias("part")))
    partners = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "shingles")
    hubs = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "shingles")

    def run(table):
        import pyarrow as pa

        b, own = table.column("b"), table.column("b").is_null()
        partner = pa.compute.invert(own)
        ids = b.filter(partner).to_numpy()
        flat, lengths = _flat(table.column("shingles").filter(partner))
        good = np.zeros(len(ids), bool)
        for raw in table.column("shingles").filter(own).to_pylist() if len(ids) else []:
            one = np.frombuffer(raw, U64)
            common = _common(one, flat, lengths)
            good |= (common > 0) & (100 * common >= percent * (len(one) + lengths - common))
        found = np.unique(ids[good])
        return pa.table({"a": pa.array(np.full(len(found), table.column("a")[0].as_py()), pa.int64()), "b": pa.array(found, pa.int64())})

    return partners.unionByName(hubs).groupBy("a", "part").applyInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, sigs: DataFrame, *, shingle: int, percent: int, text: str = "text") -> DataFrame:
    """Edges (a, b) that connect every document with all that it reaches; copies hang on their class's smallest id."""
    have = sigs.filter("digest is not null and doc_id is not null")
    classes = checkpoint(have.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "rep"))
    copies = checkpoint(have.select("digest", "doc_id").join(classes, "digest").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), "digest").distinct())
    # A text is out where it is a copy, not its id: other texts of the id stay.
    reps = have.join(copies.select(F.col("b").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_anti")
    copies = copies.select("a", "b")
    members = checkpoint(reps.select("doc_id", F.explode("keys").alias("key")))
    buckets = checkpoint(members.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("_most")).filter("least < _most").select("key", "least"))
    shared = checkpoint(members.join(buckets, "key"))  # members of buckets with more than one
    light = have.select("doc_id", "sig", "n_shingles")
    star = checkpoint(shared.filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct())
    pairs = _candidates(star, light, percent)
    ids = checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    near = checkpoint(confirm(pairs, checkpoint(shingle_sets(docs, ids, shingle=shingle, text=text)), percent=percent))
    named = connected_components(near).select(F.col("node").alias("doc_id"), "component")
    placed = checkpoint(shared.join(named, "doc_id", "left").select("key", "doc_id", "least", F.coalesce("component", "doc_id").alias("component")))
    split = checkpoint(placed.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d"), F.count(F.lit(1)).alias("_n")).filter("_c < _d and _n > 2").select("key"))
    rest = checkpoint(placed.join(split, "key").filter("doc_id <> least").select("least", "doc_id", "component").distinct())
    return near.unionByName(_settle(rest, light, docs, shingle=shingle, percent=percent, text=text)).unionByName(copies)


def _close(sig: np.ndarray, sizes: np.ndarray, comp: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Rows after k of another component that size and signature leave possible, as a mask."""
    ones, rest = U64(sum(1 << (BITS * i) for i in range(64 // BITS))), slice(k + 1, None)
    differ = np.zeros(len(sizes) - k - 1, np.int64)
    for w in range(WORDS64):
        x = sig[rest, w] ^ sig[k, w]
        for s in range(1, BITS):
            x = x | (x >> U64(s))
        differ += np.bitwise_count(x & ones)
    chance = 1 / (1 << BITS)
    close = (1 - differ / LANES - chance) / (1 - chance) >= LEAST
    close &= 100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k])
    return close & (comp[rest] != comp[k])


def _settle(rest: DataFrame, light: DataFrame, docs: DataFrame, *, shingle: int, percent: int, text: str) -> DataFrame:
    """Links (a, b) between documents under one ``least`` that lie in different components.

    Ids and signatures meet first, block by block. A pair of blocks names those of its documents that
    could have a link there, and only their sets are fetched and compared; a block pair that has none
    costs no text. A block holds ``BLOCK`` documents and ``LOAD`` shingles at most, about.
    """
    known = checkpoint(light.join(checkpoint(rest.select("doc_id").distinct()), "doc_id", "left_semi"))
    sized = rest.join(known.groupBy("doc_id").agg(F.max("n_shingles").alias("_n")), "doc_id")
    blocks = checkpoint(sized.groupBy("least").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("_n") / F.lit(LOAD))).cast("int").alias("_blocks")))
    dealt = checkpoint(rest.join(blocks, "least")).join(known, "doc_id").withColumn("_mine", F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select("least", F.least("_mine", "_other").alias("p"), F.greatest("_mine", "_other").alias("q"), "_mine", "doc_id", "component", "n_shingles", "sig")
    columns = "least bigint, p int, q int, _mine int, doc_id bigint, component bigint, n_shingles bigint, sig array<bigint>"

    def arrays(table):
        import pyarrow as pa

        table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable")))
        ids, comp, sizes, mine = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles", "_mine"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().view(U64).reshape(len(ids), WORDS64)
        across = table.column("p")[0].as_py() != table.column("q")[0].as_py()

        def partners(k: int) -> np.ndarray:
            close = _close(sig, sizes, comp, k, percent)
            return np.flatnonzero(close & (mine[k + 1 :] != mine[k]) if across else close) + k + 1

        return table, ids, comp, partners

    def look(table):
        import pyarrow as pa

        table, ids, _, partners = arrays(table)
        wanted = np.zeros(len(ids), bool)
        for k in range(len(ids) - 1):
            others = partners(k)
            if len(others):
                wanted[k] = wanted[others] = True
        return table.filter(pa.array(wanted))

    possible = checkpoint(dealt.groupBy("least", "p", "q").applyInArrow(look, columns))
    if not possible.limit(1).count():
        return possible.select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    sets = checkpoint(shingle_sets(docs, checkpoint(possible.select("doc_id").distinct()), shingle=shingle, text=text))

    def run(table):
        import pyarrow as pa

        table, ids, comp, partners = arrays(table)
        raw, parent = table.column("shingles"), {c: c for c in comp.tolist()}
        of = lambda k: np.frombuffer(raw[k].as_buffer(), U64)

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found_a, found_b = [], []
        for k in range(len(ids) - 1):
            for j in partners(k).tolist():
                a, b = top(int(comp[k])), top(int(comp[j]))
                if a == b:
                    continue
                x, y = of(k), of(j)
                common = int(_common(x, y, np.array([len(y)]))[0])
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    parent[max(a, b)] = min(a, b)
                    found_a.append(int(ids[k]))
                    found_b.append(int(ids[j]))
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    # Of an id with several texts any text's set may give the link, whichever signature named it.
    return checkpoint(possible.join(sets, "doc_id").groupBy("least", "p", "q").applyInArrow(run, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    with scratch(docs.sparkSession) as keep:
        sigs = checkpoint(signatures(docs, shingle=shingle, text=text))
        found = keep(connected_components(links(docs, sigs, shingle=shingle, percent=percent, text=text))).withColumnRenamed("node", "doc_id")
        sigs = keep(checkpoint(sigs.select("doc_id", "n_shingles")))
    out = sigs.select("doc_id", "n_shingles").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
