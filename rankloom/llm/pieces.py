"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The model's piece table is read once for each process. Encoding turns spaces to the meta symbol,
cuts the text where no piece can reach across (no piece holds a meta symbol after another letter),
and merges all distinct units of a block of texts together: flat arrays of symbols, the least pair
rank of each word as a segmented minimum, all leftmost merges of a round at once, gaps closed, until
no pair is left (:mod:`.bpe`). Decoding gathers the pieces' bytes for all ids of a block at once.

Defined results: a null or empty text has no pieces but the end id; letters the model doesn't know
become byte pieces; ids that aren't characters' bytes decode to U+FFFD as the library does; repeated
rows are encoded row by row. Texts are read whole; a block holds about 2 MB of text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairTable, merge_words

META = "▁"
#: Units kept for each process; the older half goes when it is full.
CACHE = 250_000
BLOCK = 2 << 20
#: Rows of a batch that are in Python at a time.
SLICE = 512


class Pieces:
    """Encoder and decoder over one model file."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(text) if plain[i]}
        order = sorted(ids.values(), key=lambda i: -model.get_score(i))
        rank = {text[i]: k for k, i in enumerate(order)}
        # Letters that stand in pieces but are none themselves get ids beyond the model's.
        letters = {c for p in ids for c in p}
        self.n, extra = n, sorted(letters - ids.keys())
        sym = ids | {c: n + k for k, c in enumerate(extra)}
        self.extra = np.array([ord(c) for c in extra], np.int64)
        pairs = [(sym[p[:k]], sym[p[k:]], rank[p]) for p in ids if len(p) > 1 for k in range(1, len(p)) if p[:k] in sym and p[k:] in sym]
        left, right, ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pairs = PairTable(left, right, ranks, np.array(order))
        self.bmp = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.bmp[ord(c)] = sym[c]
        near = sorted({ord(p[k]) << 21 | ord(p[k + 1]) for p in ids for k in range(len(p) - 1)})
        self.near = np.array(near, np.int64)
        # A unit: meta symbols and what follows them. A line end is one of its own where no piece holds it with others.
        if any(META in p.lstrip(META) for p in ids):
            self.unit = re.compile(r"(?s).+")
        elif any("\n" in p and len(p) > 1 for p in ids):
            self.unit = re.compile(f"{META}+[^{META}]*|[^{META}]+")
        else:
            self.unit = re.compile(f"{META}+[^{META}\n]*|[^{META}\n]+|\n+")
        self.byte = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(text[i][1:-1], 16)] = i
        self.unknown, self.end = model.unk_id(), model.eos_id()
        # For decoding: each id's bytes, one after the other.
        surface = model.decode([self.unknown]) if self.unknown >= 0 else ""
        raw = [text[i].replace(META, " ").encode() if plain[i] else surface.encode() if model.is_unknown(i) else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            if i >= 0:
                raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte[self.byte >= 0]] = True
        self.leads = np.array([plain[i] and text[i].startswith(META) for i in range(n)])
        self.silent = np.array([model.is_control(i) for i in range(n)])
        self.cache: dict[str, bytes] = {}

    # -- encoding
    def _merge(self, units: list[str]) -> None:
        lengths = np.array([len(u) for u in units])
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        sym = self.bmp[code]
        # Words end where two letters never stand together in a piece: shorter words, fewer rounds.
        begin = np.zeros(len(code), bool)
        begin[np.cumsum(lengths) - lengths] = True
        two = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.near, two), len(self.near) - 1)
        begin[1:] |= self.near[at] != two
        first = np.flatnonzero(begin)
        owner = np.cumsum(np.isin(first, np.cumsum(lengths) - lengths)) - 1
        out, counts = merge_words(self.pairs, np.where(sym < 0, -1 - code, sym), np.diff(np.append(first, len(code))))
        per = np.bincount(owner, counts, len(units)).astype(np.int64)
        odd = (out < 0) | (out >= self.n)
        if odd.any():  # letters without a piece: their bytes
            made, where = [], np.flatnonzero(odd)
            unit_of = np.repeat(np.arange(len(units)), per)
            last = 0
            for k in where.tolist():
                c = -1 - int(out[k]) if out[k] < 0 else int(self.extra[out[k] - self.n])
                ids = self.byte[np.frombuffer(chr(c).encode(), np.uint8)]
                ids = np.array([self.unknown], np.int32) if (ids < 0).any() else ids
                made += [out[last:k], ids]
                per[unit_of[k]] += len(ids) - 1
                last = k + 1
            out = np.concatenate([*made, out[last:]])
        data, end = out.astype("<i4").tobytes(), (4 * np.cumsum(per)).tolist()
        self.cache.update(zip(units, (data[a:b] for a, b in zip([0, *end], end)), strict=False))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        units = [self.unit.findall((META + t.replace(" ", META)) if t else "") for t in texts]
        need = set().union(*units)
        missing = [u for u in need if u not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            keep = dict(islice(self.cache.items(), len(self.cache) // 2, None)) | {u: self.cache[u] for u in need if u in self.cache}
            self.cache = keep
        for at in range(0, len(missing), 1 << 16):
            self._merge(missing[at : at + (1 << 16)])
        get, end = self.cache.__getitem__, np.array([self.end], "<i4").tobytes()
        return [np.frombuffer(b"".join(map(get, u)) + end, "<i4") for u in units]

    # -- decoding
    def decode(self, many: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of each row of ids, as the library's decode(ids) gives."""
        counts = np.array([len(x) for x in many])
        ids = np.concatenate(many) if many else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(many)), counts)
        size = self.size[ids]
        start = self.start[ids]
        # The dummy space that encoding put first goes: it leads the first id that isn't silent.
        spoken = np.flatnonzero(~self.silent[ids])
        lead = spoken[np.concatenate(([True], row[spoken][1:] != row[spoken][:-1]))] if len(spoken) else spoken
        lead = lead[self.leads[ids[lead]]]
        size[lead] -= 1
        start[lead] += 1
        out_at = np.cumsum(size) - size
        total = int(size.sum())
        data = self.data[np.arange(total) + np.repeat(start - out_at, size)].tobytes()
        ends = np.cumsum(np.bincount(row, size, len(many)).astype(np.int64)).tolist()
        parts = [data[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.unique(row[self.is_byte[ids]]).tolist():
            parts[k] = self._checked(parts[k], many[k])
        return parts

    def _checked(self, data: bytes, ids: np.ndarray) -> bytes:
        """Each byte of a byte piece that isn't part of a character becomes U+FFFD."""
        try:
            if self.silent[ids[:-1]].any():  # it parts byte pieces that would else make one character
                raise UnicodeDecodeError("utf-8", b"", 0, 0, "")
            data.decode()
            return data
        except UnicodeDecodeError:
            out, run = [], bytearray()

            def flush() -> None:
                at = 0
                while at < len(run):
                    for n in (1, 2, 3, 4):
                        try:
                            out.append(bytes(run[at : at + n]).decode().encode())
                            at += n
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�".encode())
                        at += 1
                run.clear()

            for k, i in enumerate(ids.tolist()):
                if self.is_byte[i]:
                    run += self.data[self.start[i] : self.start[i] + 1].tobytes()
                    continue
                flush()
                piece = self.data[self.start[i] : self.start[i] + self.size[i]].tobytes()
                first = not self.silent[ids[:k]].size or self.silent[ids[:k]].all()
                out.append(piece[1:] if first and self.leads[i] else piece)
            flush()
            return b"".join(out)


@lru_cache(maxsize=2)
def pieces(file: str) -> Pieces:
    return Pieces(file)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BLOCK):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, file: str, *, text: str = "text") -> DataFrame:
    """doc_id and ``ids``, the end id last."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = pieces(file)
        for b in (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE)):
            doc, texts = b.column(0), b.column(1).to_pylist()
            for at, end in _blocks(texts):
                yield pa.RecordBatch.from_arrays([doc.slice(at, end - at), pa.array(p.encode(texts[at:end]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id and ``text`` from ``ids``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = pieces(file)
        for b in batches:
            ids = [np.array(x or [], np.int32) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode() for x in p.decode(ids)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip_digests(docs: DataFrame, file: str, *, text: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p, sha = pieces(file), lambda x: hashlib.sha256(x).hexdigest()
        decimal = [str(i) for i in range(p.n)].__getitem__
        for b in (batch.slice(k, SLICE) for batch in batches for k in range(0, batch.num_rows, SLICE)):
            texts, rows = b.column(1).to_pylist(), ([], [], [])
            for at, end in _blocks(texts):
                ids = p.encode(texts[at:end])
                rows[0].extend(map(len, ids))
                rows[1].extend(sha(" ".join(map(decimal, x.tolist())).encode()) for x in ids)
                rows[2].extend(map(sha, p.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).alias("text")).mapInArrow(run, schema)
