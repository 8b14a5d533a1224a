"""SentencePiece, packing, token files and WARC against their libraries and round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm import packing, pieces, rangecoder, shared, tokenbin, warc
from rankloom.llm.tokenizing import Encoder

P = pytest.importorskip("public_tokenizers")
random.seed(5)
LETTERS = "ab  \n\t'sZ1é ́İßſΣς \x1c\x85,.!!$K日 don't I'LL \r\n\x0bͅΩẞ▁▁　 🎉\U0010ffff<s></s>theing"
RANDOM = ["".join(random.choice(LETTERS) for _ in range(random.randint(0, 60))) for _ in range(1500)]
RANDOM += ["", None, " ", "a" * 5000, "=" * 300, "word " * 4000, "<|endoftext|> a</s>b", "a\x00b"]


def docs(spark, texts):
    return spark.createDataFrame([(i // 2 if i % 2 else None if i == 0 else i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")


def test_pieces_equal_the_library():
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    own, lib = pieces.Pieces(file), sentencepiece.SentencePieceProcessor(model_file=file)
    ids = own.encode(RANDOM)
    assert [x.tolist() for x in ids] == [lib.encode(t or "") + [2] for t in RANDOM]
    assert [x.decode() for x in own.decode(ids)] == [lib.decode(x.tolist()) for x in ids]
    any_ids = [np.array([random.choice([random.randint(0, 31999), random.randint(3, 258), random.randint(0, 3), 28705, 259]) for _ in range(random.randint(0, 12))], np.int32) for _ in range(1500)]
    assert [x.decode() for x in own.decode(any_ids)] == [lib.decode(x.tolist()) for x in any_ids]


def test_pieces_frames(spark):
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    d = docs(spark, RANDOM[-12:])
    rows = pieces.round_trip_digests(d, file).collect()
    want = []
    for t in RANDOM[-12:]:
        ids = lib.encode(t or "") + [2]
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert sorted(r.text for r in pieces.decode(pieces.encode(d, file), file).collect()) == sorted(lib.decode(lib.encode(t or "")) for t in RANDOM[-12:])
    assert pieces.round_trip_digests(d.limit(0), file).count() == 0


@pytest.mark.parametrize(("file", "words"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(file, words, monkeypatch):
    from rankloom.llm import tokenizing

    monkeypatch.setattr(tokenizing, "CACHE", 500)  # the cache overflows many times
    e = Encoder(P.path(file), words=words)
    assert e.encode(RANDOM * 2) == [e.whole(t or "") for t in RANDOM] * 2
    e.ranked = None
    assert e.encode(RANDOM) == [e.whole(t or "") for t in RANDOM]


@pytest.mark.parametrize(("file", "words", "ids"), [("word_bpe_49k.json", True, [637, 49407, 1237]), ("byte_bpe_50k.json", False, [505, 220, 50256, 734])])
def test_encoder_takes_added_tokens_as_the_untouched_library(file, words, ids):
    from tokenizers import Tokenizer

    lib, e = Tokenizer.from_file(P.path(file)), Encoder(P.path(file), words=words)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "<|startoftext|>a<|endoftext|><|endoftext|> b\n", "ONE<|ENDOFTEXT|>x", "日<|endoftext|>é", "<|endoftext", "plain words", *RANDOM]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == ids
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    e.ranked = None
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want


def test_token_files_hold_added_tokens(spark):
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    texts = ["one <|endoftext|> two", "three", "<|endoftext|>" * 3]
    want = [Tokenizer.from_file(file).encode(t, add_special_tokens=False).ids + [2] for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(tokenbin.read(tokenbin.write(d, file, shared.work_folder(spark, "test")), ids=True).collect(), key=lambda r: r.start)
    assert [list(r.ids) for r in rows] == want
    assert [r.start for r in rows] == [0, len(want[0]), len(want[0]) + len(want[1])]


def test_range_coder():
    rng = np.random.default_rng(3)
    for a in (np.zeros(0, np.uint32), np.array([5]), np.arange(63), np.arange(9000) % 7, rng.integers(0, 50257, 20001), np.full(100_000, 50256), rng.zipf(1.3, 50_000) % 50257):
        data = rangecoder.encode_block(a, 50257)
        assert data == rangecoder.encode_block(a, 50257)
        got, end = rangecoder.decode_block(data, 50257)
        assert got.tolist() == a.tolist()
        assert end == len(data)
    assert len(rangecoder.encode_block(np.arange(9000) % 7, 50257)) < 9000 * 2 / 4  # a quarter of 16 bits an id, lane ends included
    bad = bytearray(data)
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_block(bytes(bad), 50257)


def test_range_coder_beats_order_0():
    """On the documents' ids the coded size is at least a tenth below what the best fixed order-0 code needs."""
    import os

    import pyarrow.parquet as pq

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.frombuffer(b"".join(Encoder(P.path("byte_bpe_50k.json"), words=False).encode(texts)), "<u4")
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    data = rangecoder.encode_block(ids, 50257)
    assert 8 * len(data) / len(ids) < 0.9 * entropy
    assert (rangecoder.decode_block(data, 50257)[0] == ids).all()


def test_range_coder_rebuilds_its_tables_seldom(monkeypatch):
    """The tables of shares cost as much as a step, so in 512 steps they are rebuilt under 40 times (68 before)."""
    calls, refresh = [], rangecoder.Model._refresh
    monkeypatch.setattr(rangecoder.Model, "_refresh", lambda self: (calls.append(self.step), refresh(self))[1])
    rangecoder.encode_block(np.arange(16 * 512) % 7, 50257)
    assert calls[:8] == [0, 1, 2, 4, 8, 16, 24, 32]
    assert calls[-1] > 448
    assert len(calls) < 40


def test_range_coder_extremes():
    """Escapes of the least share to ids of the least interval, any lane lengths, ids at both ends of the vocabulary."""
    rng = np.random.default_rng(9)
    sure = np.zeros(1 << 20, np.int64)
    rare = rng.choice(len(sure), 3000, replace=False)
    sure[rare] = rng.integers(0, 50257, len(rare))
    blocks = [sure, np.where(np.arange(600_000) % 2, 50256, rng.integers(0, 50257, 600_000)), rng.integers(0, 2, 300_000) * 50256]
    blocks += [rng.zipf(1.2, n) % 50257 for n in (1, 511, 512, 1023, 1025, 5121, 77_777)]
    for a in blocks:
        data = rangecoder.encode_block(a, 50257)
        got, end = rangecoder.decode_block(data, 50257)
        assert (got == a).all()
        assert (len(got), end) == (len(a), len(data))
    for n_ids in (1, 2, 5):
        a = rng.integers(0, n_ids, 3000)
        assert (rangecoder.decode_block(rangecoder.encode_block(a, n_ids), n_ids)[0] == a).all()


def test_ranked_makes_no_number_objects():
    """A text's ids come as an array; a list of numbers took 38 bytes an id and a quarter of the time."""
    import tracemalloc

    e = Encoder(P.path("byte_bpe_50k.json"), words=False)
    text = " some words of a longer text, 12 of them;" * 20_000
    n = len(e.encode([text])[0]) // 4
    tracemalloc.start()
    e.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 200_000
    assert peak < 20 * n


def test_ranked_without_added_tokens(tmp_path):
    """A vocabulary without added tokens takes the same path."""
    import json

    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        made = json.load(f)
    made["added_tokens"] = []
    file = tmp_path / "plain.json"
    file.write_text(json.dumps(made), encoding="utf-8")
    e, lib = Encoder(str(file), words=False), Tokenizer.from_file(str(file))
    assert not e.added
    assert e.ranked is not None
    texts = ["one two", "one  two\n", "é<|endoftext|>", *(t for t in RANDOM if t)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_ranked_splits_as_the_library():
    e = Encoder(P.path("byte_bpe_50k.json"), words=False)
    rng = random.Random(6)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", "don't", "'ll", "12", "\n", " ", "\t", "\r\n", "!", "é", "\x1c", "\x0b", "_", "$€"]) for _ in range(rng.randint(0, 12)))
        assert e.encode([t]) == [e.whole(t)], t


def test_token_files(spark):
    file = P.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(None, None, 1), (None, "x" * 100, 1), (3, "", 1), (3, "a b", 1), (3, "a b", 1), (-5, "q" * 2000, 1), (2**40, "zz", 1)], "doc_id bigint, text string, start int")
    folder = shared.work_folder(spark, "test")
    manifest = tokenbin.write(d, file, folder, shard_bytes=60)
    rows = sorted(tokenbin.read(manifest, ids=True).collect(), key=lambda r: r.start)
    e = Encoder(file, words=False)
    assert [r.doc_id for r in rows] == [None, None, -5, 3, 3, 3, 2**40]
    at = 0
    for r in rows:
        data = np.array(r.ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(data))
        at += r.n_tokens
    want = sorted(np.frombuffer(e.whole(t or ""), "<u4").tolist() + [2] for t in (None, "x" * 100, "", "a b", "a b", "q" * 2000, "zz"))
    assert sorted(r.ids for r in rows) == want
    again = tokenbin.write(d.repartition(4), file, shared.work_folder(spark, "test"), shard_bytes=60)
    assert sorted(r.sha256 for r in manifest.collect()) == sorted(r.sha256 for r in again.collect())
    assert tokenbin.round_trip(d.limit(0), file).count() == 0


def plain_best_fit(histogram, capacity):
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(r, i) for i, r in enumerate(bins) if r >= length]
            if fits:
                bins[min(fits)[1]] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


def test_packing_plan():
    for _ in range(150):
        capacity = random.choice([1, 8, 16, 37])
        h = {random.randint(1, capacity): random.randint(1, 12) for _ in range(6)}
        use = defaultdict(list)
        for length, a, b, first, each, off in packing.plan_packing(h, capacity):
            for r in range(a, b):
                use[first + (r - a) // each].append((off + (r - a) % each * length, length))
        assert sum(map(len, use.values())) == sum(h.values())
        for v in use.values():
            at = 0
            for off, length in sorted(v):
                assert off == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in v) for v in use.values()) == plain_best_fit(h, capacity)


def test_packing(spark):
    file = P.path("word_bpe_49k.json")
    texts = [*RANDOM[-60:], "same text", "same text", "word " * 9000]
    rows = packing.pack(docs(spark, texts), file, capacity=64).collect()
    e = Encoder(file, words=True)
    want = []
    for t in texts:
        ids = np.frombuffer(e.whole(t or "") + np.array([1], "<u4").tobytes(), "<u4")
        want += [(k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for v in seq.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 64
    assert packing.pack(docs(spark, texts).limit(0), file).count() == 0


def test_warc(spark):
    long, other = "é" * 600, "m" * 1500
    rows = [(None, None, long), (1, "u", long), (5, "http://x/ü\r\nz", long), (5, None, long), (5, "a", other), (2, "b", other), (3, "c", "short"), (4, "d", "short"), (7, "e", None), (8, "f", "")]
    d = spark.createDataFrame([(*r, 9) for r in rows], "page_id bigint, url string, html string, digest int")
    m = warc.write(d, shared.work_folder(spark, "test"), shard_bytes=2000)
    got = warc.read(m, payload=True).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()  # noqa: E731, S324
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((p or 0, len((t or "").encode()), digest(t)) for p, _, t in rows)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest  # noqa: S324
            assert r.refers_to is None
        else:
            assert r.payload_bytes >= 1000
            assert r.refers_to == 5
    assert sorted(r.record_type for r in got if r.payload_digest == digest(long)) == ["response", "revisit", "revisit", "revisit"]
    again = warc.write(d.repartition(5), shared.work_folder(spark, "test"), shard_bytes=2000)
    assert sorted(r.sha256 for r in m.collect()) == sorted(r.sha256 for r in again.collect())
    assert warc.round_trip(d.limit(0)).count() == 0
    one = bytearray(warc.record(1, "u", b"x"))
    one[-6] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(one))


def test_range_shards(spark):
    """Any 64-bit keys, outliers, hot keys and rows without a key: ranges in order, none much over the target."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    big = 9_223_372_036_854_775_807
    cases = {
        "wide": [-big - 1, -9 * 10**18, 5, 9 * 10**18, big],
        "outlier": [*range(4000), big],
        "both ends": [-big - 1, *range(4000), big],
        "two clusters": [*range(2000), *range(10**15, 10**15 + 2000), -big],
        "hot": [7] * 3000 + list(range(1000)),
        "nulls": [None] * 2000 + [rng.randint(-big, big) for _ in range(2000)],
        "empty": [],
        "one": [42],
    }
    for name, keys in cases.items():
        d = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i bigint")
        shards = shared.range_shards(d, "k", F.lit(1), 100)
        rows = [(r._shard, r.k) for r in shards.assign(d, F.xxhash64("i")).collect()]
        assert len(rows) == len(keys), name
        per = defaultdict(list)
        for s, k in rows:
            per[s].append(k)
        assert all(0 <= s < shards.n for s in per), name
        order = [[k for k in per[s] if k is not None] for s in sorted(per)]
        order = [x for x in order if x]
        assert all(max(a) <= min(b) for a, b in zip(order, order[1:])), name
        assert all(len(v) <= 320 for v in per.values()), (name, max(map(len, per.values())))
        if len(keys) > 3000:
            assert len(per) >= len(keys) // 320, name
        again = shared.range_shards(d.repartition(7), "k", F.lit(1), 100)
        assert sorted(again.leaves) == sorted(shards.leaves), name


def test_archives_and_token_files_with_wide_ids(spark):
    ids = [-9_000_000_000_000_000_000, 5, 9_000_000_000_000_000_000, None, 2**63 - 1, -(2**63)]
    d = spark.createDataFrame([(i, "u", "x" * 1200) for i in ids], "page_id bigint, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(d).collect()}
    assert got == {i: ("response", None) if i == 2**63 - 1 else ("revisit", 2**63 - 1) for i in ids}
    d = spark.createDataFrame([(i, "some words") for i in ids], "doc_id bigint, text string")
    rows = sorted(tokenbin.round_trip(d, P.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_archives_roll_by_compressed_size(spark):
    """At the default shard size, files close when they reach the compressed size, and not before."""
    rng = random.Random(8)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefghij <>/", k=9000))) for i in range(1500)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    m = warc.write(d, shared.work_folder(spark, "test"), file_bytes=1 << 20)
    files = sorted((r.shard, r.file, r.n_bytes) for r in m.collect())
    assert max(s for s, _, _ in files) == 0
    assert len(files) > 3
    assert all(1 << 20 <= n < (1 << 20) + 20_000 for *_, n in files[:-1])
    assert [f for _, f, _ in files] == list(range(len(files)))
    assert sorted(r.page_id for r in warc.read(m).collect()) == list(range(1500))


def test_scratch_tables_of_two_threads(spark):
    """Operators in threads of one driver don't see or delete each other's tables."""
    from concurrent.futures import ThreadPoolExecutor

    def work(k):
        with shared.scratch(spark) as keep:
            inner = shared.checkpoint(spark.range(k))
            with shared.scratch(spark) as keep_inner:
                kept = keep_inner(shared.checkpoint(inner.selectExpr("id + 1 as id")))
            assert inner.count() == k
            return keep(shared.checkpoint(kept)).count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, [3, 5, 7, 9, 11, 13])) == [3, 5, 7, 9, 11, 13]
