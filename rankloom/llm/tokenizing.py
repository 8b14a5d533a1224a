"""Token ids as the tokenizers library gives them, from cached words that its rules never merge across.

Both vocabularies split a text into words before they merge. A word's ids don't depend on its
neighbours, so each distinct word is merged once, together with all new words of its block
(:mod:`.bpe`), and kept in a bounded cache; a text's ids are its words' ids joined. The split is done
here for texts of plain Latin letters, digits, ASCII and a few signs, where it can't depend on a
Unicode version or on normal forms (there tiktoken merges for a byte-level vocabulary whose ids are its
ranks); every other text, and every text that holds an added token such as
``<|endoftext|>``, goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

from .bpe import PairTable, merge_words

#: Words kept for each process; the older half goes when it is full.
CACHE = 400_000
#: Letters whose lower case and composition don't look at their neighbours, whatever the Unicode version.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ž"
_SIGNS = "!-/:-@\\[-`{-~¡-©«-¬®-±´¶-¸»¿×÷‐-‧€"
_PLAIN = re.compile(f"[{_LETTERS}{_SIGNS}0-9\x09-\x0d\x20]*")
_WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_SIGNS}]+")
_BYTE_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[\x09-\x0d\x20]+(?![^\x09-\x0d\x20])|[\x09-\x0d\x20]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it shows, else the next from 256 on."""
    shows = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shows)]
    return {b: chr(b) for b in shows} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The parts that a byte-level vocabulary splits a text into, but for the last one, runs of white space.
_PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"""
#: To see at once where white space stands beside other: each kind becomes x20.
_BLANKS = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f", b" " * 9)


class Ranked:
    """The merges of a byte-level vocabulary as ranks of byte strings, which tiktoken merges without a cache.

    Both libraries' patterns split plain texts alike. Where no white space stands beside another, the
    pattern needs no look ahead, and its engine is then more than half as fast again. ``added``: the
    vocabulary's added tokens; no text that holds one comes here.
    """

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int]):
        import tiktoken

        # without any, the search for them would match everywhere; a text of plain letters can't hold this one
        added = added or {"\U0010ffff": len(ranks)}
        made = lambda last: tiktoken.Encoding("ranked", pat_str=_PARTS + last, mergeable_ranks=ranks, special_tokens=added)
        self.any, self.single = made(r"|\s+(?!\S)|\s+").encode_to_numpy, made(r"|\s+").encode_to_numpy

    def encode(self, text: str) -> bytes:
        """The ids come as an array: a list of numbers would cost a quarter of the time."""
        several = b"  " in text.encode().translate(_BLANKS)
        return (self.any if several else self.single)(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _ranked(vocab: dict[str, int], merges: list[list[str]], letters: dict[int, str], added: dict[str, int]) -> Ranked | None:
    """None where the ids aren't those ranks, which the file alone decides."""
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or sorted(vocab[x] for x in letters.values()) != list(range(256)):
        return None
    back = {x: b for b, x in letters.items()}
    ranks = {bytes(map(back.__getitem__, t)): i for t, i in vocab.items() if i < 256 + len(merges)}
    return Ranked(ranks, added) if len(ranks) == 256 + len(merges) else None


class Encoder:
    """Encodes texts with one vocabulary file; ``words``: it drops white space and marks word ends."""

    def __init__(self, file: str, *, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        #: Texts of the tokens that the library takes out before it splits.
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = list(added)
        self.words = words
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = lambda k: np.array([vocab[m[k]] for m in merges], np.int64)
        self.pairs = PairTable(ids(0), ids(1), np.arange(len(merges)), np.array([vocab[a + b] for a, b in merges]))
        letters, suffix = _byte_letters(), model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.ranked = None if words or suffix else _ranked(vocab, merges, letters, added)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _merge(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        flat, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[flat[ends]]
        ids, counts = merge_words(self.pairs, sym, lengths)
        data, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        self.cache.update(zip(words, (data[a:b] for a, b in zip([0, *end], end)), strict=False))

    def _learn(self, need: set[str]) -> None:
        missing = [w for w in need if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            held = {w: self.cache[w] for w in need if w in self.cache}
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None)) | held
        for at in range(0, len(missing), 1 << 16):
            self._merge(missing[at : at + (1 << 16)])

    def _split(self, text: str | None) -> list[str] | None:
        if not text:
            return []
        if not _PLAIN.fullmatch(text) or self._holds_added(text):
            return None
        return _WORD_PARTS.findall(text.lower()) if self.words else _BYTE_PARTS.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; a null text is empty."""
        if self.ranked is not None:
            ids = self.ranked.encode
            return [(ids(t) if (t.isascii() or _PLAIN.fullmatch(t)) and not self._holds_added(t) else self.whole(t)) if t else b"" for t in texts]
        out, at = [], 0
        while at < len(texts):  # about 2 MB at a time: what a step needs stays in the cache until it is used
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= 4 << 20):
                size += len(texts[end] or "")
                end += 1
            split = [self._split(t) for t in texts[at:end]]
            self._learn(set().union(*(x for x in split if x)))
            get = self.cache.__getitem__
            out += [self.whole(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts[at:end], split, strict=True)]
            at = end
        return out


@lru_cache(maxsize=4)
def encoder(file: str, words: bool) -> Encoder:
    return Encoder(file, words=words)
