"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own: the model starts empty, the ids' checksum stands in front. Its ids lie
in lanes, consecutive runs of the block, each with a range coder of its own; a step codes the next
id of every lane, so all arithmetic is on arrays, and all lanes share and teach one model:

* order 2 keeps, for each hash of the last two ids, the two ids that followed most, with counts;
* order 1 keeps the four ids that followed the last id most, with counts, most frequent first;
* order 0 gives every id a probability from the counts of the ids that neither order names;
* the mixer turns the state of both orders (their counts, and where order 2's first id stands in order
  1) into the shares of the probability that each named id and order 0 get, from how often each was
  right in that state before.

An id is coded as the named id that was right, or as an escape and its order-0 interval. The
coder keeps a 64-bit low end and a range of at least 2^32 between ids, narrows it by both parts of an
escape at once, and writes 32-bit words with carries. Choices are made by masks, not branches, whose
mispredictions would cost more than the arithmetic. Of lanes that teach one row of order 2 in one step
the last one counts.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

LANES = 8192
BLOCK_IDS = 4 << 20
#: Shares are 16-bit, order-0 intervals 20-bit numbers.
SHARE, ZERO = 16, 20
#: Least share of an escape: a range of 2^32 still has 2^ZERO parts inside it.
LEAST = 64
_HASH_BITS = 18
_TOP = 1 << 32
_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"TKB3"
U64 = np.uint64
#: Slots of a row; a slot is an id above its count, which COUNT bounds. Outcomes: a hit in each slot, or none.
TWO, ONE, COUNT, _BITS = 2, 4, 15, 4
HITS = TWO + ONE
#: State of both orders from the counts of their first two slots: of order 2 (8 x 3 states), of order 1 (6 x 3).
_PAIR = np.arange(256)
_FIRST = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 6, 6, 7])[_PAIR >> 4]
_SECOND = np.minimum((_PAIR & 15) + 1, 4) // 2
_LEAD = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5])[_PAIR >> 4]
_SPREAD = ((_PAIR & 15) > 0) + (2 * (_PAIR & 15) > (_PAIR >> 4))
KINDS = 24 * 18 * 4
_STATE = (((_FIRST * 3 + _SECOND) * 18)[:, None] + _LEAD * 3 + _SPREAD).ravel().astype(np.int16) * np.int16(HITS + 1)
_PLACE = np.int16(24 * 18 * (HITS + 1))


def _blend(where: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a where it holds and b elsewhere, the other way round) of 32-bit numbers, without a branch."""
    swap = where.astype(np.int32)
    np.negative(swap, out=swap)
    swap &= a ^ b
    return b ^ swap, a ^ swap


class Model:
    """What coder and decoder know after the steps so far."""

    def __init__(self, n_ids: int, decodes: bool = False):
        self.n, self.decodes = n_ids, decodes
        empty = n_ids << _BITS  # an id that never comes, never seen
        self.two = np.full(TWO << _HASH_BITS, empty, np.int32).view(np.int64)  # a row is read and written as one number
        self.one = np.full(ONE * (n_ids + 1), empty, np.int32)
        self.rows = self.one.reshape(-1, ONE)
        self.seen = self._beliefs()
        self.counts = np.zeros(n_ids, np.int64)
        self.step, self.next, self.waiting, self.outcomes = 0, 0, [], []
        self._refresh()

    @staticmethod
    def _beliefs() -> np.ndarray:
        """Outcomes by state before anything was seen: order 2 in line with its counts, then order 1, the rest escapes."""
        state = np.arange(KINDS) % (24 * 18)
        first, second, lead = state // 54, state // 18 % 3, state // 3 % 6
        out = np.full((KINDS, HITS + 1), 0.02)
        out[:, 0] += 1.2 * first / (first + 2.0)
        out[:, 1] += 0.15 * second
        out[:, 2] += 0.1 * lead
        out[:, 3:HITS] += 0.02 * lead[:, None]
        out[:, HITS] += 1.0
        return out

    def _refresh(self) -> None:
        """Shares of all outcomes in every state, and order 0's intervals, from what was counted."""
        if self.outcomes:
            self.seen += np.bincount(np.concatenate(self.outcomes), minlength=self.seen.size).reshape(self.seen.shape)
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=self.n)
            self.waiting, self.outcomes = [], []
        share = (self.seen * (((1 << SHARE) - 8 * HITS - LEAST) / self.seen.sum(axis=1, keepdims=True))).astype(np.int64) + 8
        share[:, HITS] += (1 << SHARE) - share.sum(axis=1)
        begin = np.cumsum(share, axis=1) - share
        self.share, self.begin = share.ravel().astype(U64), begin.ravel().astype(U64)
        total = int(self.counts.sum())
        free = (1 << ZERO) - self.n
        size = 1 + (self.counts * (free / total)).astype(np.int64) if total else np.full(self.n, 1 + free // self.n)  # their sum is 2^ZERO at most
        ends = np.cumsum(size)
        self.spans = (ends - size << 32 | size).astype(U64)  # begin and size, read at once
        if self.decodes:  # the id that owns every fourth place of the scale, and where each outcome but the first begins
            self.ends = ends.astype(np.int32)
            self.owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends + 3 >> 2, prepend=0))
            narrow = begin.ravel().astype(np.uint16)
            self.later = [narrow[k:] for k in range(1, HITS + 1)]

    def owner_of(self, place: np.ndarray) -> np.ndarray:
        """The id whose order-0 interval holds each place of the scale."""
        ids = self.owner.take(place >> 2, mode="clip")
        later = np.flatnonzero(self.ends.take(ids, mode="clip") <= place)
        while len(later):
            ids[later] += 1
            later = later[self.ends[ids[later]] <= place[later]]
        return ids

    def predict(self, last2: np.ndarray, last1: np.ndarray) -> np.ndarray:
        """Where the shares of the lanes' states begin; ``named`` holds the ids that the orders name, slot by slot."""
        at2 = (last2 * np.int32(-1640531535) + last1 * np.int32(-2048144789)) >> np.int32(7) & np.int32((1 << _HASH_BITS) - 1)
        self.at2, row1 = at2.astype(np.intp), last1.astype(np.intp)  # places are word-sized: others would be converted
        self.at1 = row1 * ONE
        self.e = e = np.empty((HITS, len(last1)), np.int32)
        e[:TWO] = self.two[self.at2].view(np.int32).reshape(-1, TWO).T
        e[TWO:] = self.rows.take(row1, axis=0, mode="clip").T
        self.named = named = e >> _BITS
        self.c = c = e[:4] & COUNT
        pairs = (c[0] << 4 | c[1]) << 8
        pairs |= c[2] << 4
        pairs |= c[3]
        top = named[0]
        place = ((top == named[4]) | (top == named[5])).view(np.int8) * np.int8(3)
        place += (top == named[2]).view(np.int8)
        place += (top == named[3]).view(np.int8) * np.int8(2)
        place &= np.int8(3)
        state = _STATE.take(pairs.astype(np.intp), mode="clip")
        state += place * _PLACE
        return state.astype(np.intp)

    def outcome(self, ids: np.ndarray) -> np.ndarray:
        """The slot that names each id first, HITS for none."""
        self.right = right = self.named == ids
        a = right[2]
        b = a | right[3]
        c = b | right[4]
        self.one_right = any1 = c | right[5]
        self.slot1 = slot1 = np.int8(ONE - 1) - a.view(np.int8) - b.view(np.int8) - c.view(np.int8)
        first = right[0]
        self.two_right = any2 = first | right[1]
        hit = slot1 + np.int8(TWO)  # a miss names the last slot
        hit += ~any1
        hit *= ~any2
        hit += any2 & ~first
        return hit

    def _teach_two(self, fresh: np.ndarray) -> None:
        """Count a hit in its slot; a miss wears the second slot down, then takes it. It moves up once it isn't below the first."""
        first, missed = self.right[0], ~self.two_right
        c0, c1 = self.c[0], self.c[1]
        top = self.e[0] + (first & (c0 < COUNT))
        other = self.e[1] + (self.two_right & ~first & (c1 < COUNT))
        other -= missed
        _, other = _blend(missed & (c1 <= 1), other, fresh)
        up = (other & COUNT) >= c0
        up &= ~first
        rows = np.empty((len(fresh), TWO), np.int32)
        rows[:, 0], rows[:, 1] = _blend(up, other, top)
        self.two[self.at2] = rows.view(np.int64).ravel()

    def _teach_one(self, fresh: np.ndarray) -> None:
        """Count a hit in its slot; a miss wears the last slot down, then takes it. A slot moves up once its count is higher."""
        table, right, missed = self.one, self.one_right, ~self.one_right
        at = self.at1 + self.slot1
        old = table[at]
        count = old & COUNT
        new = old + (right & (count < COUNT))
        new -= missed
        _, new = _blend(missed & (count <= 1), new, fresh)
        inner = self.slot1 > 0
        before = at - inner
        above = table[before]
        up = (new & COUNT) > (above & COUNT)
        up &= inner
        first, second = _blend(up, new, above)
        table[before] = first
        table[at] = second

    def learn(self, ids: np.ndarray, place: np.ndarray, missed: np.ndarray) -> None:
        """place: the outcome's place among the shares; missed: the ids that no slot named."""
        fresh = ids << _BITS | 1
        self._teach_two(fresh)
        self._teach_one(fresh)
        self.outcomes.append(place)
        self.waiting.append(missed)
        self.step += 1
        if self.step >= self.next:  # after steps 1, 2, 4, 8, then every eighth, and from 64 on once an eighth more is known
            self.next = self.step + max(min(8, self.step), self.step // 8)
            self._refresh()


def _lanes(n: int) -> tuple[int, int, int]:
    """(lanes, steps, lanes that have an id in the last step)."""
    lanes = max(1, min(LANES, n // 512))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _tiles(ids: np.ndarray, grid: np.ndarray, full: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Views of the same places in the ids of some lanes and in the grid of steps, as small as the cache holds."""
    steps, lanes = grid.shape
    cut = full * steps
    for part, g in ((ids[:cut].reshape(full, steps), grid[:, :full]), (ids[cut:].reshape(lanes - full, steps - 1), grid[:-1, full:])):
        for at in range(0, len(part), 64):
            yield part[at : at + 64], g[:, at : at + 64].T


def encode_block(ids: np.ndarray, n_ids: int) -> bytes:
    """One block; at most BLOCK_IDS ids below n_ids."""
    n = len(ids)
    ids = np.ascontiguousarray(ids, "<u4")
    crc = zlib.crc32(ids.tobytes())
    if not n:
        return _HEAD.pack(_MAGIC, 0, 0, crc, 0, zlib.crc32(b""))
    lanes, steps, full = _lanes(n)
    grid = np.zeros((steps, lanes), np.int32)  # by step; the first `full` lanes have one id more
    for a, b in _tiles(ids.astype(np.int32), grid, full):
        b[:] = a
    model = Model(n_ids)
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    width = steps * 5 // 4 + 6
    out, begin_at = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width
    pos = begin_at.copy()
    two, one = np.full(lanes, n_ids, np.int32), np.full(lanes, n_ids, np.int32)

    for s in range(steps):
        m = lanes if s < steps - 1 else full
        x = grid[s, :m]
        state = model.predict(two[:m], one[:m])
        hit = model.outcome(x)
        rest = np.flatnonzero(hit == HITS)
        place = state + hit
        part = rng[:m] >> U64(SHARE)
        begin = model.begin.take(place, mode="clip")
        begin *= part
        part *= model.share.take(place, mode="clip")
        missed = x[rest]
        if len(rest):
            inner, span = part[rest] >> U64(ZERO), model.spans.take(missed, mode="clip")
            begin[rest] += (span >> U64(32)) * inner
            part[rest] = (span & U64(_TOP - 1)) * inner
        bottom = low[:m]
        bottom += begin
        over = bottom < begin
        if over.any():
            where = pos[np.flatnonzero(over)] - 1
            while len(where):
                out[where] += np.uint32(1)
                where = where[out[where] == 0] - 1
        small = np.flatnonzero(part < _TOP)
        if len(small):
            word, at = bottom[small], pos[small]
            out[at] = word >> U64(32)
            pos[small] = at + 1
            bottom[small] = word << U64(32)
            part[small] <<= U64(32)
        rng[:m] = part
        model.learn(x, place, missed)
        two, one = one[:m], x
    out[pos] = low >> U64(32)
    out[pos + 1] = low & U64(_TOP - 1)
    pos += 2 - begin_at
    taken = np.arange(width) < pos[:, None]
    body = pos.astype("<u4").tobytes() + out.reshape(lanes, width)[taken].astype("<u4").tobytes()
    return _HEAD.pack(_MAGIC, n, lanes, crc, len(body), zlib.crc32(body)) + body


def decode_block(data: bytes | memoryview, n_ids: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, where the next block begins); ValueError if a checksum doesn't hold."""
    magic, n, lanes, crc, length, body_crc = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    body = bytes(data[at : at + length])
    if magic != _MAGIC or len(body) != length or zlib.crc32(body) != body_crc:
        raise ValueError("a damaged block")
    if not n:
        return np.zeros(0, "<u4"), at + length
    _, steps, full = _lanes(n)
    counts = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(body, "<u4", offset=4 * lanes)
    words = np.append(words, np.zeros(2, "<u4"))
    pos = np.cumsum(counts) - counts
    val = words[pos].astype(U64) << U64(32) | words[pos + 1]
    pos += 2
    rng = np.full(lanes, 2**64 - 1, U64)
    model = Model(n_ids, decodes=True)
    grid = np.zeros((steps, lanes), np.int32)
    two, one = np.full(lanes, n_ids, np.int32), np.full(lanes, n_ids, np.int32)
    lane = np.arange(lanes)
    for s in range(steps):
        m = lanes if s < steps - 1 else full
        state = model.predict(two[:m], one[:m])
        part = rng[:m] >> U64(SHARE)
        target = np.minimum(val[:m] // part, U64((1 << SHARE) - 1)).astype(np.uint16)
        slot = np.zeros(m, np.int8)
        for begins in model.later:
            slot += target >= begins.take(state, mode="clip")
        rest = np.flatnonzero(slot == HITS)
        place = state + slot
        x = model.named.ravel().take(np.minimum(slot, np.int8(HITS - 1)) * np.intp(m) + lane[:m], mode="clip")
        v = val[:m] - model.begin.take(place, mode="clip") * part
        part *= model.share.take(place, mode="clip")
        missed = x[:0]
        if len(rest):
            inner, w = part[rest] >> U64(ZERO), v[rest]
            missed = model.owner_of((w // inner).astype(np.intp))
            span = model.spans.take(missed, mode="clip")
            v[rest], part[rest], x[rest] = w - (span >> U64(32)) * inner, (span & U64(_TOP - 1)) * inner, missed
        small = np.flatnonzero(part < _TOP)
        if len(small):
            at_word = pos[small]
            v[small] = v[small] << U64(32) | words[at_word]
            part[small] <<= U64(32)
            pos[small] = at_word + 1
        val[:m], rng[:m] = v, part
        grid[s, :m] = x
        model.outcome(x)
        model.learn(x, place, missed)
        two, one = one[:m], x
    out = np.empty(n, np.int32)
    for a, b in _tiles(out, grid, full):
        a[:] = b
    ids = out.astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's ids don't have their checksum")
    return ids, at + length
