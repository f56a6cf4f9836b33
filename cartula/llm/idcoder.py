"""Token ids in binary files, packed in phrases by adaptive context mixing and an entropy coder.

A segment opens with its book: the ids that come in it, phrases (pairs of ids or of earlier
phrases that come ``OFTEN`` times at least; within the tokenizer's words first, then across
them), how often each comes (order 0), and which follow one another ``OFTEN`` times at least
(order 1). What is coded are numbers of this book, half as many as the ids. Blocks of them
start from the book alone, have a checksum of their ids and are coded side by side: one numpy
step codes the next number of every block. In a block each number is foretold by the one that
last followed the two before it there (order 2), by order 1 of the one before it, and by order
0. Adaptive counts of which of the three was right, of all blocks and of this block, for the
trust that order 2 has earned just now, are mixed to frequencies every ``STEPS`` steps; the
number itself takes what the order that has it says of it. A range coder of 64-bit states
(asymmetric numeral systems) makes one 32-bit word or none of each number; blocks side by side
share one stream of words.

A segment is ``MAGIC``, version, its checksum, counts, an index of documents (id, null flag,
number of ids), the checksums of the blocks, the book, and streams with the last states of
their blocks; the files are tables of segments (part, segment, n_ids, payload) in ascending
order of documents. Ids are any unsigned numbers of 32 bits; where a segment has very many of
them, their halves are coded.

Defined results: a null or empty text is its end id alone; null document ids come first;
repeated rows are documents that follow one another, ties by a hash of the text; an empty
table makes files without segments and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import random
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartula.llm.common import checkpoint, parts, remove_at_end, scratch, small_batches

MAGIC, VERSION = b"IDRC", 3
#: Numbers of a block, about; bytes of the texts of a segment, about; blocks coded side by side.
BLOCK, SEGMENT, LANES = 1024, 20 << 20, 4096
END = 2
#: Times that a pair comes in a segment to be a phrase, or to be in order 1.
OFTEN = 8
#: Times that pairs are sought within words, and across them.
WITHIN, ACROSS = 2, 1
#: Ids, and phrases, of a book at most.
MOST = 1 << 17
#: Steps from one mixing of counts to the next.
STEPS = 32

_U = np.uint64
_WORD = _U(32)
#: Bits of the mixed frequencies, of the totals of order 1, and of the table of order 2.
_EVENT, _BITS1, _BITS2 = 12, 15, 10
#: What the counts start from, by trust: order 2 is right, order 1 has it, order 0 must say.
_BUCKETS = 22
_FIRST = np.array([(1, 3, 28), (8, 3, 5), (12, 2, 2), (30, 1, 1)], np.int64)


def _shares(counts: np.ndarray, totals, room, n) -> np.ndarray:
    """Frequencies of at least 1 in proportion to the counts; those of one total take room at most."""
    return 1 + counts * (room - n) // totals


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first, first + 1 ... of each, size of them, one after another."""
    ends = np.cumsum(size)
    total, top = int(ends[-1]) if len(ends) else 0, int(first.max(initial=0))
    kind = np.int32 if total + top < 1 << 31 else np.int64
    places = np.repeat((first - ends + size).astype(kind), size)
    places += np.arange(total, dtype=kind)
    return places


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte of all, packed."""
    made = zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)
    return struct.pack("<II", len(x), len(made)) + made


def _unplanes(packed: bytes, at: int) -> tuple[np.ndarray, int]:
    n, size = struct.unpack_from("<II", packed, at)
    planes = np.frombuffer(zlib.decompress(packed[at + 8 : at + 8 + size]), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64), at + 8 + size


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that come, ascending, and the place of each among them."""
    if ids.max(initial=0) >= 1 << 24:
        return np.unique(ids, return_inverse=True)
    found = np.flatnonzero(np.bincount(ids))
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    rank_of[found] = np.arange(len(found))
    return found, rank_of[ids]


class _Pairs:
    """How often pairs of numbers come, counted in buckets by a hash; of pairs that share a bucket only one is seen."""

    def __init__(self, left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None):
        key = (left.astype(np.int64) << 32) | right
        bits = min(_BUCKETS, max(8, len(key).bit_length() + 1))
        self.bucket = ((key.view(_U) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).view(np.int64)
        self.key = np.zeros(1 << bits, np.int64)
        self.key[self.bucket] = key
        self.seen = self.key[self.bucket] == key
        self.weight = weight

    def count(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """By bucket; which is a mask or places; without it the pairs that aren't seen count, too."""
        return np.bincount(self.bucket[which], None if self.weight is None else self.weight[which], len(self.key))

    def numbered(self, which: np.ndarray, kept: np.ndarray):
        """The pairs of the kept buckets, ascending, and the number among them of each of which (places)."""
        found = np.flatnonzero(kept)
        found = found[np.argsort(self.key[found])]
        number = np.zeros(len(self.key), np.int64)
        number[found] = np.arange(len(found))
        return self.key[found] >> 32, self.key[found] & 0xFFFFFFFF, number[self.bucket[which]]


def _joined(x: np.ndarray, n: int, room: int, own: np.ndarray | None = None, weight: np.ndarray | None = None):
    """x with pairs that come OFTEN as one number, from n on; which numbers of x stay; the pairs, room of them at most.

    own: pairs are of one owner; weight: how often each place counts.
    """
    if own is None:
        at, pairs = None, _Pairs(x[:-1], x[1:])
    else:
        at = np.flatnonzero(own[:-1] == own[1:])
        pairs = _Pairs(x[at], x[at + 1], weight[at])
    good = np.flatnonzero(pairs.seen & (pairs.count() >= OFTEN)[pairs.bucket])
    # Of places in a row every second one begins a pair.
    where = good if at is None else at[good]
    k = np.arange(len(where))
    head = np.maximum.accumulate(np.where(np.diff(where, prepend=-2) == 1, 0, k)) if len(k) else k
    every = ((k - head) & 1) == 0
    good, where = good[every], where[every]
    times = pairs.count(good)
    least = OFTEN
    while np.count_nonzero(times >= least) > room:
        least *= 2
    kept = times >= least
    stays = kept[pairs.bucket[good]]
    good, where = good[stays], where[stays]
    left, right, number = pairs.numbered(good, kept)
    stay = np.ones(len(x), bool)
    stay[where + 1] = False
    x = x.copy()
    x[where] = n + number
    return x[stay], stay, left, right


class Book:
    """What the blocks of a segment start from.

    ids are ascending; left, right and rounds: the phrases, of numbers that rounds before made; share (order 0); of
    order 1, by number before and then number: n (how many after each), after, share1. One more number is before each block.
    """

    def __init__(self, ids, left, right, rounds, share, n, after, share1, halves=0):
        self.ids, self.left, self.right, self.rounds, self.share, self.n, self.after, self.share1 = (np.asarray(x, np.int64) for x in (ids, left, right, rounds, share, n, after, share1))
        self.halves, self.bits = halves, self.total_bits(len(self.share))
        self.start = _starts(self.share)
        own = np.repeat(_starts(self.n), self.n)
        so_far = _starts(self.share1)
        self.start1 = so_far - so_far[own] if len(own) else so_far
        up = self.bits - _BITS1
        #: Where each place of order 0, and behind these of order 1, lies in a total of so many bits, and how wide.
        self.begin, self.width = (np.r_[a, b << up].astype(_U) for a, b in ((self.start, self.start1), (self.share, self.share1)))

    @staticmethod
    def total_bits(n: int) -> int:
        return max(18, n.bit_length() + 1)

    @classmethod
    def of(cls, seq: np.ndarray, size: np.ndarray, ids: np.ndarray):
        """The book of a segment of words (numbers; size and ids of each word), and the segment in its numbers."""
        halves, (found, x) = 0, _ranked(ids)
        if len(found) > MOST:
            halves, size = 1, 2 * size
            found, x = _ranked(np.stack([(ids >> 16) + (1 << 16), ids & 0xFFFF], 1).reshape(-1))
        n, pairs = len(found), []
        own, times = np.repeat(np.arange(len(size)), size), np.bincount(seq, minlength=len(size))

        def add(made):
            pairs.append(made)
            return n + len(made[0])

        for _ in range(WITHIN):
            if len(own) == len(size):
                break
            x, stay, *made = _joined(x, n, MOST + len(found) - n, own, times[own])
            own, n = own[stay], add(made)
        size = np.bincount(own, minlength=len(size))
        x = x[_ragged(_starts(size)[seq], size[seq])]
        for _ in range(ACROSS):
            if len(x) > 1:
                x, _, *made = _joined(x, n, MOST + len(found) - n)
                n = add(made)
        count = np.bincount(x, minlength=n)
        share = _shares(count, max(1, len(x)), 1 << cls.total_bits(n), n)
        left, right = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        return (found, left, right, [len(p[0]) for p in pairs], share), halves, x

    @classmethod
    def made(cls, made, halves, rows: np.ndarray):
        """The book with what blocks of numbers (a row each) show of order 1, and what says each of them: its place in order 0, or behind these in order 1."""
        n = len(made[-1])
        before = np.empty_like(rows)
        before[:, 0], before[:, 1:] = n, rows[:, :-1]
        pairs = _Pairs(before.reshape(-1), rows.reshape(-1))
        kept = pairs.count(pairs.seen) >= OFTEN
        known = np.flatnonzero(pairs.seen & kept[pairs.bucket])
        left, right, own = pairs.numbered(known, kept)
        counts = np.bincount(own, minlength=len(left))
        # more than so many that follow one number are left to order 0
        few = np.arange(len(left)) - np.searchsorted(left, left) < 1 << (_BITS1 - 1)
        known, own = known[few[own]], (np.cumsum(few) - 1)[own[few[own]]]
        left, right, counts = left[few], right[few], counts[few]
        said = rows.astype(np.int32).reshape(-1)
        said[known] = n + own
        size = np.bincount(left, minlength=n + 1)
        total = np.bincount(left, counts, n + 1).astype(np.int64)
        return cls(*made, size, right, _shares(counts, total[left], 1 << _BITS1, size[left]), halves), said.reshape(rows.shape)

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them the ids of each number begin and how many they are."""
        ids, first, size, at = self.ids, np.arange(len(self.ids)), np.ones(len(self.ids), np.int64), 0
        for k in self.rounds.tolist():
            left, right = self.left[at : at + k], self.right[at : at + k]
            both = np.stack([left, right], 1).reshape(-1)
            own = size[left] + size[right]
            first = np.r_[first, len(ids) + _starts(own)]
            ids = np.r_[ids, ids[_ragged(first[both], size[both])]]
            size, at = np.r_[size, own], at + k
        return ids, first, size

    def pack(self) -> bytes:
        left = np.concatenate([np.empty(0, np.int64), *(np.diff(x, prepend=0) for x in np.split(self.left, np.cumsum(self.rounds)[:-1]))])
        return b"".join(_planes(x) for x in (np.diff(self.ids, prepend=0), left, self.right, self.rounds, self.share, self.n, self.after, self.share1))

    @classmethod
    def unpack(cls, segment: bytes, at: int, halves: int):
        found = []
        for _ in range(8):
            x, at = _unplanes(segment, at)
            found.append(x)
        found[0] = np.cumsum(found[0])
        found[1] = np.concatenate([np.empty(0, np.int64), *(np.cumsum(x) for x in np.split(found[1], np.cumsum(found[3])[:-1]))])
        return cls(*found, halves), at


class Model:
    """What blocks have learned; what a step updates is seen by the next, what counts of events say by the next mixing."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes, dtype=np.int32)
        self.base, self.at, self.cell = lane << _BITS2, lane << 2, lane << 4
        self.table = np.zeros(lanes << _BITS2, np.int32)
        self.trust = np.zeros(lanes, np.int32)
        self.own, self.all = np.zeros((lanes, 4, 3), np.int32), _FIRST.copy()
        self.events, self.step = np.zeros((STEPS, lanes), np.int32), 0
        self.mix()

    def mix(self):
        """Running sums of the frequencies of order 2 and of orders 2 and 1, by block and trust."""
        if self.step:
            new = np.bincount(self.events.reshape(-1), minlength=len(self.cell) << 4).reshape(-1, 4, 4)[:, :, :3].astype(np.int32)
            self.own += new
            self.all += new.sum(0)
        block = self.own.sum(1, dtype=np.int32)
        mixed = self.own * 2 + (block * 6 // (1 + block.sum(1, dtype=np.int32, keepdims=True)))[:, None] + (1 + 48 * self.all // self.all.sum(1, keepdims=True)).astype(np.int32)
        room, total = (1 << _EVENT) - 3, mixed.sum(2, dtype=np.int32)
        two = 1 + mixed[:, :, 0] * room // total
        self.sums = (two | (two + 1 + mixed[:, :, 1] * room // total) << 16).reshape(-1)

    def places(self, last, before):
        """Where the table has what followed the two."""
        return (((last * 5) ^ (before * 3) ^ (last >> 5)) & ((1 << _BITS2) - 1)) + self.base

    def predict(self):
        return self.sums[self.at + self.trust]

    def update(self, place, x, hit, event):
        self.table[place] = x
        self.events[self.step % STEPS] = self.cell + (self.trust << 2) + event
        self.trust = np.minimum((self.trust + 1) * hit, 3)
        self.step += 1
        if self.step % STEPS == 0:
            self.mix()


def encode_blocks(rows: np.ndarray, said: np.ndarray, book: Book) -> bytes:
    """The stream of blocks, a row each: numbers, and the places in the book that say them."""
    lanes, n = rows.shape
    model, bits = Model(lanes), book.bits
    x = np.ascontiguousarray(rows.T, np.int32)
    said = np.ascontiguousarray(said.T)
    event = np.where(said < len(book.share), np.int32(2), np.int32(1))
    sums = np.empty((n, lanes), np.int32)
    last = before = np.full(lanes, len(book.share), np.int32)
    for k in range(n):
        place = model.places(last, before)
        hit = model.table[place] == x[k]
        sums[k] = model.predict()
        event[k] *= ~hit
        model.update(place, x[k], hit, event[k])
        before, last = last, x[k]
    state, out = np.full(lanes, 1 << 32, _U), []
    whole, total = _U(1 << (_EVENT + bits)), _U(64 - _EVENT - bits)
    for low in range((n - 1) // 64 * 64, -1, -64):  # the last number goes first
        at = slice(low, low + 64)
        e, two, one = event[at], sums[at] & 0xFFFF, sums[at] >> 16
        hit, known = e == 0, e == 1
        own = np.where(hit, two, np.where(known, one - two, (1 << _EVENT) - one)).astype(_U)
        first = np.where(hit, 0, np.where(known, two, one)).astype(_U)
        width = own * np.where(hit, _U(1 << bits), book.width[said[at]])
        begin = (first << _U(bits)) + own * np.where(hit, _U(0), book.begin[said[at]])
        limit, gap = width << total, whole - width
        for w, b, m, g in zip(width[::-1], begin[::-1], limit[::-1], gap[::-1]):
            full = state >= m
            out.append(state[full].astype("<u4"))
            state >>= full.astype(_U) << _U(5)
            state += (state // w) * g + b
    return state.astype("<u8").tobytes() + np.concatenate([np.empty(0, "<u4"), *out[::-1]]).tobytes()


def _finder(starts: np.ndarray, total: int, skip: int):
    """A function that gives the last place in starts that is no more than each target under total; skip low bits
    of targets are looked at only where the others leave a choice."""
    edges = np.searchsorted(starts, np.arange((total >> skip) + 2) << skip, "right") - 1
    low, high = np.maximum(edges[:-1], 0).astype(np.int32), edges[1:].astype(np.int32)

    def find(target):
        cell = np.minimum(target >> skip, len(low) - 1)
        found = low[cell]
        open_ = np.flatnonzero(high[cell] > found)
        if len(open_):
            found[open_] = np.maximum(np.searchsorted(starts, target[open_], "right") - 1, 0)
        return found

    return find


def decode_blocks(stream: bytes, lanes: int, n: int, book: Book) -> np.ndarray:
    """The n numbers of each block."""
    state = np.frombuffer(stream, "<u8", lanes).astype(_U)
    words = np.r_[np.frombuffer(stream, "<u4", offset=8 * lanes), np.zeros(lanes, "<u4")].astype(_U)
    model, bits, pos, most = Model(lanes), book.bits, 0, len(words) - lanes
    out = np.empty((n, lanes), np.int32)
    number = np.repeat(np.arange(len(book.share), dtype=np.int32), book.share)
    number = np.r_[number, np.full((1 << bits) - len(number), max(0, len(book.share) - 1), np.int32)]
    known_from, up = len(book.share), bits - _BITS1
    both = (book.begin << _WORD) | book.width
    find1 = _finder((np.repeat(np.arange(len(book.n)), book.n) << _BITS1) + book.start1, len(book.n) << _BITS1, _BITS1 - 4)
    bits_, whole, mask = _U(bits), _U(_EVENT + bits), _U((1 << (_EVENT + bits)) - 1)
    half, full = _U(0xFFFFFFFF), np.int64(1 << _EVENT)
    last = before = np.full(lanes, len(book.share), np.int32)
    for k in range(n):
        place = model.places(last, before)
        sums = model.predict()
        slot = (state & mask).view(np.int64)
        one = sums >> 16
        at = slot >> bits
        # As if order 0 said all of them; the others are put right.
        own = full - one
        x = number[np.maximum(((slot - (one.astype(np.int64) << bits)) / own).astype(np.int64), 0)]
        say = both[x]
        first, own = one.astype(_U), own.view(_U)
        event = np.full(lanes, 2, np.int32)
        rest = np.flatnonzero(at < one)
        if len(rest):
            two = sums[rest] & 0xFFFF
            e = (at[rest] >= two).astype(np.int32)
            event[rest] = e
            own[rest] = np.where(e, one[rest] - two, two)
            first[rest] = two * e
            known, hits = rest[e > 0], rest[e == 0]
            x[hits], say[hits] = model.table[place[hits]], _U(1 << bits)
            if len(known) and len(book.after):
                target = (slot[known] - (first[known].view(np.int64) << bits)) // own[known].view(np.int64)
                found = find1((last[known].astype(np.int64) << _BITS1) + (target >> up))
                x[known], say[known] = book.after[found], both[known_from + found]
        state = own * (say & half) * (state >> whole) + slot.view(_U) - (first << bits_) - own * (say >> _WORD)
        low = np.flatnonzero(state <= half)
        state[low] = (state[low] << _WORD) | words[pos : pos + len(low)]
        pos = min(pos + len(low), most)
        out[k] = x
        model.update(place, x, event == 0, event)
        before, last = last, x
    return out.T


def _pack(docs: np.ndarray, seq: np.ndarray, size: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of documents (rows of id, null flag, number of ids), as words: numbers; size and ids of each word."""
    made, halves, x = Book.of(seq, size, ids)
    blocks = -(-len(x) // BLOCK)
    width = max(1, -(-len(x) // max(1, blocks)))
    rows = np.zeros((blocks, width), np.int64)
    rows.reshape(-1)[: len(x)] = x
    book, said = Book.made(made, halves, rows)
    streams = [encode_blocks(rows[k : k + LANES], said[k : k + LANES], book) for k in range(0, blocks, LANES)]
    spelled, first, length = book.spelled()
    own = _unhalved(spelled[_ragged(first[x], length[x])], halves)
    cuts = _cuts(length[x], width, halves)
    sums = np.array([zlib.crc32(own[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], "<u4")
    parts_ = [docs.astype("<i8").tobytes(), sums.tobytes(), book.pack(), *(struct.pack("<Q", len(s)) + s for s in streams)]
    body = struct.pack("<IIIIB", len(docs), blocks, width, len(x), halves) + b"".join(parts_)
    return struct.pack("<4sHI", MAGIC, VERSION, zlib.crc32(body)) + body


def _unhalved(ids: np.ndarray, halves: int) -> np.ndarray:
    if halves:
        ids = ((ids[: len(ids) // 2 * 2 : 2] - (1 << 16)) << 16) | ids[1::2]
    return ids.astype("<u4")


def _cuts(length: np.ndarray, width: int, halves: int) -> list[int]:
    """The places among the ids where blocks begin, and the end."""
    ends = np.cumsum(length)
    return [0, *(-(-np.r_[ends[width - 1 : -1 : max(1, width)], ends[-1]] // (1 + halves))).tolist()] if len(ends) else [0]


def pack(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment of documents (id, token ids)."""
    ids, seq = _ranked(np.concatenate([np.empty(0, np.int64), *(t.astype(np.int64) for _, t in docs)]))
    return _pack(np.array([(i or 0, i is None, len(t)) for i, t in docs], np.int64).reshape(-1, 3), seq, np.ones(len(ids), np.int64), ids)


def unpacked(segment: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a segment (rows of id, null flag, number of ids) and all their ids; every block is held against its checksum."""
    magic, version, crc = struct.unpack_from("<4sHI", segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize("<4sHI")
    if zlib.crc32(memoryview(segment)[at:]) != crc:
        raise ValueError("a segment of token ids is damaged")
    n_docs, blocks, width, n, halves = struct.unpack_from("<IIIIB", segment, at)
    docs = np.frombuffer(segment, "<i8", n_docs * 3, at := at + struct.calcsize("<IIIIB")).reshape(-1, 3)
    sums = np.frombuffer(segment, "<u4", blocks, at := at + docs.nbytes)
    book, at = Book.unpack(segment, at + sums.nbytes, halves)
    found = []
    for k in range(0, blocks, LANES):
        (size,) = struct.unpack_from("<Q", segment, at)
        found.append(decode_blocks(segment[at + 8 : at + 8 + size], min(LANES, blocks - k), width, book).reshape(-1))
        at += 8 + size
    x = np.concatenate([np.empty(0, np.int32), *found])[:n]
    spelled, first, length = book.spelled()
    ids = _unhalved(spelled[_ragged(first[x], length[x])], halves)
    cuts = _cuts(length[x], width, halves)
    if len(ids) != docs[:, 2].sum() or any(zlib.crc32(ids[a:b]) != c for a, b, c in zip(cuts[:-1], cuts[1:], sums.tolist())):
        raise ValueError("a block of token ids is damaged")
    return docs, ids


def unpack(segment: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a segment."""
    docs, ids = unpacked(segment)
    return [(None if null else int(i), ids[e - n : e]) for (i, null, n), e in zip(docs.tolist(), np.cumsum(docs[:, 2]).tolist())]


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each stretch without ASCII white space once.

    For a tokenizer that drops white space these stretches are independent: its normalisation
    and its splitting never reach across white space. That is tried on probes; a tokenizer that
    fails any of them sees whole texts. Stretches of Latin letters alone are given to the same
    model without its normaliser and splitter, in small letters and byte by byte, if the tokenizer
    does no more to them and gives the same ids for probes and for some of the stretches each time.
    """

    #: Stretches that are remembered; texts of stretches that are given to the library at once.
    MOST, TOGETHER = 1_000_000, 256
    #: Stands between stretches; those that have it themselves go one by one.
    MARK = "\x01"
    #: Marks after a letter of ASCII that are looked up apart, if probes show that the tokenizer cuts there.
    MARKS = ".,;:!?"
    LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
    #: Stretches of letters that are tried both ways each time.
    TRIED = 32

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probes = ["ab", "Ab1", "x,", "'s", "́e", "12", "é", "…", "日本", "_", "..", "<|"]
        self.by_stretch = all(one(f"{space}{a}{space}{b}{space}") == one(a) + one(b) for a in probes for b in probes for space in (" ", "\n", "\t  "))
        self.by_mark = self.by_stretch and all(one(f"{a}{m}") == one(a) + one(m) for a in ("ab", "Xyz", "it's", "1st", "éa") for m in self.MARKS)
        mark = one(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: How tokenizers of bytes write each byte; spaces stay.
        self.bytes = "".join(chr(b if b in shown or b == 32 else 256 + hidden.index(b)) for b in range(256))
        said = json.loads(self.tokenizer.to_str())
        self.letters = None
        if self.by_stretch and self.mark is not None and self._small_letters(said):
            self.letters = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
            letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{self.LETTERS}]", c)]
            draw = random.Random(0)
            self._keep_letters(pa.array(letters + ["".join(draw.choices(letters, k=k)) for k in range(2, 22) for _ in range(20)]))
        self._forget()

    @staticmethod
    def _small_letters(said: dict) -> bool:
        """Whether the tokenizer makes all letters small, changes no Latin ones else, and merges bytes."""
        parts_of = lambda x, name: (x or {}).get(name) or ([x] if x else [])
        normal, cut = parts_of(said["normalizer"], "normalizers"), parts_of(said["pre_tokenizer"], "pretokenizers")
        kinds = {x["type"] for x in normal}
        spaces = all(x["pattern"] == {"Regex": r"\s+"} for x in normal if x["type"] == "Replace")
        by_bytes = [x for x in cut if x["type"] == "ByteLevel"]
        return said["model"]["type"] == "BPE" and "Lowercase" in kinds <= {"Lowercase", "NFC", "Replace"} and spaces and len(by_bytes) == 1 and not by_bytes[0]["add_prefix_space"] and {x["type"] for x in cut} <= {"Split", "ByteLevel"}

    def _forget(self) -> None:
        self.known = pa.array([""], pa.string())
        self.ids, self.first, self.size = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _one_by_one(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _new(self, words: pa.Array, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has; letters: they are small letters alone."""
        cuts = [*range(0, len(words), 1 if self.mark is None else self.TOGETHER), len(words)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), f" {self.MARK} ").to_pylist()
        if letters:
            texts = [codecs.charmap_decode(t.encode(), "strict", self.bytes)[0] for t in texts]
        found, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for first, last, e in zip(cuts[:-1], cuts[1:], (self.letters if letters else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            marks = ids == self.mark if last - first > 1 else np.zeros(len(ids), bool)
            at = np.flatnonzero(marks)
            if len(at) == last - first - 1:
                found.append(ids[~marks])
                sizes.append(np.diff(np.r_[-1, at, len(ids)]) - 1)
            else:
                made = self._one_by_one(words[first:last].to_pylist())
                found += made
                sizes.append(np.fromiter(map(len, made), np.int64, len(made)))
        return np.concatenate(found), np.concatenate(sizes)

    def _keep_letters(self, words: pa.Array) -> None:
        """Gives up the way of letters if it gives other ids for the words."""
        if self.letters is not None and len(words):
            ids, size = self._new(pc.utf8_lower(words), True)
            if not all(map(np.array_equal, np.split(ids, np.cumsum(size)[:-1]), self._one_by_one(words.to_pylist()))):
                self.letters = None

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, f"^[{self.LETTERS}]+$")
        self._keep_letters(words.filter(plain)[: self.TRIED])
        plain = plain.to_numpy(zero_copy_only=False) & (self.letters is not None)
        small = pc.utf8_lower(words.filter(pa.array(plain))).dictionary_encode()
        ids, size = self._new(small.dictionary, self.letters is not None)
        others, more = self._new(words.filter(pa.array(~plain)))
        made = np.empty(len(words), np.int64)  # by word, its place among what was made
        made[plain] = small.indices.to_numpy(zero_copy_only=False)
        made[~plain] = len(size) + np.arange(len(more))
        size = np.r_[size, more]
        first = len(self.ids) + _starts(size)
        self.ids = np.concatenate([self.ids, ids, others])
        self.known = pa.concat_arrays([self.known, words])
        self.first, self.size = np.r_[self.first, first[made]], np.r_[self.size, size[made]]

    def words(self, texts: list[str | None] | pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of all texts (numbers), the end id one of them; how many each text has; size and ids of each word."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_stretch:
            made = [np.r_[ids, np.array([end], np.uint32)] for ids in self._one_by_one(column.to_pylist())]
            ids, seq = _ranked(np.concatenate([np.empty(0, np.uint32), *made]))
            return seq, np.fromiter(map(len, made), np.int64, len(made)), np.ones(len(ids), np.int64), ids
        if len(self.known) > self.MOST:
            self._forget()
        if self.by_mark:
            column = pc.replace_substring_regex(column, pattern=rf"([A-Za-z])([{self.MARKS}](?:[ \t-\r]|$))", replacement=r"\1 \2")
        split = pc.ascii_split_whitespace(column)
        seen = split.flatten().dictionary_encode()
        found = pc.index_in(seen.dictionary, value_set=self.known)
        if found.null_count:
            before = len(self.known)
            self._learn(seen.dictionary.filter(pc.is_null(found)))
            place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            place[place < 0] = np.arange(before, len(self.known))
        else:
            place = found.to_numpy(zero_copy_only=False)
        n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        seq = np.full(int(n.sum()), len(place), np.int32)
        inner = np.ones(len(seq), bool)
        inner[np.cumsum(n) - 1] = False
        seq[inner] = seen.indices.to_numpy(zero_copy_only=False)
        size = self.size[place]
        return seq, n, np.r_[size, 1], np.r_[self.ids[_ragged(self.first[place], size)], np.array([end], np.uint32)]

    def encode(self, texts: list[str | None] | pa.Array, end: int = END) -> list[np.ndarray]:
        """The ids of each text, and the end id; null is an empty text."""
        seq, n, size, ids = self.words(texts, end)
        flat = ids[_ragged(_starts(size)[seq], size[seq])].astype(np.uint32)
        return np.split(flat, np.r_[0, np.cumsum(size[seq])][np.cumsum(n)[:-1]]) if len(n) else []


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process: what it has seen serves its later tasks too."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


_SEGMENTS = "part int, segment int, n_ids long, payload binary"


def _segment(encoder: Encoder, held: list[pa.RecordBatch], end: int) -> tuple[int, bytes]:
    """Number of ids, and the segment, of batches of doc_id and text."""
    table = pa.Table.from_batches(held).combine_chunks()
    doc, text = (pa.concat_arrays(c.chunks) for c in table.columns)
    seq, n, size, ids = encoder.words(text, end)
    own = size[seq]
    rows = np.stack([pc.fill_null(doc, 0).to_numpy(), pc.is_null(doc).to_numpy(zero_copy_only=False), np.diff(np.r_[0, np.cumsum(own)[np.cumsum(n) - 1]])], 1)
    return int(own.sum()), _pack(rows, seq[own > 0], size, ids)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Writes the ids of docs (doc_id, text) to path, in ascending order of doc_id."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder, number, held, size = _encoder(tokenizer), 0, [], 0

        def out():
            n, made = _segment(encoder, held, end)
            columns = (pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([made], pa.binary()))
            return pa.RecordBatch.from_arrays([*columns], ["part", "segment", "n_ids", "payload"])

        for b in batches:
            ends, at = size + np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while at < len(ends):
                to = min(int(np.searchsorted(ends, SEGMENT)) + 1, len(ends))  # the document that reaches SEGMENT is the last of its own
                held.append(b.slice(at, to - at))
                at, size = to, int(ends[to - 1])
                if size >= SEGMENT:
                    yield out()
                    number, held, size, ends = number + 1, [], 0, np.where(np.arange(len(ends)) < at, -1, ends - size)
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    ordered.select("doc_id", "text").mapInArrow(run, _SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document in the files."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = checkpoint(sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))  # a row for each part
    own = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("part", "segment", "n_ids").withColumn("ahead", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(F.broadcast(firsts), "part")
    starts = checkpoint(starts.select("part", "segment", (F.col("first") + F.col("ahead")).alias("start")))  # a row for each segment

    def run(batches):
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs, flat = unpacked(payload)
                n = docs[:, 2]
                ends = np.cumsum(n)
                columns = {
                    "doc_id": pa.array(docs[:, 0], mask=docs[:, 1] > 0),
                    "start": pa.array(start + ends - n),
                    "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(flat[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), flat.astype(np.int64))  # ids are unsigned
                yield pa.RecordBatch.from_pydict(columns)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return segments.join(starts, ["part", "segment"]).select("start", "payload").mapInArrow(run, kind)


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files in the shared folder that go when the driver ends."""
    spark = docs.sparkSession
    path = f"{scratch(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    remove_at_end(spark, path)
    return read(spark, path, ids=False)
