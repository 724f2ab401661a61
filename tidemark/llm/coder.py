"""A context-mixing coder for token ids, in independently reset, checksummed blocks.

A block is cut into lanes that are coded side by side, one id of each lane a step, so numpy does a step for all lanes at
once.  All lanes share one model, which learns after every few steps from what they have coded; the decoder learns the
same.  The model is reset for every block.  All arithmetic is on whole numbers, so files do not depend on the machine.

The model predicts an id in two contexts: the last two ids (order 2) and the last id (order 1) each name the id that
followed them last.  How likely the order-2 prediction holds is a logistic mix of three adaptive probabilities: by its
own record, by the order-1 prediction's record and agreement, and by the predicted id's order-0 frequency.  Between two
lessons that depends on few small numbers, so it is a table.  An id that neither predicts is coded by the order-0
frequencies so far.

The lanes' states are those of a range variant of asymmetric numeral systems: what is written last is read first, so a
block is modelled forwards and then written backwards, and all lanes share one stream of words.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"TMK2"
LANES, LANE_IDS = 4096, 128  # at most so many lanes, of so many ids at least
LESSON = 16  # steps after which the model learns; fewer at first
HASHED = 18  # bits of the order-2 table
ORDER0 = 18  # bits of the order-0 shares, more for alphabets beyond 2**16
LOW = 1 << 31  # states stay from here to 2**63; words have 32 bits
SIZES = 16  # classes of order-0 counts, a factor of four each
STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int64)
SQUASH = np.array([min(65472, max(64, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int64)
SURE = np.array([c >> 1 if c > 2 else 0 for c in range(16)] + [min(c + 1, 15) for c in range(16)], np.int64)  # after a miss, a hit


class Model:
    """What is known before a lesson: ``shares`` of 2**16 by context, ``freq`` and ``begin`` of the order-0 shares."""

    def __init__(self, alphabet: int):
        self.counts = np.zeros(alphabet, np.int64)
        self.bits = max(ORDER0, (alphabet - 1).bit_length() + 2)
        self.next1 = np.zeros(alphabet, np.int64)  # the id that followed, times 16, and how sure that is
        self.next2 = np.zeros(1 << HASHED, np.int64)
        self.by_sure2 = np.full(16, 1 << 15, np.int64)
        self.by_sure1 = np.full(32, 1 << 15, np.int64)
        self.by_count = np.full(SIZES, 1 << 15, np.int64)
        self.second = np.full(16, 1 << 15, np.int64)
        self.weights = [26_000] * 3
        self._prepare()

    def _prepare(self) -> None:
        """The tables that follow from what has been learnt."""
        room, total = (1 << self.bits) - len(self.counts), max(1, int(self.counts.sum()))
        self.freq = 1 + self.counts * room // total
        self.freq[self.counts.argmax()] += (1 << self.bits) - int(self.freq.sum())
        self.begin = np.cumsum(self.freq) - self.freq
        exponent = self.counts.astype(np.float64).view(np.int64) >> 52  # 1023 for 1, 0 for 0
        self.size = np.clip((exponent - 1021) >> 1, 0, SIZES - 1) << 9
        by_count, by_sure1, by_sure2 = (STRETCH[t >> 4] for t in (self.by_count, self.by_sure1, self.by_sure2))
        # Contexts: class of the count, whether both predict the same, how sure order 1 and order 2 are.
        self.stretched = by_sure2[None, None, None, :], by_sure1.reshape(1, 2, 16, 1), by_count[:, None, None, None]
        mixed = sum(w * s for w, s in zip(self.weights, self.stretched)) >> 16
        self.share2 = SQUASH[np.clip(mixed, -2048, 2047) + 2048]
        rest = 65536 - self.share2
        share1 = np.clip((rest * self.second[:, None]) >> 16, 1, rest - 1)
        share1[:, 1] = 0
        self.first, self.both = self.share2.ravel(), (self.share2 + share1).ravel()

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places in the order-2 table, the ids predicted by order 2 and order 1, contexts."""
        at2 = ((last * 0x9E3779B1 + before * 0x85EBCA6B) >> 9) & ((1 << HASHED) - 1)
        both2, both1 = self.next2[at2], self.next1[last]
        p2, p1 = both2 >> 4, both1 >> 4
        context = self.size[p2] + ((p1 == p2).astype(np.int64) << 8) + ((both1 & 15) << 4) + (both2 & 15)
        return at2, p2, p1, context

    @staticmethod
    def _adapt(table: np.ndarray, n: np.ndarray, hits: np.ndarray) -> None:
        table += (hits.ravel() * 65536 - n.ravel() * table) // (n.ravel() + 40)
        np.clip(table, 32, 65504, out=table)

    @staticmethod
    def _follow(following: np.ndarray, at: np.ndarray, p: np.ndarray, c: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        following[at] = (np.where(c > 2, p, ids) << 4) | SURE[c + (hit.astype(np.int64) << 4)]

    def learn(self, ids: np.ndarray, last: np.ndarray, at2: np.ndarray, p2: np.ndarray, p1: np.ndarray, context: np.ndarray) -> None:
        """From the ids of some steps, in order, and what was predicted."""
        hit2, hit1 = ids == p2, ids == p1
        shape = (SIZES, 2, 16, 16)
        n, h2, h1 = (np.bincount(c, minlength=SIZES << 9).reshape(shape) for c in (context, context[hit2], context[hit1 & ~hit2]))
        error = (h2 << 16) - n * self.share2
        for k, (s, table, axes) in enumerate(zip(self.stretched, (self.by_sure2, self.by_sure1, self.by_count), ((0, 1, 2), (0, 3), (1, 2, 3)))):
            step = int((s.ravel() * error.sum(axes).ravel()).sum()) // (len(ids) * 256)
            self.weights[k] = min(200_000, max(-200_000, self.weights[k] + step))
            self._adapt(table, n.sum(axes), h2.sum(axes))
        self._adapt(self.second, (n - h2)[:, 0].sum((0, 2)), h1[:, 0].sum((0, 2)))
        self._follow(self.next2, at2, p2, context & 15, hit2, ids)
        self._follow(self.next1, last, p1, (context >> 4) & 15, hit1, ids)
        self.counts += np.bincount(ids, minlength=len(self.counts))
        self._prepare()


def _shape(n: int) -> tuple[int, int, int]:
    """(lanes, ids of every lane, lanes with one id more)."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, n // lanes, n % lanes


def _lessons(n: int) -> Iterator[tuple[int, int]]:
    """Runs of steps between lessons: 1, 1, 2, 4, 8 and then ``LESSON`` each; the last, shorter step is one of its own."""
    _, each, more = _shape(n)
    at = 0
    while at < each:
        to = min(each, at + min(LESSON, max(1, at)))
        yield at, to
        at = to
    if more:
        yield each, each + 1


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each lane begins in the block; how many lanes a step has."""
    lanes, each, more = _shape(n)
    begin = np.arange(lanes) * each + np.minimum(np.arange(lanes), more)
    return begin, np.array([lanes] * each + [more] * (more > 0))


def _encode(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(states of the lanes, words)."""
    begin, active = _places(len(ids))
    model = Model(alphabet)
    # Steps come one after another, with two of zeros in front.
    rows = np.zeros((len(active) + 2, len(begin)), np.int64)
    for step, m in enumerate(active):
        rows[step + 2, :m] = ids[begin[:m] + step]
    steps = []  # of each: start and size of 2**16; which lanes are coded by order 0 as well, start and size of these
    for at, to in _lessons(len(ids)):
        m = active[at]
        now, last, before = (rows[at + k : to + k, :m].ravel() for k in (2, 1, 0))
        at2, p2, p1, context = model.predict(last, before)
        first, second = now == p2, now == p1
        share2, both = model.first[context], model.both[context]
        start = np.where(first, 0, np.where(second, share2, both))
        size = np.where(first, share2, np.where(second, both, 65536) - start).astype(np.uint32)
        start, other = start.astype(np.uint32), ~(first | second)
        for k in range(to - at):
            part = slice(k * m, (k + 1) * m)
            coded = now[part][other[part]]
            steps.append((start[part], size[part], other[part], model.begin[coded].astype(np.uint32), model.freq[coded].astype(np.uint32)))
        model.learn(now, last, at2, p2, p1, context)

    states = np.full(len(begin), LOW, np.uint64)
    words = []

    def push(x: np.ndarray, start: np.ndarray, size: np.ndarray, bits: int) -> np.ndarray:
        size = size.astype(np.uint64)
        full = np.flatnonzero(x >= size << np.uint64(63 - bits))
        words.append(x[full].astype(np.uint32))
        x[full] >>= np.uint64(32)
        times = x // size
        return (times << np.uint64(bits)) + (x - times * size + start)

    for start, size, other, start0, size0 in reversed(steps):
        lanes = np.flatnonzero(other)
        states[lanes] = push(states[lanes], start0, size0, model.bits)
        states[: len(start)] = push(states[: len(start)], start, size, 16)
    return states, np.concatenate(words[::-1])


def _decode(n: int, alphabet: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
    begin, active = _places(n)
    model = Model(alphabet)
    x, words, used = states.astype(np.int64), words.astype(np.int64), 0

    def pop(x: np.ndarray, start: np.ndarray, size: np.ndarray, slot: np.ndarray, bits: int) -> np.ndarray:
        nonlocal used
        x = size * (x >> bits) + (slot - start)
        spent = np.flatnonzero(x < LOW)
        x[spent] = (x[spent] << 32) | words[used : used + len(spent)]
        used += len(spent)
        return x

    rows = np.zeros((len(active) + 2, len(begin)), np.int64)
    for at, to in _lessons(n):
        m = active[at]
        symbol = np.zeros(1 << model.bits, np.int32)
        symbol[model.begin[1:]] = 1
        np.cumsum(symbol, out=symbol)
        seen = []
        for step in range(at, to):
            last = rows[step + 1, :m]
            at2, p2, p1, context = model.predict(last, rows[step, :m])
            share2, both = model.first[context], model.both[context]
            slot = x[:m] & 65535
            first, known = slot < share2, slot < both
            start = np.where(first, 0, np.where(known, share2, both))
            size = np.where(first, share2, np.where(known, both, 65536) - start)
            x[:m] = pop(x[:m], start, size, slot, 16)
            now = np.where(first, p2, p1)
            other = np.flatnonzero(~known)
            slot = x[other] & ((1 << model.bits) - 1)
            now[other] = found = symbol[slot]
            x[other] = pop(x[other], model.begin[found], model.freq[found], slot, model.bits)
            rows[step + 2, :m] = now
            seen.append((now, last, at2, p2, p1, context))
        model.learn(*(np.concatenate(c) for c in zip(*seen)))
    ids = np.empty(n, np.int64)
    for step, m in enumerate(active):
        ids[begin[:m] + step] = rows[step + 2, :m]
    return ids


HEADER = "<4sIIQIII"  # magic, crc32 of the rest, documents, ids, alphabet, words, crc32 of the ids


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Whole documents as one block: index of the documents, states of the lanes, coded ids."""
    ids = ids.astype(np.int64)
    alphabet = int(ids.max()) + 1 if len(ids) else 1
    states, words = _encode(ids, alphabet) if len(ids) else (np.empty(0), np.empty(0))
    body = b"".join(
        [
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<i8").tobytes(),
            states.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    check = zlib.crc32(ids.astype("<u4").tobytes())
    rest = struct.pack(HEADER, MAGIC, 0, len(doc_ids), len(ids), alphabet, len(words), check)[8:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(rest)) + rest


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids); raises ValueError when a checksum does not hold."""
    magic, crc, docs, n, alphabet, size, check = struct.unpack_from(HEADER, data)
    if magic != MAGIC or zlib.crc32(data[8:]) != crc:
        raise ValueError("not a block of token ids, or a damaged one")
    at = struct.calcsize(HEADER)
    missing = np.frombuffer(data, np.uint8, docs, at)
    keys = np.frombuffer(data, "<i8", docs, at + docs)
    lengths = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    lanes = _shape(n)[0] if n else 0
    states = np.frombuffer(data, "<u8", lanes, at)
    ids = _decode(n, alphabet, states, np.frombuffer(data, "<u4", size, at + 8 * lanes)) if n else np.empty(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block of token ids does not decode to what was written")
    return [None if x else int(k) for x, k in zip(missing, keys)], lengths, ids
