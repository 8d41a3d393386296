"""Token ids as binary files: an adaptive context-mixing range coder.

Ids are coded in blocks of ``BLOCK`` ids. A block starts from empty predictions
and carries a checksum, so any block can be decoded with nothing but the
frequencies of its frame, and damage is noticed.

For the next id the model has a prediction from the last two ids (order 2), one
from the last id (order 1) and the frequencies of all ids of the frame (order 0,
fitted to it and written before its blocks). Each prediction has a level that
rises when it was right and falls when it was not and says how likely it is
right again; the two are mixed with a weight that follows which of them has been
right lately. The mixed distribution gives order 2's id, order 1's id and
"another id" adjacent intervals, and the interval of another id is divided by
the order-0 frequencies, so an id is one interval. All arithmetic is on integers.

Blocks are independent, so a task codes the blocks of a frame side by side: one
numpy operation advances all of them by one id, and what levels and weights lead
to is looked up in small tables. Encoder and decoder share the model below and
so see the same state.
"""
from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
#: Blocks that a frame holds at most.
LANES = 8192
U = np.uint64
_BITS32, _LEAST = U(32), U(1 << 32)
#: Ids that a block tells apart as the last one, and slots of each, as powers of two: one for order 1, the others for order 2.
CONTEXTS, SLOTS = 6, 2
_HASH, _HASH2 = np.uint32(2654435761), np.uint32(2246822519)
_DROP, _DROP2 = np.uint32(32 - CONTEXTS), np.uint32(32 - SLOTS)
#: How likely a prediction of each level is right, of 4,096.
CHANCE = np.array([0, 9000, 17000, 24000, 30000, 35000, 39000, 43000, 46000, 49000, 52000, 54000, 56000, 58000, 60000, 62000], np.int64) >> 4
#: The interval of the mix, as a power of two, and the states of the weight.
MIX, STATES = 12, 16
#: Powers of two: the least and the greatest sum of the order-0 frequencies, and how many ids have one of their own.
LEAST_SUM, MOST_SUM, DIRECT = 12, 20, 18


def _mixed() -> tuple[np.ndarray, np.ndarray]:
    """Where order 2's and order 1's intervals end, by weight, order 2's and order 1's level."""
    w, k2, k1 = np.meshgrid(np.arange(STATES) * 16 + 8, np.arange(16), np.arange(16), indexing="ij")
    w = np.where(k2 == 0, 0, np.where(k1 == 0, 256, w))
    first = (w * CHANCE[k2] >> 8).ravel()
    return first, first + ((256 - w) * CHANCE[k1] >> 8).ravel()


FIRST, BOTH = _mixed()


def _intervals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where an id's interval begins, its size, and what another id's frequency is multiplied with to be added to both.

    The place is that of ``FIRST``, two bits lower: behind it stand whether order 2 and whether order 1 is wrong.
    """
    first, both = np.repeat(FIRST, 4), np.repeat(BOTH, 4)
    wrong2, wrong1 = np.tile([0, 0, 1, 1], len(FIRST)), np.tile([0, 1, 0, 1], len(FIRST))
    is2 = (wrong2 == 0) & (first > 0)
    is1 = (wrong1 == 0) & (both > first) & ~is2
    return np.where(is2, 0, np.where(is1, first, both)), np.where(is2, first, np.where(is1, both - first, 0)), np.where(is2 | is1, 0, (1 << MIX) - both)


BEGIN, SIZE, OTHER = (t.astype(U) for t in _intervals())
_STATE = np.arange(STATES)[:, None] + np.array([0, 1, -1, 0])
#: The next weight, by the weight (eight bits up) and whether order 2 and whether order 1 is wrong.
NEXT = np.zeros(STATES << 8, np.int32)
NEXT[(np.arange(STATES)[:, None] << 8) + np.arange(4)] = np.clip(_STATE, 0, STATES - 1) << 8
_LEVEL = np.arange(16)
_ANOTHER = -(1 << 31)
#: By whether it is wrong and the level: what is added to a prediction; what falls below 0 by it gives way to another id.
STEP = np.concatenate([np.where(_LEVEL == 0, _ANOTHER, _LEVEL < 15), np.where(_LEVEL < 2, _ANOTHER, -(_LEVEL + 1 >> 1))]).astype(np.int32)


class Frequencies:
    """Order 0: how often the ids of a frame occur, as whole numbers whose sum is a power of two.

    Of vocabularies beyond ``1 << DIRECT`` an id is its upper bits here; the
    ``low`` bits below are coded as they are.
    """

    def __init__(self, symbols: np.ndarray, size: np.ndarray, vocabulary: int):
        self.low = low_bits(vocabulary)
        self.symbols, self.size = symbols, size
        self.bits = max(0, int(size.sum()) - 1).bit_length()
        most = int(symbols[-1]) + 1 if len(symbols) else 1
        self.size_of, self.start_of = np.zeros(most, U), np.zeros(most, U)
        self.size_of[symbols], self.start_of[symbols] = size, np.cumsum(size) - size

    @classmethod
    def fitted(cls, ids: np.ndarray, vocabulary: int) -> Frequencies:
        times = np.bincount(ids >> low_bits(vocabulary))
        symbols = np.flatnonzero(times)
        times = times[symbols]
        total = 1 << min(MOST_SUM, max(LEAST_SUM, len(symbols).bit_length() + 3))
        size = np.maximum(1, times * (total - len(symbols)) // times.sum())
        # What rounding left over goes to the most frequent id.
        size[np.argmax(times)] += total - int(size.sum())
        return cls(symbols, size, vocabulary)

    def dump(self) -> bytes:
        steps = np.diff(self.symbols, prepend=0)
        return zlib.compress(np.concatenate([steps, self.size]).astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes(), 6)

    @classmethod
    def load(cls, data: bytes, vocabulary: int) -> Frequencies:
        both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        n = len(both) // 2
        return cls(np.cumsum(both[:n]), both[n:], vocabulary)

    def by_point(self) -> np.ndarray:
        return np.repeat(self.symbols, self.size).astype(np.int32)


def low_bits(vocabulary: int) -> int:
    return max(0, int(vocabulary - 1).bit_length() - DIRECT)


class Model:
    """The predictions of all lanes; ``a`` below is the number of lanes still coding.

    A prediction is kept as ``id << 4 | level``; level 0 means none yet. Order 2
    is the first row of what has two, order 1 the second. ``predict``,
    ``intervals`` and ``learn`` follow each other for every id.
    """

    def __init__(self, lanes: int, order0: Frequencies):
        self.order0 = order0
        self.seen = np.zeros(lanes << CONTEXTS + SLOTS, np.int32)
        self.row = np.arange(lanes, dtype=np.int64) << CONTEXTS + SLOTS
        self.weight = np.full(lanes, 10 << 8, np.int32)
        self.last, self.context, self.older = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), np.ones(lanes, np.uint32)
        bits = U(order0.bits)
        self.begin, self.size = BEGIN << bits, SIZE << bits

    def predict(self, a: int) -> None:
        """The ids that are predicted, and the place of their chances in the tables."""
        slot = np.empty((2, a), np.int64)
        np.add(self.row[:a], self.context[:a], out=slot[1])
        np.add(slot[1], self.older[:a], out=slot[0])
        self.slot, self.held = slot, self.seen.take(slot)
        self.level, self.id = self.held & 15, self.held >> 4
        # Where both predict the same id it is order 2's alone.
        only = self.level[1] * _differ(self.id[0], self.id[1])
        self.at = self.weight[:a] + (self.level[0] << 4) + only

    def intervals(self, a: int, x: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the intervals of the ids ``x``."""
        self.wrong = _differ(self.id, x)
        self.both_wrong = (self.wrong[0] << 1) + self.wrong[1]
        at = ((self.at << 2) + self.both_wrong).astype(np.int64)
        other = OTHER.take(at)
        symbol = symbol.astype(np.int64)
        return self.begin.take(at) + self.order0.start_of.take(symbol) * other, self.size.take(at) + self.order0.size_of.take(symbol) * other

    def learn(self, a: int, x: np.ndarray) -> None:
        now = self.held + STEP.take((self.wrong << 4) + self.level)
        now ^= (now ^ (x << 4 | 1)) & (now >> 31)
        self.seen[self.slot] = now
        self.weight[:a] = NEXT.take(self.weight[:a] + self.both_wrong)
        # Order 2 lies beside order 1, where memory has been fetched already.
        self.older[:a] = np.maximum(self.last[:a] * _HASH2 >> _DROP2, np.uint32(1))
        self.last[:a] = x
        self.context[:a] = self.last[:a] * _HASH >> _DROP << np.uint32(SLOTS)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 where ids differ, else 0."""
    return np.minimum((a ^ b).view(np.uint32), np.uint32(1)).view(np.int32)


class _Writer:
    def __init__(self, lanes: int, most: int):
        """``most``: how often a lane is narrowed."""
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
        self.width = most + 2
        self.words = np.zeros(lanes * self.width, np.uint32)
        self.at = np.arange(lanes, dtype=np.int64) * self.width

    def code(self, a: int, low: np.ndarray, size: np.ndarray, shift: int) -> None:
        """Narrows the first ``a`` lanes to ``[low, low + size)`` of ``1 << shift``."""
        unit = self.range[:a] >> U(shift)
        now = self.low[:a] + unit * low
        over = np.flatnonzero(now < self.low[:a])
        if len(over):  # what was written is raised by one
            at = self.at[over] - 1
            while len(at):
                self.words[at] += np.uint32(1)
                at = at[self.words[at] == 0] - 1
        unit *= size
        out = np.flatnonzero(unit < _LEAST)
        lo = now[out]
        at = self.at[out]
        self.words[at] = lo >> _BITS32
        self.at[out] = at + 1
        now[out] = lo << _BITS32
        unit[out] <<= _BITS32
        self.low[:a], self.range[:a] = now, unit

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.words[self.at] = self.low >> _BITS32
            self.at += 1
            self.low <<= _BITS32
        return [self.words[i * self.width:end].astype("<u4").tobytes() for i, end in enumerate(self.at.tolist())]


class _Reader:
    def __init__(self, coded: list[bytes]):
        self.words = np.frombuffer(b"".join(coded) + bytes(8), "<u4").astype(U)
        ends = np.cumsum([len(c) // 4 for c in coded])
        self.at = np.append(0, ends[:-1])
        self.range = np.full(len(coded), 2**64 - 1, U)
        self.code = self._next(self.at) << _BITS32 | self._next(self.at + 1)
        self.at += 2

    def _next(self, at: np.ndarray) -> np.ndarray:
        # A damaged block reads on behind its end; the checksum tells.
        return self.words.take(at, mode="clip")

    def target(self, a: int, shift: int) -> np.ndarray:
        self.unit = self.range[:a] >> U(shift)
        return (self.code[:a] // self.unit).view(np.int64)

    def narrow(self, a: int, low: np.ndarray, size: np.ndarray) -> None:
        """Behind ``target``."""
        code, unit = self.code[:a], self.unit
        code -= unit * low
        unit *= size
        out = np.flatnonzero(unit < _LEAST)
        at = self.at[out]
        code[out] = code[out] << _BITS32 | self._next(at)
        self.at[out] = at + 1
        unit[out] <<= _BITS32
        self.range[:a] = unit


def encode_blocks(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[bytes]:
    """The frequencies of ``ids`` and the coded blocks; all but the last hold ``block`` ids."""
    n = len(ids)
    if not n:
        return []
    lanes, steps = -(-n // block), min(block, n)
    flat = np.zeros(lanes * steps, np.int32)
    flat[:n] = ids
    table = np.ascontiguousarray(flat.reshape(lanes, steps).T)
    tail = n - (lanes - 1) * block
    order0 = Frequencies.fitted(flat[:n], vocabulary)
    bits, low_id = order0.bits, order0.low
    del flat
    model, out = Model(lanes, order0), _Writer(lanes, 2 * steps if low_id else steps)
    for t in range(steps):
        a = lanes if t < tail else lanes - 1
        x = table[t, :a]
        if low_id:
            # Predicted ids have them as well, so that all lanes move alike.
            out.code(a, (x & ((1 << low_id) - 1)).astype(U), np.ones(a, U), low_id)
        model.predict(a)
        out.code(a, *model.intervals(a, x, x >> low_id if low_id else x), MIX + bits)
        model.learn(a, x)
    return [order0.dump(), *out.finish()]


def decode_blocks(coded: list[bytes], n: int, vocabulary: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of a frame's frequencies and blocks."""
    if not n:
        return np.empty(0, np.uint32)
    lanes, steps = -(-n // block), min(block, n)
    tail = n - (lanes - 1) * block
    order0 = Frequencies.load(coded[0], vocabulary)
    bits, low_id, by_point = order0.bits, order0.low, order0.by_point()
    model, read = Model(lanes, order0), _Reader(coded[1:])
    firsts, boths, others = FIRST << bits, BOTH << bits, ((1 << MIX) - BOTH).astype(np.float64)
    table = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        a = lanes if t < tail else lanes - 1
        if low_id:
            rest = read.target(a, low_id)
            read.narrow(a, rest.view(U), np.ones(a, U))
        model.predict(a)
        at = model.at.astype(np.int64)
        first, both = firsts.take(at), boths.take(at)
        target = read.target(a, MIX + bits)
        is1, is2 = target < both, target < first
        # Of numbers below 2 ** 32 and 2 ** 12 the quotient of doubles is exact when rounded down.
        symbol = by_point.take((np.maximum(target - both, 0) / others.take(at)).astype(np.int64), mode="clip")
        other = symbol if not low_id else symbol << low_id | rest.astype(np.int32)
        x = np.where(is1, np.where(is2, model.id[0], model.id[1]), other)
        read.narrow(a, *model.intervals(a, x, symbol))
        model.learn(a, x)
        table[t, :a] = x
    return table.T.reshape(-1)[:n].astype(np.uint32)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
