"""Token ids of whole texts, by the tokenizers library, each distinct piece encoded once.

Both public vocabularies used here split a text at white space before they
merge, so a text may be cut before a single blank or newline that stands
between two visible characters, and its ids are those of its pieces in order.
A batch is cut with numpy, pieces are told apart by a 64-bit hash, and only
pieces that this worker has not met are given to the library. What it has met
is kept in flat arrays of bounded size.

With ``special`` the strings of special tokens in a text become their ids, as
is the library's default: texts are cut around them first. Without it they are
ordinary text.
"""
from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: Pieces a worker remembers before it begins anew.
REMEMBER = 1_000_000
#: Pieces that are given to the library at once, and in one text.
BATCH, TOGETHER = 2_000, 50
#: What stands between pieces in one text: an added token, around which the library encodes as if the rest stood alone.
BETWEEN = "\U0010fffe\U0010ffff"
#: Bytes of text that are cut at once.
SLICE = 2_000_000

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Keeps the first n of eight little-endian bytes.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Slots of the table of met pieces, as a power of two.
SLOT_BITS = 20
#: Bytes that are visible in themselves, and bytes that begin a character which is never white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEADS = np.zeros(256, bool)
_LEADS[0xC3:0xE0] = _LEADS[0xE4:0xF5] = True
_BEGINS = _VISIBLE | _LEADS
#: 1: ASCII letters, 2: ASCII punctuation except the apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 2


def cuts(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which a text may be cut without changing its ids.

    Besides blanks and newlines these are places where ASCII punctuation, other
    than an apostrophe, follows an ASCII letter: runs of letters end there.
    """
    kind = _KIND[data]
    marks = np.zeros(len(data), bool)
    np.logical_and(kind[1:] == 2, kind[:-1] == 1, out=marks[1:])
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_BEGINS[data[at + 1]]]
    last = data[at - 1]
    plain = _VISIBLE[last]
    other = np.flatnonzero(~plain & (last >= 0x80) & (at >= 4))
    if len(other):
        b2, b3, b4 = (data[at[other] - k] for k in (2, 3, 4))
        ok = (b2 >= 0xC3) & (b2 < 0xE0)
        ok |= (b2 >= 0x80) & (b2 < 0xC0) & (b3 >= 0xE4) & (b3 < 0xF0)
        ok |= (b2 >= 0x80) & (b2 < 0xC0) & (b3 >= 0x80) & (b3 < 0xC0) & (b4 >= 0xF0) & (b4 < 0xF5)
        plain[other[ok]] = True
    marks[at[plain]] = True
    return marks


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, …`` of every span, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def piece_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every piece, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        keys = lengths.astype(np.uint64) * _STEP
        rest, which, at = lengths, np.arange(len(starts)), starts
        while len(which):
            h = keys[which] ^ (words[at] & _MASK[np.minimum(rest, 8)])
            h *= _MIX
            h ^= h >> np.uint64(32)
            h *= _STEP
            keys[which] = h ^ (h >> np.uint64(29))
            more = np.flatnonzero(rest > 8)
            which, at, rest = which[more], at[more] + 8, rest[more] - 8
    return keys


class Encoder:
    remember = REMEMBER
    #: The tokenizer for pieces that stand together in one text, if there is one.
    joined = None

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        # The second has the mark between pieces as well; no id of it leaves this class.
        self.tokenizer, self.joined = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.joined.encode_special_tokens = not special
        self.joined.add_tokens([AddedToken(BETWEEN, normalized=False, special=False)])
        self.between = self.joined.token_to_id(BETWEEN)
        strings = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and t.content] if special else []
        # The longest first, as the library matches them.
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(strings, key=len, reverse=True))) if strings else None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)
        # A piece is looked up in one slot first; where another piece holds it, among the sorted keys.
        self.slot_key, self.slot_place = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of some pieces, and their number per piece."""
        together = [BETWEEN.join(texts[at:at + TOGETHER]) for at in range(0, len(texts), TOGETHER)] if self.joined else []
        if self.joined and sum(t.count(BETWEEN) for t in together) + len(together) == len(texts):
            encoded = [e.ids for e in self.joined.encode_batch_fast(together, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(chain(e, (self.between,)) for e in encoded), np.uint32, sum(map(len, encoded)) + len(encoded))
            ends = ids == self.between
            return ids[~ends], (np.diff(np.flatnonzero(ends), prepend=-1) - 1).astype(np.int32)
        # The mark stands in a piece itself.
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, encoded), np.int32, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(count.sum())), count

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        # The library's results hold far more than ids: few of them exist at a time.
        flat, count = map(np.concatenate, zip(*[self._ids(texts[at:at + BATCH]) for at in range(0, len(texts), BATCH)]))
        first = len(self.ids) + np.cumsum(count) - count
        place = (len(self.first) + np.arange(len(keys))).astype(np.int32)
        self.ids, self.first, self.count = np.concatenate([self.ids, flat]), np.concatenate([self.first, first]), np.concatenate([self.count, count])
        # Both are sorted: the new ones go to their places among the known ones.
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)
        slot = keys >> np.uint64(64 - SLOT_BITS)
        free = self.slot_place[slot] < 0
        self.slot_key[slot[free]], self.slot_place[slot[free]] = keys[free], place[free]

    def _places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keys = piece_keys(data, starts, lengths)
        slot = keys >> np.uint64(64 - SLOT_BITS)
        place = np.where(self.slot_key[slot] == keys, self.slot_place[slot], -1)
        missed = np.flatnonzero(place < 0)
        if not len(missed):
            return place
        order = missed[np.argsort(keys[missed])]
        ordered = keys[order]
        begins = np.append(True, ordered[1:] != ordered[:-1])
        unique, example = ordered[begins], order[begins]
        if len(self.keys) + len(unique) > self.remember and len(self.keys):
            self._forget()
            return self._places(data, starts, lengths)
        at = np.searchsorted(self.keys, unique)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            raw = data.tobytes()
            texts = [raw[a:a + n].decode() for a, n in zip(starts[example[new]].tolist(), lengths[example[new]].tolist())]
            self._learn(unique[new], texts)
            at = np.searchsorted(self.keys, unique)
        place[order] = self.place[at][np.cumsum(begins) - 1]
        return place

    def _around_special(self, data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> None:
        """Marks both ends of the special tokens' strings within a text, and nothing inside."""
        raw, at = data.tobytes(), 0
        while found := self.special.search(raw, at):
            a, b = found.span()
            if (end := int(offsets[np.searchsorted(offsets, a, side="right")])) < b:
                at = end  # begins in one text and ends in the next
                continue
            marks[a], marks[a + 1:b], marks[b:b + 1] = True, False, True
            at = b

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per text, of texts that lie end to end in ``data``."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        marks = cuts(data)
        marks[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if self.special:
            self._around_special(data, offsets, marks)
        starts = np.flatnonzero(marks)
        place = self._places(data, starts, np.diff(np.append(starts, len(data))))
        count = self.count[place]
        ids = self.ids[spans(self.first[place], count)]
        before = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = False) -> Encoder:
    """One per worker, vocabulary and treatment of special tokens' strings."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special)
    return _ENCODERS[path, special]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def encoded(texts: pa.Array, path: str, end_id: int | None = None, special: bool = False, most: int = SLICE):
    """Yields ``(first row, ids, ids per row)`` for slices of a text column, each text ended by ``end_id``."""
    data, offsets = buffers(texts)
    work, at = encoder(path, special), 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        ids, count = work.encode(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
        if end_id is not None:
            ids, count = np.insert(ids, np.cumsum(count), end_id), count + 1
        yield at, ids.astype(np.uint32), count
        at = end
