"""Word shingles of whole batches of texts with numpy."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import give_back
from .tokens import buffers, piece_keys

#: Documents and bytes that are cut at once; eleven bits of a sort key tell the documents apart.
DOCS, SLICE = 2048, 1_500_000
#: Bits of a shingle's hash.
BITS = 53
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z lower-cased, and the text it is from; words end at ASCII white space."""
    solid = ~_BLANK[data]
    first, last = solid.copy(), solid.copy()
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    same = np.ones(len(data), bool)
    same[bounds] = False  # a text's first byte does not go on with the text before
    first[1:] &= ~(solid[:-1] & same[1:])
    last[:-1] &= ~(solid[1:] & same[1:])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return piece_keys(_LOWER[data], starts, ends - starts), np.searchsorted(offsets, starts, side="right") - 1


def sets(texts: pa.Array, width: int = 5):
    """Yields ``(first row, tokens, bounds)``: the sorted distinct shingle hashes of every text, end to end.

    A text of fewer words than ``width`` has one shingle, its whole sequence; a
    text without words has none.
    """
    data, offsets = buffers(texts)
    at = 0
    while at < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1
        end = min(max(at + 1, end), at + DOCS, len(offsets) - 1)
        n = end - at
        key, doc = words(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]) if offsets[end] > offsets[at] else (np.empty(0, np.uint64), np.empty(0, np.int64))
        count = np.bincount(doc, minlength=n)
        begin = np.cumsum(count) - count
        with np.errstate(over="ignore"):
            total = np.zeros(max(0, len(key) - width + 1), np.uint64)
            for i in range(width):
                total = total * _A + key[i:i + len(total)]
            whole = np.flatnonzero((np.arange(len(total)) - begin[doc[:len(total)]]) <= count[doc[:len(total)]] - width)
            hashes, owner = total[whole], doc[whole]
            short = np.flatnonzero((count > 0) & (count < width))
            if len(short):
                one = np.zeros(len(short), np.uint64)
                for i in range(width - 1):
                    more = count[short] > i
                    one[more] = one[more] * _B + key[begin[short[more]] + i] + np.uint64(1)
                hashes, owner = np.concatenate([hashes, one]), np.concatenate([owner, short])
            hashes ^= hashes >> np.uint64(32)
            hashes *= _B
            hashes ^= hashes >> np.uint64(29)
            hashes *= _A
        both = (owner.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS))
        both.sort()
        if len(both):
            both = both[np.append(True, both[1:] != both[:-1])]
        bounds = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS)) if n < DOCS else np.append(
            np.searchsorted(both, np.arange(n, dtype=np.uint64) << np.uint64(BITS)), len(both))
        yield at, both & np.uint64((1 << BITS) - 1), bounds
        at = end
    give_back()


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit id of every set, equal for equal sets; of an empty one 0."""
    with np.errstate(over="ignore"):
        mixed = (tokens + np.uint64(1)) * _B
        mixed ^= mixed >> np.uint64(31)
        mixed *= _A
        mixed ^= mixed >> np.uint64(30)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * (mixed | np.uint64(1)), dtype=np.uint64)])
        out = (upto[bounds[1:]] - upto[bounds[:-1]]) * _A
        out ^= out >> np.uint64(32)
    return out.view(np.int64)
