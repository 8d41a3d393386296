"""Document fingerprints by a threshold-scaled sketch.

A sketch holds every shingle hash below ``fraction`` of the hash range, however
long the text is, so sketches of parts merge by set union, and containment and
likeness are estimated from the sets alone, also between texts of very unequal
length. A shingle is ``width`` code points; a shorter text is one shingle. A
text none of whose hashes lies below the limit keeps its smallest one, an empty
text has the empty sketch.

Sketches are strings: base64 of the sorted 32-bit hashes, little-endian.
Hashes are computed for whole batches of texts at once with numpy.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions

WIDTH = 24
FRACTION = 1 / 8
#: Code points that are hashed at once.
SLICE = 2_000_000
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _windows(points: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every run of ``width`` values, by doubling."""
    with np.errstate(over="ignore"):
        one = (points.astype(np.uint64) + np.uint64(1)) * _M
        one ^= one >> np.uint64(32)
        one *= _P
        have, power, total, done = one, _P, None, 0
        size, rest = 1, width
        while rest:
            if rest & 1:
                if total is None:
                    total, done = have, size
                else:
                    n = len(points) - done - size + 1
                    total = total[:n] * power + have[done:done + n]
                    done += size
            rest >>= 1
            if rest:
                n = len(have) - size
                have = have[:n] * power + have[size:size + n]
                power, size = power * power, size * 2
        total ^= total >> np.uint64(32)
        total *= _M
        total ^= total >> np.uint64(29)
        total *= _P
        total ^= total >> np.uint64(32)
        return total


def sketches(texts: list[str], width: int = WIDTH, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted kept hashes of each text, 32 bits each."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= SLICE:
            n += len(texts[end])
            end += 1
        out += _sketch_slice(texts[at:end], width, fraction)
        at = end
    return out


def _sketch_slice(texts: list[str], width: int, fraction: float) -> list[np.ndarray]:
    # Short texts are filled up with a value that no text holds.
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    filled = np.maximum(lengths, width)
    starts = np.concatenate([[0], np.cumsum(filled)])
    points = np.full(starts[-1], 0x110000, dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if (lengths == filled).all():
        points = flat
    else:
        shift = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
        points[np.arange(len(flat)) + shift] = flat
    hashes = _windows(points, width)
    counts = filled - width + 1
    limit = np.uint64(min(int(fraction * 2**64), 2**64 - 1))
    kept = np.flatnonzero(hashes <= limit)
    doc = np.searchsorted(starts, kept, side="right") - 1
    inside = kept - starts[doc] < counts[doc]
    kept, doc = kept[inside], doc[inside]
    # 32 bits below the leading ones that all kept hashes share as zeros.
    drop = np.uint64(max(0, 32 - max(0, int(-np.log2(fraction)))))
    values = ((hashes[kept] >> drop) & np.uint64(0xFFFFFFFF)).astype(np.uint64)
    pairs = np.unique((doc.astype(np.uint64) << np.uint64(32)) | values)
    bounds = np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (pairs & np.uint64(0xFFFFFFFF)).astype("<u4")
    out = [low[a:b] for a, b in zip(bounds, bounds[1:])]
    for i in np.flatnonzero((np.diff(bounds) == 0) & (lengths > 0)):
        least = hashes[starts[i]:starts[i] + counts[i]].min()
        out[i] = np.array([(int(least) >> int(drop)) & 0xFFFFFFFF], dtype="<u4")
    for i in np.flatnonzero(lengths == 0):
        out[i] = low[:0]
    return out


def packed(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u4").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u4")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 when a is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, an empty and another one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows ``_key, _text, _last`` in order, such that a row's successor is the row after it.

    The key range is cut into buckets at approximate quantiles (their number is
    the number of partitions, so bounds and bucket heads are small). Each bucket
    also receives the first document of the bucket after it, the last one the
    very first document, marked ``_last``. So texts move once, and no window
    spans the table. NULL keys come first; equal keys are ordered by text.
    """
    n = buckets or 2 * partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))).alias("_key"), F.col(key).isNull().alias("_null"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    at = [i / n for i in range(1, n)]
    found = rows.agg(F.percentile_approx("_key", at, 10_000).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(found, dtype=np.int64))

    @F.pandas_udf("int")
    def bucket(keys):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    heads = sorted(rows.groupBy(bucket("_key").alias("b")).agg(F.min("_key").alias("k")).collect())
    before = {head["k"]: heads[i - 1]["b"] for i, head in enumerate(heads)}
    head_keys = np.array([h["k"] for h in heads], dtype=np.int64)
    targets = np.array([before[k] for k in head_keys.tolist()], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def places(keys):
        import pandas as pd
        keys = keys.to_numpy()
        own = np.searchsorted(bounds, keys, side="right").astype(np.int32)
        hit = np.minimum(np.searchsorted(head_keys, keys), max(0, len(head_keys) - 1))
        is_head = head_keys[hit] == keys if len(head_keys) else np.zeros(len(keys), bool)
        return pd.Series([[o, targets[h]] if yes else [o] for o, h, yes in zip(own.tolist(), hit.tolist(), is_head.tolist())])

    rows = rows.select("*", F.posexplode(places("_key")).alias("_last", "_bucket"))
    return rows.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_last", "_key", "_text")


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """Each document's fingerprint, and how it compares with an edited text and the next document.

    The edited text has its last quarter of code points replaced by the first
    ones of the next document in ascending key order (after the last: the
    first). Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, covered_by_next`` with one row
    per row of ``docs``; NULL texts count as empty, other columns are left out.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_chars", pa.int64()), *[pa.field(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
              *[pa.field(c, pa.float64()) for c in ("near_edited", "near_next", "covered_by_next")]]
    schema = pa.schema(fields)

    def judge(keys, nulls, texts, last):
        """Of all rows but the final one, which only serves as a successor."""
        keep = [i for i in range(len(texts) - 1) if not last[i]]
        edited = []
        for i in keep:
            t = texts[i]
            k = len(t) // 4
            edited.append(t[:len(t) - k] + texts[i + 1][:k])
        own, other = sketches(texts, width, fraction), sketches(edited, width, fraction)
        rows = [(None if nulls[i] else keys[i], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), packed(own[i]), packed(s),
                 likeness(own[i], s), likeness(own[i], own[i + 1]), containment(own[i], own[i + 1])) for i, e, s in zip(keep, edited, other)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)] if rows else [pa.array([], f.type) for f in fields], schema=schema)

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("_key", "_null", "_text", "_last")]):
                held.append(row)
                size += len(row[2])
                if size >= SLICE and len(held) > 1:
                    yield judge(*zip(*held))
                    held = held[-1:]
                    size = len(held[0][2])
        if len(held) > 1:
            yield judge(*zip(*held))

    kind = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, covered_by_next double"
    return with_next(docs, key, text).mapInArrow(run, kind)
