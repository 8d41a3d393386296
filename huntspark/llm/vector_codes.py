"""Product codes of vectors; the nearest entry of a codebook is found with a GNAT over its entries.

A GNAT takes some entries as split points and gives every other entry to the
nearest of them. For each pair of split point and child it stores the range of
distances between the two. Around a query, the distances to the split points
and the ranges tell which children cannot hold a nearer entry, by the triangle
inequality; they are left out with all that is below them.

All components are integers, so distances are exact. Bounds are rounded
outwards, a child is left out only if its bound is strictly greater than the
best distance, and what remains is compared by integer squared distances, ties
to the lower index: the result is that of a full scan.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, partitions

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node; fewer entries than this are a leaf.
SPLITS = 6
#: Outward rounding of a distance whose square is exact: far more than its last bit.
_DOWN, _UP = 1 - 1e-14, 1 + 1e-14
#: Sums travel in four limbs of 40 bits, so they are exact at any number of rows.
_LIMB = 40
#: Squares below this are exact in doubles, those below the second in 64-bit integers.
_EXACT, _LONG = 1 << 52, 1 << 62


def squared(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all queries to all entries, in the arrays' type."""
    out = np.zeros((len(queries), len(entries)), queries.dtype)
    for i in range(queries.shape[1]):
        step = queries[:, i, None] - entries[None, :, i]
        out += step * step
    return out


class Gnat:
    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None):
        """``entries`` is an integer array whose squared distances fit 64 bits; ``members`` lists rows of it, ascending."""
        members = np.arange(len(entries)) if members is None else members
        self.entries, self.children = entries, []
        if len(members) <= SPLITS:
            self.splits = members
            return
        # Every further split point is the entry farthest from those before it.
        chosen, near = [int(members[0])], squared(entries[members], entries[members[:1]])[:, 0]
        while len(chosen) < SPLITS:
            far = int(members[np.argmax(near)])
            if far in chosen:
                break  # all that is left equals a split point
            chosen.append(far)
            near = np.minimum(near, squared(entries[members], entries[[far]])[:, 0])
        self.splits = np.array(sorted(chosen))
        rest = members[~np.isin(members, self.splits)]
        apart = squared(entries[rest], entries[self.splits])
        home = np.argmin(apart, axis=1)
        lengths = np.sqrt(apart.astype(np.float64))
        for j in range(len(self.splits)):
            own = home == j
            if own.any():
                self.children.append((Gnat(entries, rest[own]), lengths[own].min(axis=0) * _DOWN, lengths[own].max(axis=0) * _UP))

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> int:
        """Improves ``best`` and ``index`` of the given rows; returns the number of distances computed."""
        apart = squared(queries[rows], self.entries[self.splits])
        at = np.argmin(apart, axis=1)  # the first of equal ones, and split points ascend
        value, entry = apart[np.arange(len(rows)), at], self.splits[at]
        better = (value < best[rows]) | ((value == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = value[better], entry[better]
        seen = apart.size
        if not self.children:
            return seen
        length = np.sqrt(apart.astype(np.float64))
        low, high = length * _DOWN, length * _UP
        for child, least, most in self.children:
            bound = np.maximum(low - most[None, :], least[None, :] - high).max(axis=1)
            # The difference of two rounded numbers is off by its last bit at most.
            stays = bound * np.where(bound > 0, _DOWN, 1.0) <= np.sqrt(best[rows].astype(np.float64)) * _UP
            if stays.any():
                seen += child.search(queries, rows[stays], best, index)
        return seen


class Codebook:
    """Entries of one part, as Python integers; picks arithmetic that is exact for the numbers at hand."""

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        self.most = max((abs(v) for e in entries for v in e), default=0)
        self.tree = Gnat(np.array(entries, np.int64).reshape(len(entries), -1)) if self._room(0) < _LONG else None
        self.floats = Gnat(np.array(entries, np.float64).reshape(len(entries), -1)) if self._room(0) < _EXACT else None

    def _room(self, most: int) -> int:
        return (self.most + max(most, self.most)) ** 2 * max(1, len(self.entries[0]) if self.entries else 1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index, squared distance)`` of the nearest entry, ties to the lower index."""
        index = np.zeros(len(vectors), np.int64)
        if not len(vectors):
            return index, index.copy()
        room = self._room(int(np.abs(vectors).max()) if vectors.shape[1] else 0)
        if room < _LONG:
            kind, tree = (np.float64, self.floats) if room < _EXACT else (np.int64, self.tree)
            best = np.full(len(vectors), np.inf if kind is np.float64 else np.iinfo(np.int64).max, kind)
            index[:] = len(self.entries)
            tree.search(vectors.astype(kind), np.arange(len(vectors)), best, index)
            return index, best.astype(np.int64)
        # Beyond 64 bits nothing can be ruled out by rounded bounds: every entry is verified in whole numbers.
        whole = [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in self.entries] for v in vectors.astype(object).tolist()]
        index = np.array([min(range(len(d)), key=d.__getitem__) for d in whole])
        return index, np.array([d[i] for d, i in zip(whole, index.tolist())], object)


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as integers, exact for every finite double; object integers where 64 bits do not do."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0**50 / scale:
        return np.floor(values * scale).astype(np.int64)
    return np.array([math.floor(v * scale) if abs(v) < 2.0**40 else int(v) * scale for v in values.ravel().tolist()], object).reshape(values.shape)


def _batch(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), dim))


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(3):
        out.append(value & ((1 << _LIMB) - 1))
        value >>= _LIMB
    return [*out, value]


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, is not empty, and holds finite components only."""
    c = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(c.isNotNull() & (F.size(c) > 0) & fine)


def bounds(dim: int, parts: int = PARTS) -> list[int]:
    """Where the parts begin and end; they are of equal length if the dimension allows it."""
    return [dim * i // parts for i in range(parts + 1)]


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    """The parts of the vectors with the smallest ids (``entries`` rows come to the driver, no more)."""
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.col("vector")).limit(entries).select("vector").collect()
    if not head:
        return []
    dim = len(head[0]["vector"])
    head = [r["vector"] for r in head if len(r["vector"]) == dim]
    whole = scaled(np.array(head)).tolist()
    at = bounds(dim, parts)
    return [[v[a:b] for v in whole] for a, b in zip(at, at[1:])]


def _round(rows: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Every entry becomes the floor of the mean of its parts; partial sums are folded by Spark."""
    dim = sum(len(b[0]) for b in books)
    at = bounds(dim, len(books))

    def run(batches):
        trees, total = [Codebook(b) for b in books], {}
        for batch in batches:
            data = _batch(batch.column(0), dim)
            for p, tree in enumerate(trees):
                own = data[:, at[p]:at[p + 1]]
                index, _ = tree.nearest(own)
                for e in np.unique(index).tolist():
                    mine = own[index == e]
                    n, sums = total.get((p, e), (0, [0] * own.shape[1]))
                    # A batch's sums fit 64 bits unless its numbers are huge, which are objects already or split here.
                    add = mine.sum(axis=0) if mine.dtype == object or np.abs(mine).max(initial=0) < 1 << 40 else mine.astype(object).sum(axis=0)
                    total[p, e] = n + len(mine), [s + int(v) for s, v in zip(sums, add.tolist())]
        out = [(p, e, i, n, *_limbs(s)) for (p, e), (n, sums) in total.items() for i, s in enumerate(sums)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["part", "entry", "place", "n", "l0", "l1", "l2", "l3"]
    partial = rows.select("vector").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    sums = partial.groupBy("part", "entry", "place").agg(*[F.sum(n).alias(n) for n in names[3:]])
    # One row per component of the codebooks: parts x entries x length, whatever the number of vectors.
    out = [[list(e) for e in b] for b in books]
    for r in sums.collect():
        out[r["part"]][r["entry"]][r["place"]] = sum(r[f"l{i}"] << (_LIMB * i) for i in range(4)) // r["n"]
    return out


def checksum(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[list[list[int]]]:
    """The codebooks, by part, entry and place; empty if there are no rows."""
    books = first_codebooks(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = _round(rows, books)
    return books


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: one row per kept vector.

    Codebooks begin as the parts of the vectors with the smallest ids (NULL
    last, equal ids by vector) and are improved ``rounds`` times. ``code`` holds
    two hex digits per part, so there are at most 256 entries. ``error`` and
    ``label_error`` (the sum over rows of the same label, NULLs together) are
    NULL where they exceed 64 bits. Vectors that are NULL, empty or hold NULL or
    non-finite components take no part, nor do those of another length than the
    first. Every row of a repeated id is coded. Other columns are left out.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: between 1 and 256 entries")
    spark = vectors.sparkSession
    rows = kept(vectors, vector).select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    books = first_codebooks(rows, parts, entries)
    dim = sum(len(b[0]) for b in books)
    rows = rows.filter(F.size("vector") == dim)
    for _ in range(rounds if books else 0):
        books = _round(rows, books)
    at = bounds(dim, parts)

    def run(batches):
        trees = [Codebook(b) for b in books]
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            data = _batch(batch.column("vector"), dim)
            code, error = np.zeros(len(data), "U1"), np.zeros(len(data), object)
            for p, tree in enumerate(trees):
                index, apart = tree.nearest(data[:, at[p]:at[p + 1]])
                code, error = np.char.add(code, digits[index]), error + apart.astype(object)
            error = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    found = cut_lineage(rows.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint"))
    return _with_label_error(found, partitions(spark)).withColumn("codebooks_sha256", F.lit(checksum(books))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _with_label_error(found: DataFrame, spread: int) -> DataFrame:
    """Sums per label, brought back in two steps so that rows of one label are spread."""
    salt: Column = F.pmod(F.xxhash64("vec_id", "code"), F.lit(max(64, spread)))
    found = found.withColumn("salt", salt).withColumn("wide", F.col("error").cast("decimal(38,0)"))
    # A NULL error makes its label's sum NULL.
    parts = found.groupBy("label", "salt").agg(F.sum("wide").alias("part"), F.count_if(F.col("wide").isNull()).alias("lost"))
    sums = parts.groupBy("label").agg(F.sum("part").alias("sum"), F.sum("lost").alias("lost")).select(F.col("label").alias("of"), F.when(F.col("lost") == 0, F.col("sum").try_cast("bigint")).alias("label_error"))
    parts = parts.join(sums, parts["label"].eqNullSafe(sums["of"])).select("of", F.col("salt").alias("own"), "label_error")
    return found.join(parts, found["label"].eqNullSafe(parts["of"]) & (found["salt"] == parts["own"]))
