"""Packing by power-of-two decomposition.

A document of n tokens becomes whole pieces of ``longest`` tokens and one piece
for every set bit of what is left, largest first. Each piece is a sequence of
its own, so no sequence crosses documents and none needs padding: sequences of
one length form a bucket that fills batches by itself. Every step is local to a
task; nothing is shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokens
from .common import give_back, small_batches

LONGEST = 4096
#: Bytes of text that are packed at once; the stages before leave a worker less room than it has alone.
SLICE = 500_000
END_ID = 2
SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def decompose(counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """``(document, length)`` of all pieces, documents in order, largest pieces first."""
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    sizes = np.concatenate([[longest], 1 << bits])
    times = np.concatenate([(counts // longest)[:, None], ((counts % longest)[:, None] >> bits[None, :]) & 1], axis=1)
    doc = np.repeat(np.arange(len(counts)), times.sum(axis=1))
    return doc, np.repeat(np.tile(sizes, len(counts)), times.ravel())


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, longest: int = LONGEST,
           special: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit values. A sequence is one piece,
    so ``offset`` is 0 and its length a power of two up to ``longest``, which
    must be one itself. ``sequence_id`` holds the input partition, the bucket
    (the logarithm of the length) and a count; it is the same when a task is
    repeated. NULL texts are empty and consist of the end id; equal rows are
    packed like any others; other columns are left out. With ``special`` the
    strings of special tokens in texts become their ids.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    buckets = longest.bit_length()
    small_batches(docs.sparkSession)

    def run(batches):
        used = np.zeros(buckets, np.int64)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys = batch.column(0)
            for at, ids, count in tokens.encoded(batch.column(1), tokenizer, end_id, special, SLICE):
                doc, length = decompose(count, longest)
                ends = np.cumsum(length)
                begin = np.cumsum(count) - count
                bucket = np.log2(length).astype(np.int64)
                number = np.empty(len(doc), np.int64)
                for b in range(buckets):
                    own = bucket == b
                    n = int(own.sum())
                    number[own] = used[b] + np.arange(n)
                    used[b] += n
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                step = 200_000
                for a in range(0, len(doc), step):
                    cut = slice(a, a + step)
                    yield pa.RecordBatch.from_arrays([
                        keys.slice(at, len(count)).take(pa.array(doc[cut])), pa.array((ends - length - begin[doc])[cut]), pa.array(length[cut]), pa.array(count[doc][cut]),
                        pa.array((base | (bucket << 32) | number)[cut]), pa.array(np.zeros(len(doc[cut]), np.int64)), binary[cut].cast(pa.binary())],
                        names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
                give_back()

    return docs.selectExpr(f"CAST(`{key}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length, so that every batch is read from sequences of one length."""
    pieces.write.partitionBy("length").parquet(path)
