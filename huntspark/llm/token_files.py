"""Token ids of documents in coded files, in ascending document order.

Texts are range-partitioned by document id, encoded, and written as frames
through Spark's text writer, whose line separator is the mark behind every
frame; the reader splits files at the marks, so it is parallel within files and
works on any store that Spark can reach. A frame holds whole documents:

    fixed head, big-endian: magic 4, partition 4, number in partition 4, documents 4, ids 8, vocabulary 4, block 4, blocks 4
    little-endian arrays: document ids 8 each, NULL flags 1, ids per document 8, coded bytes per block 4, checksum per block 4
    checksum of all the above 4, then the coded blocks

The first of the blocks holds the frequencies of the frame's ids, which the others need.
"""
from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import range_coder, tokens
from .common import cut_lineage, partitions

MAGIC = b"RCF2"
HEAD = struct.Struct(">4siiiqiii")
#: Behind every frame; 128 bits that are not chance.
MARK = "\n=9f41c7e2a05d8b36e8714f2b0cda6953=\n"


class DamagedBlock(ValueError):
    """A block or head whose checksum differs from what was written."""


def frame(part: int, number: int, keys: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int, block: int) -> bytes:
    coded = range_coder.encode_blocks(ids, vocabulary, block)
    sums = [zlib.crc32(c) for c in coded[:1]] + [range_coder.checksum(ids[at:at + block]) for at in range(0, len(ids), block)]
    head = HEAD.pack(MAGIC, part, number, len(keys), len(ids), vocabulary, block, len(coded)) + b"".join([
        keys.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), counts.astype("<u8").tobytes(), np.array(list(map(len, coded)), "<u4").tobytes(), np.array(sums, "<u4").tobytes()])
    return head + struct.pack(">I", zlib.crc32(head)) + b"".join(coded)


def unframe(data: bytes):
    """``(part, number, keys, nulls, counts, ids)``; raises DamagedBlock."""
    magic, part, number, docs, n, vocabulary, block, blocks = HEAD.unpack_from(data)
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    keys, nulls, counts, sizes, sums = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", blocks), take("<u4", blocks)
    if magic != MAGIC or struct.unpack_from(">I", data, at)[0] != zlib.crc32(data[:at]):
        raise DamagedBlock(f"head of frame {part}/{number}")
    ends = at + 4 + np.cumsum(sizes, dtype=np.int64)
    coded = [data[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]
    if coded and zlib.crc32(coded[0]) != sums[0]:
        raise DamagedBlock(f"frequencies of frame {part}/{number}")
    ids = range_coder.decode_blocks(coded, n, vocabulary, block)
    for i, s in enumerate(sums[1:].tolist()):
        if range_coder.checksum(ids[i * block:(i + 1) * block]) != s:
            raise DamagedBlock(f"block {i} of frame {part}/{number}")
    return part, number, keys, nulls.astype(bool), counts.astype(np.int64), ids


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, vocabulary: int = 65_536,
          block: int = range_coder.BLOCK, lanes: int = range_coder.LANES, special: bool = False) -> None:
    """Writes the ids of all texts, each ended by ``end_id``, to a new folder.

    Documents stand in ascending order of their id (NULL first, equal ids by
    text); NULL texts are empty. Other columns are not written. ``vocabulary``
    is a bound above all ids. With ``special`` the strings of special tokens in
    texts become their ids.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(key).cast("bigint").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(n, F.col("_key").asc_nulls_first()).sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text")

    def run(batches):
        part, number, room = TaskContext.get().partitionId(), 0, block * lanes
        held, size = [], 0

        def flush():
            keys, nulls, counts, ids = (np.concatenate(c) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([frame(part, number, keys, nulls, counts, ids, vocabulary, block)], pa.binary())], names=["value"])

        for batch in batches:
            column = batch.column(0)
            nulls = np.asarray(column.is_null())
            keys = np.asarray(column.fill_null(0))
            for at, ids, counts in tokens.encoded(batch.column(1), tokenizer, end_id, special):
                begin = 0
                ends = np.cumsum(counts)
                while begin < len(counts):
                    # As many documents as the frame has room for, one at least.
                    base = ends[begin] - counts[begin]
                    last = int(np.searchsorted(ends, base + room - size, side="right"))
                    if last <= begin:
                        if size:
                            yield flush()
                            number, held, size = number + 1, [], 0
                            continue
                        last = begin + 1
                    held.append((keys[at + begin:at + last], nulls[at + begin:at + last], counts[begin:last], ids[base:ends[last - 1]]))
                    size += int(ends[last - 1] - base)
                    begin = last
        if held:
            yield flush()

    # The bytes are a string only by name: neither the cast nor the writer looks at them.
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", MARK).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: documents, with the number of ids before each in the files' order."""
    lines = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("value"))

    def number(at: int, size: int):
        return F.conv(F.hex(F.substring("value", at, size)), 16, 10).cast("bigint")

    heads = lines.select(number(5, 4).alias("part"), number(9, 4).alias("number"), number(17, 8).alias("n"))
    parts = heads.groupBy("part").agg(F.sum("n").alias("n"))  # one row per partition written
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("number")) - F.col("n")
    # Written first, so that Spark knows its size (a row per frame) before it plans how the ids meet it.
    heads = cut_lineage(heads.withColumn("inside", inside).join(parts, "part").select("part", "number", (F.col("inside") + F.col("before")).alias("before")))

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                part, number, keys, nulls, counts, ids = unframe(value.as_py())
                ends = np.cumsum(counts)
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(np.append(0, ends * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(keys), part, np.int64)), pa.array(np.full(len(keys), number, np.int64)), pa.array(keys, mask=nulls), pa.array(ends - counts), pa.array(counts),
                    raw.cast(pa.binary())], names=["part", "number", "doc_id", "inside", "n_tokens", "ids"])

    docs = lines.mapInArrow(run, "part bigint, number bigint, doc_id bigint, inside bigint, n_tokens bigint, ids binary")
    return docs.join(heads, ["part", "number"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids")
