"""Exact dedupe of batches against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a folder that is written once: the distinct texts of one batch in
exact buckets (the leading bits of a 64-bit digest), and per bucket a static
filter over its digests. A new batch becomes a snapshot of its own, which
groups its duplicates; its digests are then looked up in the filters of the
older snapshots, and only texts that a filter lets through meet the texts of
the same bucket, byte by byte. Equal digests of different texts, and what a
filter lets through by mistake, end there.

Texts move once, to their bucket, after repeats inside an Arrow batch were
folded, so a text that a third of all rows hold does not gather in a task.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, cut_lineage, partitions, shared_dir

#: Distinct texts a bucket is made for.
PER_BUCKET = 200_000
#: Seeds that are tried before a set of keys is given up (a set of distinct keys rarely needs a second).
TRIES = 100
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# -- the filter ---------------------------------------------------------------
def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.view(np.uint64) + np.uint64(seed) * _A
        h = (h ^ (h >> np.uint64(33))) * _B
        h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def _cells(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three cells of every key, in three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    inside = np.uint64(segment - 1)
    one, two = np.uint64(segment), np.uint64(2 * segment)
    return np.stack([first, (first + one) ^ ((h >> np.uint64(18)) & inside), (first + two) ^ (h & inside)]).astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(24))).astype(np.uint8)


def _shape(n: int) -> tuple[int, int]:
    """Length and number of segments for ``n`` keys: the sizes under which peeling succeeds."""
    segment = 4 if n < 2 else min(1 << 18, 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    return segment, max(1, int(np.ceil(room / segment)) - 2)


def fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``(seed, segment, segments, cells)`` of the filter over distinct 64-bit keys.

    Cells that only one key uses are peeled off, all at once in every round;
    the keys are then stored in the reverse order of the rounds. Keys of a round
    do not use each other's cells, so a round is one vector operation.
    """
    segment, segments = _shape(len(keys))
    size = segment * (segments + 2)
    for seed in range(TRIES):
        h = _mixed(keys, seed)
        cells = _cells(h, segment, segments)
        uses = np.bincount(cells.ravel(), minlength=size)
        which = np.zeros(size, np.int64)  # sum of the numbers of the keys that use a cell
        for row in cells:
            np.add.at(which, row, np.arange(len(keys)))
        left, rounds = np.ones(len(keys), bool), []
        alone = np.flatnonzero(uses == 1)
        while len(alone):
            key, at = np.unique(which[alone], return_index=True)
            rounds.append((key, alone[at]))
            left[key] = False
            touched = cells[:, key]
            for row in touched:
                np.subtract.at(uses, row, 1)
                np.subtract.at(which, row, key)
            touched = np.unique(touched)
            alone = touched[uses[touched] == 1]
        if not left.any():
            table, prints = np.zeros(size, np.uint8), _print(h)
            for key, cell in reversed(rounds):
                value = prints[key]
                for row in cells[:, key]:
                    value = value ^ table[row]
                table[cell] = value ^ table[cell]
            return seed, segment, segments, table.tobytes()
    raise ValueError("no filter found: are the keys distinct?")


def maybe(keys: np.ndarray, seed: int, segment: int, segments: int, cells: bytes) -> np.ndarray:
    """False only for keys that the filter does not hold."""
    table, h = np.frombuffer(cells, np.uint8), _mixed(keys, seed)
    a, b, c = _cells(h, segment, segments)
    return table[a] ^ table[b] ^ table[c] == _print(h)


# -- snapshots ----------------------------------------------------------------
def normalised(text) -> F.Column:
    """Runs of ASCII white space as one blank; NULL is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE}]+", " ")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, body, sha, mark``: normalised texts, their SHA-256 and its first 64 bits."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), normalised(F.col(f"`{text}`")).alias("body"))
    return rows.withColumn("sha", F.sha2("body", 256)).withColumn("mark", _mark(F.col("sha")))


def _mark(sha) -> F.Column:
    half = lambda at: F.conv(F.substring(sha, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _bucket(bits: int) -> F.Column:
    return (F.shiftrightunsigned("mark", 64 - bits) if bits else F.lit(0)).cast("int")


def _folded(batches):
    """Repeats inside an Arrow batch become one row; equal marks with different texts stay apart."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).append_column("copies", pa.array(np.ones(len(batch), np.int64)))
        t = t.group_by(["mark", "sha", "body"], use_threads=False).aggregate([("doc_id", "min"), ("copies", "sum")])
        yield from t.select(["mark", "sha", "body", "doc_id_min", "copies_sum"]).rename_columns(["mark", "sha", "body", "keep_id", "copies"]).to_batches()


def snapshot(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", per_bucket: int = PER_BUCKET) -> None:
    """Writes the distinct texts of a batch, in exact buckets, and a filter per bucket, to a new folder.

    ``texts``: ``bucket, mark, sha, body, keep_id, copies``; of equal texts the
    smallest id is kept (NULL only if no copy has an id) and all rows count.
    ``filters``: one row per bucket. The number of buckets follows the number of rows.
    """
    spark = docs.sparkSession
    bits = max(0, int(np.ceil(np.log2(max(1, docs.count()) / per_bucket))))
    bits = max(bits, int(np.ceil(np.log2(partitions(spark)))))
    rows = digests(docs, key, text).select("mark", "sha", "body", "doc_id").mapInArrow(_folded, "mark bigint, sha string, body string, keep_id bigint, copies bigint")
    rows = rows.withColumn("bucket", _bucket(bits)).repartition(min(1 << bits, 4 * partitions(spark)), "bucket")
    texts = rows.groupBy("bucket", "mark", "sha", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    texts.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/texts")

    def build(key, t):
        seed, segment, segments, cells = fuse(np.unique(t.column("mark").to_numpy()))
        numbers = {"bits": bits, "bucket": key[0].as_py(), "seed": seed, "segment": segment, "segments": segments}
        return pa.table({k: pa.array([v], pa.int32()) for k, v in numbers.items()} | {"cells": pa.array([cells], pa.binary())})

    marks = _texts(spark, path).select("bucket", "mark")
    marks.groupBy("bucket").applyInArrow(build, "bits int, bucket int, seed int, segment int, segments int, cells binary").write.parquet(f"{path}/filters")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mark bigint, sha string, body string, keep_id bigint, copies bigint, bucket int").parquet(f"{path}/texts")


def _filters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bits int, bucket int, seed int, segment int, segments int, cells binary").parquet(f"{path}/filters")


def positives(spark: SparkSession, path: str, older: str) -> DataFrame:
    """``mark``: digests of the snapshot at ``path`` that the filters of ``older`` let through.

    Digests meet the filter of their bucket in a task; where the new snapshot is
    larger than the older one, a bucket's digests are dealt to several.
    """
    first = _filters(spark, older).select("bits").first()
    if first is None:
        return spark.createDataFrame([], "mark bigint")
    bits, marks = first["bits"], _texts(spark, path).select("mark").distinct()
    deals = 1 + marks.count() // (PER_BUCKET << (bits + 2))
    asked = marks.select("mark", _bucket(bits).alias("bucket"), F.pmod(F.xxhash64("mark"), F.lit(deals)).cast("int").alias("deal"))
    filters = _filters(spark, older).withColumnRenamed("bucket", "held").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def probe(asked, filters):
        if not len(asked) or not len(filters):
            return pa.table({"mark": pa.array([], pa.int64())})
        keys, f = asked.column("mark").to_numpy(), filters.to_pylist()[0]
        return pa.table({"mark": pa.array(keys[maybe(keys, f["seed"], f["segment"], f["segments"], f["cells"])])})

    return asked.groupBy("bucket", "deal").cogroup(filters.groupBy("held", "part")).applyInArrow(probe, "mark bigint")


def known(spark: SparkSession, path: str, older: str) -> DataFrame:
    """``sha, keep_id``: texts of the snapshot at ``path`` that ``older`` holds too, by their bytes, with the id kept there."""
    asked = cut_lineage(positives(spark, path, older))
    new = _texts(spark, path).join(asked, "mark", "left_semi").select("mark", "sha", "body")
    old = _texts(spark, older).join(asked, "mark", "left_semi").select("mark", "body", F.col("keep_id").alias("old_id"))
    return new.join(old, ["mark", "body"]).select("sha", F.col("old_id").alias("keep_id"))


# -- whole tables -------------------------------------------------------------
def batches_of(docs: DataFrame, key: str, batches: int) -> list[DataFrame]:
    """The table in batches of about equal size, in ascending order of the key; rows without key come last."""
    c = F.col(f"`{key}`").cast("bigint")
    at = docs.select(F.percentile_approx(c, [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    at = sorted(set(at))
    ends = [None, *at, None]
    out = []
    for low, high in zip(ends, ends[1:]):
        test = F.lit(True) if low is None else c.isNull() | (c > low)
        out.append(docs.filter(test if high is None else test & (c <= high)))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Batch after batch becomes a snapshot and is screened against those before
    it. Texts are equal when they are identical after ASCII white space runs
    became one blank; NULL is empty. The row with the smallest id stays, rows
    without id come last; of rows that also share the id one stays. Other
    columns are left out. An empty table gives no rows.
    """
    spark, paths, found = docs.sparkSession, [], []
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    for batch in batches_of(docs, "doc_id", batches):
        path = shared_dir(spark, "snapshot")
        snapshot(batch, path)
        found += [known(spark, path, older) for older in paths]
        found.append(_texts(spark, path).select("sha", "keep_id", "copies"))
        paths.append(path)
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more, allowMissingColumns=True)
    groups = groups.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # Rows meet their group in two steps, so that a text of many rows is spread over the salts.
    salt = F.pmod(F.xxhash64("row"), F.lit(max(64, partitions(spark)))).alias("salt")
    rows = cut_lineage(digests(docs).select("doc_id", "sha", F.monotonically_increasing_id().alias("row"))).select("*", salt)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    parts = rows.groupBy("sha", "salt").agg(F.min(order).alias("first"))
    heads = parts.groupBy("sha").agg(F.min("first").alias("first")).select("sha", F.col("first.row").alias("head"))
    parts = parts.select("sha", "salt").join(groups.join(heads, "sha"), "sha")
    return rows.join(parts, ["sha", "salt"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("head")).alias("kept"), F.col("sha").alias("text_sha256"))
