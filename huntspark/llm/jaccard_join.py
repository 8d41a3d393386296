"""N-gram Jaccard join by a blocked sparse product of documents and n-grams.

The links between documents are the entries of the product of the incidence
matrix with its transpose that reach the bound. Three passes over the texts
keep it sparse:

1. sizes and ids of all shingle sets (equal sets are one row of the matrix from
   here on), and shingles that are frequent in a batch. The most frequent ones
   (at most ``HOT``, so their broadcast is bounded) come last in the order of
   columns, which only affects speed;
2. the first HEAD per cent of each row's columns, dealt to shards. Of two rows
   that reach the bound, the one whose head ends first has at least as many of
   the other's columns in it as HEAD exceeds what the sizes let it miss: a
   count that is known from the size. Only columns with several rows go on, and
   only rows with that many such columns; shared passages are too short for it.
   A column names the least of its rows, and every row that meets it in some
   column joins the group of that least row. Columns that share their least row
   make one group, so near copies, which share very many columns, meet a few
   times only. A row leaves the groups that it meets by few columns, as far as
   its partners' count of shared columns is sure to hold in the others;
3. the whole sets of the rows in groups (a filter of fixed size skips most
   others before the shuffle). A group is a block of the product. Of a large
   group the row of its least member is multiplied first, in parts: what it
   links is connected, and pairs among these rows need no look. The rows it does
   not link, cut into blocks, are multiplied with each other and with all the
   rest, each pair of blocks in a task. So a row moves once or twice, however
   large its group of copies is. A task adds up overlaps over slices of columns
   and drops pairs whose overlap so far plus what is left cannot reach the bound
   their sizes set. It returns only which rows its links connect.

No pair is skipped in a group but those that are connected already, so nothing
that links connect is lost, and what leaves a task is at most one row per set in
it.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import shingles
from .common import cut_lineage, give_back, partitions, small_batches
from .components import components

WIDTH = 5
#: The bound: 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Share of a row's columns, in per cent, in which candidates are sought; above 100 - PERCENT.
HEAD = 40
#: Frequent shingles that come last; how often one occurs in a batch to be counted.
HOT, OFTEN = 200_000, 4
#: Sets of a block of a large group, about, and their shingles together.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Bits of the filter of wanted sets.
FILTER_BITS = 24
#: Columns of a slice.
SLICE = 4096


def _fresh(ids: np.ndarray, met: set) -> np.ndarray:
    """Marks sets that this task has not met, within bounded memory."""
    out = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if x not in met:
            out[i] = True
            met.add(x)
    if len(met) > 1_000_000:
        met.clear()
    return out


def measured(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """Pass 1: ``kind 0``: document, size and set id; ``kind 1``: a frequent shingle and its count."""
    def run(batches):
        met: set = set()
        for batch in batches:
            keys = batch.column(0)
            for at, tokens, bounds in shingles.sets(batch.column(1), width):
                ids, n = shingles.set_ids(tokens, bounds), np.diff(bounds)
                new = _fresh(ids, met) & (n > 0)
                own = np.sort(tokens[np.repeat(new, n)])
                begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
                times = np.diff(np.append(begins, len(own)))
                often = begins[times >= OFTEN]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([np.zeros(len(n), np.int32), np.ones(len(often), np.int32)])),
                    pa.concat_arrays([keys.slice(at, len(n)), pa.nulls(len(often), pa.int64())]),
                    pa.array(np.concatenate([n, times[times >= OFTEN]])), pa.array(np.concatenate([ids, own[often].astype(np.int64)]))], names=["kind", "doc_id", "n", "id"])

    return docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).mapInArrow(run, "kind int, doc_id bigint, n bigint, id bigint")


def column_entries(docs: DataFrame, text: str, hot: np.ndarray, shards: int, width: int = WIDTH, head: int = HEAD) -> DataFrame:
    """Pass 2: ``shard, columns, ids``: the first columns of new sets, packed per shard."""
    hot = np.sort(hot.astype(np.uint64))

    def run(batches):
        met: set = set()
        for batch in batches:
            for _, tokens, bounds in shingles.sets(batch.column(0), width):
                ids, n = shingles.set_ids(tokens, bounds), np.diff(bounds)
                new = _fresh(ids, met) & (n > 0)
                row = np.repeat(np.arange(len(n)), n)
                row, own = row[new[row]], tokens[np.repeat(new, n)]
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
                    order = np.argsort(((row.astype(np.uint64) << np.uint64(1)) | late).astype(np.uint64), kind="stable")
                    row, own = row[order], own[order]
                length = np.where(new, n, 0)
                begin = np.cumsum(length) - length
                early = np.arange(len(row)) - begin[row] < (-(-n * head // 100))[row]
                row, own = row[early], own[early]
                shard = (own % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                shard, own, who = shard[order], (own[order] // np.uint64(shards)).astype("<u4"), ids[row[order]].astype("<i8")
                cut = np.searchsorted(shard, np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([own[cut[s]:cut[s + 1]].tobytes() for s in full], pa.binary()),
                                                  pa.array([who[cut[s]:cut[s + 1]].tobytes() for s in full], pa.binary())], names=["shard", "columns", "ids"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "shard int, columns binary, ids binary")


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """The columns of a shard that several sets have, and these sets.

    Columns are told apart by 32 bits within a shard: where two are taken for
    one, sets meet for nothing.
    """
    column = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["columns"]])
    who = np.concatenate([np.frombuffer(b, "<i8") for b in pdf["ids"]])
    order = np.lexsort((who, column))
    column, who = column[order], who[order]
    fresh = np.append(True, (column[1:] != column[:-1]) | (who[1:] != who[:-1]))
    column, who = column[fresh], who[fresh]
    begins = np.append(True, column[1:] != column[:-1])
    times = np.diff(np.append(np.flatnonzero(begins), len(column)))
    keep = np.repeat(times > 1, times)
    del order, fresh, begins, times
    give_back()
    return pd.DataFrame({"column": (column[keep].astype(np.int64) << 24) | int(pdf["shard"].iloc[0]), "id": who[keep]})


def wanted_sets(docs: DataFrame, text: str, bits: np.ndarray, width: int = WIDTH) -> DataFrame:
    """Pass 3: ``id, tokens`` of the sets that the filter lets through."""
    def run(batches):
        met: set = set()
        for batch in batches:
            for _, tokens, bounds in shingles.sets(batch.column(0), width):
                ids = shingles.set_ids(tokens, bounds)
                ok = np.ones(len(ids), bool)
                for place in _places(ids):
                    ok &= (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
                ok[ok] = _fresh(ids[ok], met)
                keep = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array([tokens[bounds[i]:bounds[i + 1]].astype("<i8").tobytes() for i in keep], pa.binary())], names=["id", "tokens"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "id bigint, tokens binary")


def _places(ids: np.ndarray):
    for shift in (0, 24, 40):
        yield (ids.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << FILTER_BITS) - 1)


def filter_bits(ids: DataFrame) -> np.ndarray:
    """The filter's words; the driver gets at most 2 ** FILTER_BITS / 64 rows however many ids there are."""
    place = F.explode(F.array(*[F.shiftrightunsigned("id", s).bitwiseAND((1 << FILTER_BITS) - 1) for s in (0, 24, 40)]))
    rows = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toPandas()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.uint64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def connected(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For every set the least index among the sets that links between ``left`` and ``right`` tie it to.

    ``left`` and ``right`` are the indices of the rows and the columns of the block.
    """
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    ordered = flat[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    times = np.diff(np.append(begins, len(ordered)))
    column = np.repeat(np.arange(len(begins)), times)
    shared = np.repeat(times > 1, times)
    row, column = row[order][shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    total = size[left][:, None] + size[right][None, :]
    # 100 o >= p (total - o)
    need = -(-percent * total // (100 + percent))
    overlap = np.zeros(total.shape, np.float32)
    open_pairs = np.minimum(size[left][:, None], size[right][None, :]) >= need
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    rest_l, rest_r = np.bincount(row, minlength=len(sets))[left].astype(np.int64), np.bincount(row, minlength=len(sets))[right].astype(np.int64)
    columns = int(column.max()) + 1 if len(column) else 0
    for at in range(0, columns, SLICE):
        # What is still to come bounds the overlap of a pair.
        open_pairs &= overlap + np.minimum(rest_l[:, None], rest_r[None, :]) >= need
        if not open_pairs.any():
            break
        a, b = np.searchsorted(column, (at, at + SLICE))
        r, c = row[a:b], column[a:b] - at
        dense_l, dense_r = np.zeros((len(left), SLICE), np.float32), np.zeros((len(right), SLICE), np.float32)
        in_l, in_r = place_l[r] >= 0, place_r[r] >= 0
        dense_l[place_l[r[in_l]], c[in_l]] = 1
        dense_r[place_r[r[in_r]], c[in_r]] = 1
        overlap += dense_l @ dense_r.T
        rest_l -= dense_l.sum(1).astype(np.int64)
        rest_r -= dense_r.sum(1).astype(np.int64)
    linked = open_pairs & (overlap >= need)
    label = np.arange(len(sets))
    i, j = np.nonzero(linked)
    i, j = left[i], right[j]
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _ties(batches):
    """Runs of one (least, i, j): the sets of a block pair; yields what their links tie together."""
    held, name = [], None

    def close():
        first: dict = {}
        for _, _, _, part, who, tokens in held:
            first.setdefault(who, (part, tokens))
        ids = np.array(sorted(first), dtype=np.int64)
        if len(ids) < 2:
            return None
        part = np.array([first[x][0] for x in ids.tolist()])
        sets = [np.frombuffer(first[x][1], "<i8") for x in ids.tolist()]
        left, right = np.flatnonzero(part == name[1]), np.flatnonzero(part == name[2])
        label = connected(sets, left, right)
        tied = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[tied], "b": ids[label[tied]]}) if len(tied) else None

    out: list = []
    for pdf in batches:
        for row in zip(pdf["least"], pdf["i"], pdf["j"], pdf["part"], pdf["id"], pdf["tokens"]):
            if row[:3] != name:
                if held and (done := close()) is not None:
                    out.append(done)
                held, name = [], row[:3]
            held.append(row)
        if len(out) > 500:
            yield pd.concat(out)
            out = []
    if held and (done := close()) is not None:
        out.append(done)
    held = []
    give_back()
    yield pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})


def _stars(batches):
    """Runs of one (least, part): whether the least set, which every part has, links each set of the part."""
    out: list = []
    head, name = None, None
    for pdf in batches:
        for least, part, who, n, tokens in zip(pdf["least"], pdf["part"], pdf["id"], pdf["n"], pdf["tokens"]):
            if (least, part) != name:
                # Rows are sorted so that the least set comes first.
                name, head = (least, part), np.frombuffer(tokens, "<i8")
                continue
            own = np.frombuffer(tokens, "<i8")
            at = np.minimum(np.searchsorted(head, own), len(head) - 1)
            overlap = int((head[at] == own).sum())
            out.append((least, who, n, 100 * overlap >= PERCENT * (len(head) + len(own) - overlap)))
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["least", "id", "n", "linked"])
            out = []
    yield pd.DataFrame(out, columns=["least", "id", "n", "linked"]).astype({"least": "int64", "id": "int64", "n": "int64", "linked": bool})


def _blocks_of(rows: DataFrame) -> DataFrame:
    """``least, blocks``: how many blocks the sets of each group make."""
    return rows.groupBy("least").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _dealt(blocks: str):
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _linked_by_least(members: DataFrame, found: DataFrame, tasks: int) -> DataFrame:
    """``least, id, n, linked`` of large groups (``members`` with ``blocks``), the least set itself left out."""
    parts = members.filter("id <> least").withColumn("part", _dealt("blocks")).select("least", "part", "id", "n")
    heads = members.filter("id = least").select("least", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "id", "n")
    rows = parts.unionByName(heads).join(found, "id").repartition(tasks, "least", "part")
    rows = rows.sortWithinPartitions("least", "part", F.col("id") != F.col("least"))
    return rows.select("least", "part", "id", "n", "tokens").mapInPandas(_stars, "least bigint, id bigint, n bigint, linked boolean")


def _open_pairs(stars: DataFrame, blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """``least, i, j, part, id``: blocks of rows the least does not link, with each other and with the blocks of all the others."""
    rest = stars.filter("NOT linked").select("least", "id", "n")
    mine = rest.join(_blocks_of(rest).withColumnRenamed("blocks", "open"), "least").join(blocks, "least").withColumn("part", _dealt("open"))
    partner = F.explode(F.sequence(F.lit(0), F.col("open") + F.col("blocks") - 1))
    mine = mine.withColumn("with", partner).select("least", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id")
    closed = stars.filter("linked").select("least", "id").unionByName(heads.select("least", "id"))
    closed = closed.join(_blocks_of(rest).withColumnRenamed("blocks", "open"), "least").join(blocks, "least").withColumn("part", F.col("open") + _dealt("blocks"))
    closed = closed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("open") - 1))).select("least", "i", F.col("part").alias("j"), "part", "id")
    return mine.unionByName(closed)


def _worthwhile(times: DataFrame, need) -> DataFrame:
    """``least, id``: rows in groups, without those that a row joins by few columns and can do without.

    Two rows that link share at least ``need`` columns of either. Each may leave
    groups as long as it met them by less than half of its own ``need`` columns
    together: both have then left groups by fewer columns than they share, so
    they still meet in one.
    """
    rest = Window.partitionBy("id").orderBy("c", "least").rowsBetween(Window.unboundedPreceding, 0)
    return times.withColumn("upto", F.sum("c").over(rest)).filter(2 * F.col("upto") >= need).select("least", "id")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    A component is what links reach; its id is the smallest document id in it
    (NULL ids count only where there is no other). Texts without words, empty
    and NULL ones are linked with nothing, also not with each other. Equal rows
    are linked like any equal texts. Other columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = cut_lineage(measured(docs, key, text, width))
    often = rows.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(HOT)
    hot = often.select("id").toPandas()["id"].to_numpy(np.int64)
    n = partitions(docs.sparkSession)
    shards = max(1, 2 * n)
    entries = column_entries(docs, text, hot, shards, width)
    shared = cut_lineage(entries.groupBy("shard").applyInPandas(_shared, "column bigint, id bigint"))
    sizes = rows.filter("kind = 0").groupBy("id").agg(F.max("n").alias("n"))
    # A partner has at least PERCENT of this row's size, and shares HEAD + PERCENT - 100 per cent of its own.
    need = F.floor(F.col("n") * percent / 100 * (HEAD + percent - 100) / 100)
    able = cut_lineage(shared.groupBy("id").count().join(sizes, "id").filter(F.col("count") >= need).select("id", "n"))
    lists = cut_lineage(shared.join(able, "id"))
    least = lists.groupBy("column").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("column", "least")
    times = lists.join(least, "column").filter("id <> least").groupBy("least", "id", "n").agg(F.count("*").alias("c"))
    met = cut_lineage(_worthwhile(times, need))
    heads = met.select("least").distinct().select("least", F.col("least").alias("id"))
    members = met.unionByName(heads).join(able, "id")
    blocks = cut_lineage(_blocks_of(members).filter("blocks > 1"))
    small = members.join(blocks, "least", "left_anti").select("least", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "id")
    large = members.join(blocks, "least")
    bits = filter_bits(met.select("id").unionByName(met.select(F.col("least").alias("id"))).distinct())
    found = cut_lineage(wanted_sets(docs, text, bits, width).dropDuplicates(["id"]))
    stars = cut_lineage(_linked_by_least(large, found, 2 * n))
    pairs = small.unionByName(_open_pairs(stars, blocks, large.filter("id = least")))
    pairs = pairs.join(found, "id").repartition(2 * n, "least", "i", "j").sortWithinPartitions("least", "i", "j")
    links = pairs.select("least", "i", "j", "part", "id", "tokens").mapInPandas(_ties, "a bigint, b bigint")
    links = cut_lineage(links.unionByName(stars.filter("linked").select(F.col("id").alias("a"), F.col("least").alias("b"))))
    classes = components(links)
    docs_of = rows.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "id")
    some = docs_of.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("first"))
    some = some.join(classes, some["id"] == classes["node"], "left").select("id", "first", F.coalesce("least", "id").alias("class"))
    named = cut_lineage(some)
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    named = named.join(least, "class").select("id", "component_id")
    return docs_of.join(named, "id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
