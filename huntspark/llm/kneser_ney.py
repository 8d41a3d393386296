"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters (code points), ``ORDER`` of them; a text is preceded by
start marks. Counts of n-grams, continuation counts of the lower orders and
context sums are tables, as large as the trusted text makes them; three
discounts per order follow from the counts of counts.

Scoring is a join by shards of n-grams. Texts are dealt to blocks of bounded
size; a block asks once for each distinct n-gram in it. The n-grams asked for
by any block are joined with the counts and contexts of all orders, from the
shortest upwards, which gives each its interpolated probability, and the
answers return to the blocks, where the texts are scored. So what moves is the
distinct n-grams of blocks and each text once, compressed; no table of the
model is sent to all tasks.

A document's log-perplexity is pulled towards its language's median as if it
had ``PRIOR`` more characters of that kind, so that short texts are not judged
by a few letters. The limit of a language is the trusted documents' quantile
``UPPER`` plus ``SPREAD`` times its distance to the median.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage, give_back, small_batches
from .jaccard_join import _places, filter_bits
from .shingles import SLICE
from .tokens import buffers

ORDER = 4
START = "\x02"
#: Characters of a block that is scored in one piece.
BLOCK_CHARS = 5_000_000
PRIOR = 200
UPPER, SPREAD = 0.95, 3.0
SLOT_BITS = 20
#: Characters that are hashed at once.
STEP = 200_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _keys(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of every window of ``order`` code points, in steps that fit the cache."""
    out = np.empty(max(0, len(points) - order + 1), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(out), STEP):
            n = min(STEP, len(out) - at)
            part = points[at:at + n + order - 1].astype(np.uint64)
            h = part[:n] * _P
            for i in range(1, order):
                h += part[i:i + n]
                h *= _P
            h ^= h >> np.uint64(31)
            h *= _Q
            h ^= h >> np.uint64(32)
            out[at:at + n] = h
    return out


def windows(texts: list[str], order: int):
    """``(joined text, keys, mask, lengths)``: the windows that end at a character of a text.

    ``mask`` marks their places among all windows of the joined text.
    """
    joined = "".join([START * (order - 1) + t for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    length = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(length + order - 1) - (length + order - 1)
    mask = np.ones(max(0, len(points) - order + 1), bool)
    for back in range(1, order):  # windows that end at a start mark
        at = first - back
        mask[at[(at >= 0) & (at < len(mask))]] = False
    return joined, _keys(points, order)[mask], mask, length


def strings(column: pa.Array, most: int = SLICE // 2):
    """Runs of a text column of about ``most`` bytes, as lists: a batch never stands in Python strings whole."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1), len(column))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def slices(texts: list[str], most: int = STEP):
    """Consecutive runs of texts of about ``most`` characters."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield texts[at:i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def gram_counts(docs: DataFrame, text: str, order: int = ORDER) -> DataFrame:
    """``gram, c`` of all texts."""
    def run(batches):
        for batch in batches:
            for _, part in strings(batch.column(0)):
                joined, keys, mask, _ = windows(part, order)
                if len(keys):
                    by = np.argsort(keys)
                    begins = np.flatnonzero(np.append(True, np.diff(keys[by]) != 0))
                    some = np.flatnonzero(mask)[by[begins]]
                    yield pa.RecordBatch.from_arrays([pa.array([joined[p:p + order] for p in some.tolist()]), pa.array(np.diff(np.append(begins, len(by))))], names=["gram", "c"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "gram string, c bigint").groupBy("gram").agg(F.sum("c").alias("c"))


class Model:
    """The tables of a trained model."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        self.grams: dict[int, DataFrame] = {}
        rows = counts
        for k in range(order, 0, -1):
            if k < order:
                # How many characters come before it.
                rows = self.grams[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
            self.grams[k] = cut_lineage(rows)
        each = [g.agg(F.lit(k).alias("k"), F.count("*").alias("v"), *[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]) for k, g in self.grams.items()]
        every = each[0]
        for e in each[1:]:
            every = every.unionByName(e)
        self.discounts, self.letters = {}, 1
        for r in every.collect():  # one row per order
            n1, n2, n3, n4 = (max(r[f"n{i}"], 0) for i in range(1, 5))
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
            self.discounts[r["k"]] = tuple(min(max(x, 0.05), i) for i, x in enumerate(d, 1))
            if r["k"] == 1:
                self.letters = r["v"] + 1
        self.contexts = {k: self._context(k) for k in self.grams}

    def discount(self, k: int) -> Column:
        d1, d2, d3 = self.discounts[k]
        return F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)

    def _context(self, k: int) -> DataFrame:
        """Per context its total and the weight it leaves to the shorter one."""
        return self.grams[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(
            F.sum("c").alias("total"), (F.sum(self.discount(k)) / F.sum("c")).alias("left"))

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """``gram, p`` of distinct grams of the full order.

        The shorter orders are written one by one: as one plan the joins of all
        orders run at once, and the driver holds what Spark keeps of each of
        their stages and tasks.
        """
        asked = {self.order: wanted.select("gram")}
        if self.order > 1:
            ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.substring("gram", self.order - k + 1, k).alias("gram")) for k in range(1, self.order)]))
            shorter = cut_lineage(wanted.select(ends.alias("end")).select("end.*").distinct())
            asked |= {k: shorter.filter(F.col("k") == k).select("gram") for k in range(1, self.order)}
        out = None
        for k in range(1, self.order + 1):
            rows = asked[k]
            if k == 1:
                below = F.lit(1.0 / self.letters)
            else:
                rows = rows.withColumn("short", F.substring("gram", 2, k - 1)).join(out.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
                below = F.col("below")
            rows = rows.withColumn("context", F.substring("gram", 1, k - 1)).join(self.contexts[k], "context", "left")
            # Last, so that the rows lie by gram for what follows.
            rows = rows.join(self.grams[k].select("gram", F.greatest(F.col("c") - self.discount(k), F.lit(0.0)).alias("own")), "gram", "left")
            p = F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * below
            out = rows.select("gram", p.alias("p"))
            if k < self.order:
                out = cut_lineage(out)
        return out


def _blocks(batches):
    """``(block, keys, texts)`` of the rows of a task, cut at a fixed number of characters."""
    base, number, keys, texts, n = TaskContext.get().partitionId() << 24, 0, [], [], 0
    for batch in batches:
        for at, some in strings(batch.column(1)):
            for key, t in zip(batch.column(0).slice(at, len(some)).to_pylist(), some):
                keys.append(key)
                texts.append(t)
                n += len(t)
                if n >= BLOCK_CHARS:
                    yield base + number, keys, texts
                    number, keys, texts, n = number + 1, [], [], 0
    if texts:
        yield base + number, keys, texts


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, log_perplexity`` per row, in nats per character; NULL for empty texts.

    ``docs`` is read twice and its rows must come in the same partitions both
    times, as those of files and written tables do; else the second reading
    finds n-grams that it did not ask for and fails.
    """
    order = model.order
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def ask(batches):
        for block, _, texts in _blocks(batches):
            met = np.zeros(1 << SLOT_BITS, np.uint64)
            late = np.empty(0, np.uint64)
            for part in slices(texts):
                joined, keys, mask, _ = windows(part, order)
                slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                new = np.flatnonzero(met[slot] != keys)
                if not len(new):
                    continue
                new = new[np.argsort(keys[new])]
                new = new[np.append(True, np.diff(keys[new]) != 0)] if len(new) else new
                if len(late):
                    new = new[late[np.minimum(np.searchsorted(late, keys[new]), len(late) - 1)] != keys[new]]
                # Each part is sent at once: as Arrow strings the grams of a block are a fraction of what they are in Python.
                grams = pa.array([joined[p:p + order] for p in np.flatnonzero(mask)[new].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block, np.int64)), grams], names=["block", "gram"])
                free = met[slot[new]] == 0
                met[slot[new[free]]] = keys[new[free]]
                # Those whose slot another one holds.
                other = keys[new][met[slot[new]] != keys[new]]
                if len(other):
                    late = np.sort(np.concatenate([late, other]))
            give_back()

    def carry(batches):
        import pickle
        import zstandard
        for block, keys, texts in _blocks(batches):
            data = zstandard.ZstdCompressor(level=3).compress(pickle.dumps((keys, [t.encode("utf-8", "surrogatepass") for t in texts])))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])

    # Written once: every order of the model asks anew.
    asked = cut_lineage(rows.mapInArrow(ask, "block bigint, gram string"))
    known = model.probabilities(cut_lineage(asked.select("gram").distinct()))
    answers = asked.join(known, "gram").select("block", "gram", F.log("p").cast("float").alias("logp"))

    def judge(texts_of, answer):
        import pickle
        import zstandard
        out = []
        # The grams lie end to end in their column, so no string is made of each.
        data, _ = buffers(answer.column("gram"))
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        known_keys = _keys(points, order)[::order] if len(points) else np.empty(0, np.uint64)
        del data, points
        by = np.argsort(known_keys)
        sorted_keys, logp = known_keys[by], answer.column("logp").to_numpy().astype(np.float64)[by]
        table, value = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS)
        slot = (sorted_keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        table[slot], value[slot] = sorted_keys, logp
        for data in texts_of.column("data"):
            keys, raw = pickle.loads(zstandard.ZstdDecompressor().decompress(data.as_buffer()))
            at = 0
            for part in slices(raw):
                part = [t.decode("utf-8", "surrogatepass") for t in part]
                _, grams, _, n = windows(part, order)
                slot = (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                got = value[slot]
                other = np.flatnonzero(table[slot] != grams)
                if len(other):
                    place = np.minimum(np.searchsorted(sorted_keys, grams[other]), len(sorted_keys) - 1)
                    if (sorted_keys[place] != grams[other]).any():
                        raise ValueError("the rows were not in the same partitions when they were read again")
                    got[other] = logp[place]
                total, full = np.zeros(len(part)), np.flatnonzero(n)
                if len(full):
                    total[full] = np.add.reduceat(got, (np.cumsum(n) - n)[full])
                out.append(pa.table({"doc_id": pa.array(keys[at:at + len(part)], pa.int64()), "n": pa.array(n, pa.int64()), "log_perplexity": np.where(n > 0, -total / np.maximum(n, 1), np.nan)}))
                at += len(part)
        del known_keys, sorted_keys, logp, table, value
        give_back()
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "log_perplexity": pa.array([], pa.float64())})

    texts = rows.mapInArrow(carry, "block bigint, data binary")
    answers = answers.withColumnRenamed("block", "asker")
    done = texts.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(judge, "doc_id bigint, n bigint, log_perplexity double")
    return done.withColumn("log_perplexity", F.when(~F.isnan("log_perplexity"), F.col("log_perplexity")))


def trusted_rows(docs: DataFrame, trusted: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is in ``trusted``; a filter of fixed size keeps most other texts from moving.

    The rows are shuffled also when few ids are trusted: a Python step behind a
    broadcast join would share the filter's stage, and a task with two Python
    steps holds two workers, which stay with the executor through later stages.
    """
    bits = filter_bits(trusted.select(F.xxhash64(F.col(key).cast("bigint")).alias("id")))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        ids = h.to_numpy(np.int64)
        ok = np.ones(len(ids), bool)
        for place in _places(ids):
            ok &= (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pd.Series(ok)

    ids = trusted.select(F.col(key).cast("bigint").alias("_trusted"))
    return docs.filter(maybe(F.xxhash64(F.col(key).cast("bigint")))).join(ids.hint("merge"), F.col(key) == F.col("_trusted"), "left_semi")


def judged(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER,
           prior: int = PRIOR, upper: float = UPPER, spread: float = SPREAD) -> DataFrame:
    """``doc_id, lang, n, log_perplexity, score, threshold, keep`` per row of ``docs``.

    ``trusted`` lists the ids of trusted documents. A document is kept when its
    score does not exceed its language's threshold, and when there is nothing to
    judge by: an empty or NULL text, or a language without trusted documents.
    A NULL language is a language of its own. Rows that share an id are scored
    one by one and listed together; if their texts differ the first language
    and the lower score of the id count. Other columns are left out.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # Written once: the filter, the model and the rows below read it.
    good = cut_lineage(trusted.select(F.col(key).cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL").distinct())
    model = Model(gram_counts(trusted_rows(base, good), "text", order), order)
    found = cut_lineage(scores(base.select("doc_id", "text"), model))
    # Scores, languages and trust meet by id in one aggregation.
    parts = found.select("doc_id", "n", "log_perplexity", F.lit(1).alias("_copies")).unionByName(base.select("doc_id", "lang"), allowMissingColumns=True).unionByName(
        good.withColumn("_good", F.lit(True)), allowMissingColumns=True)
    rows = parts.groupBy("doc_id").agg(F.max("n").alias("n"), F.min("log_perplexity").alias("log_perplexity"), F.sum("_copies").alias("_copies"),
                                       F.min("lang").alias("lang"), F.coalesce(F.max("_good"), F.lit(False)).alias("_good"))
    rows = cut_lineage(rows.filter("_copies > 0"))
    middle = rows.filter("_good AND log_perplexity IS NOT NULL").groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("median"))
    rows = _by_lang(rows, cut_lineage(middle))  # one row per language
    score = (F.col("log_perplexity") * F.col("n") + F.col("median") * prior) / (F.col("n") + prior)
    rows = rows.withColumn("score", score)
    high = rows.filter("_good").groupBy("lang").agg(F.percentile_approx("score", upper, 10_000).alias("high"))
    rows = _by_lang(rows, high)
    threshold = F.col("high") + spread * (F.col("high") - F.col("median"))
    rows = rows.withColumn("threshold", threshold)
    rows = rows.withColumn("keep", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    return rows.withColumn("_copy", copies).select("doc_id", "lang", "n", "log_perplexity", "score", "threshold", "keep")


def _by_lang(rows: DataFrame, per: DataFrame) -> DataFrame:
    per = per.withColumnRenamed("lang", "_lang")
    return rows.join(per, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
