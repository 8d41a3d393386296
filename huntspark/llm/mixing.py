"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks of about ``block_words`` words by a hash
of their content. A target of several times the source's size draws every block
once per full epoch; the last, partial epoch draws the first blocks of another
permutation, and of the block on the border only so many words as the target
still lacks (the last document is cut there). So each source's quota of drawn
blocks is exact.

The draws are then spread over the output shards by a tree: a node that stands
for the shards [lo, hi) holds the number of draws of each source it must
place; its left half receives a multivariate-hypergeometric sample of them
(one conditional hypergeometric draw per source, by inversion of the exact
ratio recurrence), the right half the rest. Leaves therefore have exact counts
that sum to the quotas, distributed as if all draws had been shuffled globally.
Each leaf takes the next unused draws of every source from that source's own
permutation, which makes shards disjoint, and a shard is shuffled only inside.

Only built-in functions are used. Tables per source and per block are small
against the documents (one row per ``block_words`` words); texts move once.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, cut_lineage, uniform, words_in

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
MAX_REPEATS = 3
BLOCK_WORDS = 65_536
BLOCKS_PER_SHARD = 64


def measured(docs: DataFrame, source: str, text: str, key: str, seed: int) -> DataFrame:
    """``docs`` with its source, size and hash under names of our own."""
    return docs.withColumns({
        "_mix_source": F.col(source).cast("string"),
        "_mix_size": words_in(F.col(text)),
        "_mix_hash": F.xxhash64(F.lit(seed), F.col(key), F.col(text)),
    })


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: its size, its place in code point order and its target.

    ``sizes`` has ``_mix_source`` and ``_mix_size``. Targets are shares of the
    total by weight, stopped at ``repeats`` times the source's size; what a
    stopped source leaves is reshared among the others until none is above.
    With sources sorted by limit over weight those stopped are a prefix, so the
    common level follows from prefix sums over the table of sources.
    """
    per = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last()))
    per = per.withColumn("place", place - 1)
    per = per.withColumns({
        "weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")),
        "limit": F.col("source_size") * float(repeats)})
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "rank": F.row_number().over(order),
        "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))})
    open_rank = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("rank"))
    level = F.min_by("level", open_rank).over(every)
    return per.select("_mix_source", "place", "source_size",
                      F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def hypergeometric(pool: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` taken from ``pool`` are ``marked``, by inversion at ``u``.

    The weights follow the exact ratio of neighbouring probabilities, from 12
    standard deviations below the mean to 12 above; what lies outside has a
    probability below 1e-30.
    """
    p = marked / F.greatest(pool, F.lit(1))
    mean = drawn * p
    wide = 12 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - p) * (pool - drawn) / F.greatest(pool - 1, F.lit(1)))) + 5
    low = F.greatest(F.lit(0).cast("bigint"), drawn - pool + marked, F.floor(mean - wide).cast("bigint"))
    high = F.least(marked, drawn, F.ceil(mean + wide).cast("bigint"))
    steps = F.sequence(low, F.greatest(low, high))

    def after(w: Column, k: Column) -> Column:
        return w * (marked - k) * (drawn - k) / F.greatest(F.lit(1.0), (k + 1) * (pool - marked - drawn + k + 1).cast("double"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    total = F.aggregate(steps, start, lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"])
    first = F.struct(F.lit(1.0).alias("w"), (u * total).alias("left"), F.lit(None).cast("bigint").alias("pick"))
    return F.aggregate(
        steps, first,
        lambda a, k: F.struct(after(a["w"], k).alias("w"), (a["left"] - a["w"]).alias("left"),
                              F.when(a["pick"].isNull() & (a["left"] < a["w"]), k).otherwise(a["pick"]).alias("pick")),
        lambda a: F.coalesce(a["pick"], high))


def split_tree(counts: DataFrame, draws: int, shards: int, seed: int) -> DataFrame:
    """``(shard, place, count)``: how many draws of each source every shard gets.

    ``counts`` has ``place`` and ``quota``. One row per node carries the quotas
    of all sources (a label with few values); each level halves the shards.
    """
    base, more = divmod(draws, shards)

    def room(lo: Column, hi: Column) -> Column:
        return (hi - lo) * F.lit(base) + F.least(hi, F.lit(more)) - F.least(lo, F.lit(more))

    nodes = counts.agg(F.array_sort(F.collect_list(F.struct("place", F.col("quota").cast("bigint").alias("quota")))).alias("have")).select(
        F.lit(0).cast("bigint").alias("lo"), F.lit(shards).cast("bigint").alias("hi"), "have")
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint")
        nodes = nodes.withColumn("mid", mid)
        start = F.struct(room(F.col("lo"), F.col("hi")).cast("bigint").alias("pool"), room(F.col("lo"), F.col("mid")).cast("bigint").alias("need"),
                         F.array().cast("array<struct<place:int,quota:bigint>>").alias("out"))

        def one(a: Column, s: Column) -> Column:
            k = hypergeometric(a["pool"], s["quota"], a["need"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), s["place"]))
            with_k = F.transform(F.array(k), lambda got: F.struct(
                (a["pool"] - s["quota"]).alias("pool"), (a["need"] - got).alias("need"),
                F.concat(a["out"], F.array(F.struct(s["place"].alias("place"), got.alias("quota")))).alias("out")))
            return with_k[0]

        nodes = nodes.withColumn("left", F.aggregate("have", start, one, lambda a: a["out"]))
        right = F.zip_with("have", "left", lambda h, g: F.struct(h["place"].alias("place"), (h["quota"] - g["quota"]).alias("quota")))
        halves = F.when(F.col("hi") - F.col("lo") > 1, F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("have")),
            F.struct(F.col("mid").alias("lo"), "hi", right.alias("have")))).otherwise(F.array(F.struct("lo", "hi", "have")))
        nodes = nodes.select(F.inline(halves))
    return nodes.select(F.col("lo").alias("shard"), F.inline("have")).select("shard", "place", F.col("quota").alias("count"))


def block_draws(sizes: DataFrame, targets: DataFrame, block_words: int, blocks_per_shard: int, seed: int) -> DataFrame:
    """One row per source and block that the mix draws, with its draws.

    ``_mix_draws`` lists ``(epoch, shard, quota)``; ``quota`` is NULL for a whole
    block and else the words still wanted. At most ``repeats + 1`` entries.
    """
    keyed = in_blocks(sizes, targets, block_words)
    blocks = keyed.groupBy("_mix_place", "_mix_block").agg(F.sum("_mix_size").alias("words"))
    blocks = blocks.join(targets.select(F.col("place").alias("_mix_place"), "source_size", "target"), "_mix_place").filter("words > 0")
    whole = F.floor(F.round("target") / F.col("source_size")).cast("bigint")
    blocks = blocks.withColumns({"epochs": whole, "rest": F.round("target").cast("bigint") - whole * F.col("source_size")})
    partial = Window.partitionBy("_mix_place").orderBy(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("_mix_block")), "_mix_block")
    blocks = blocks.withColumn("upto", F.sum("words").over(partial))
    before = F.col("upto") - F.col("words")
    full = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("epochs")), lambda e: F.struct((e - 1).alias("epoch"), F.lit(None).cast("bigint").alias("quota")))
    last = F.array(F.struct(F.col("epochs").alias("epoch"), F.when(F.col("upto") > F.col("rest"), F.col("rest") - before).alias("quota")))
    listed = F.concat(F.when(F.col("epochs") > 0, full).otherwise(F.array().cast("array<struct<epoch:bigint,quota:bigint>>")),
                      F.when(before < F.col("rest"), last).otherwise(F.array().cast("array<struct<epoch:bigint,quota:bigint>>")))
    drawn = blocks.select("_mix_place", "_mix_block", F.inline(listed))
    slot = Window.partitionBy("_mix_place").orderBy("epoch", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("_mix_block")), "_mix_block")
    drawn = cut_lineage(drawn.withColumn("slot", F.row_number().over(slot).cast("bigint") - 1))

    quotas = drawn.groupBy(F.col("_mix_place").alias("place")).agg(F.count("*").alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, math.ceil(total / blocks_per_shard))
    leaves = split_tree(quotas, total, shards, seed)
    upto = F.sum("count").over(Window.partitionBy("place").orderBy("shard"))
    leaves = leaves.withColumn("upto", upto).filter("count > 0")
    placed = leaves.select(F.col("place").alias("_mix_place"), "shard", F.explode(F.sequence(F.col("upto") - F.col("count"), F.col("upto") - 1)).alias("slot"))
    drawn = drawn.join(placed, ["_mix_place", "slot"])
    return cut_lineage(drawn.groupBy("_mix_place", "_mix_block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard", "quota"))).alias("_mix_draws")))


def in_blocks(rows: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    t = targets.select(F.col("_mix_source").alias("_mix_s"), F.col("place").alias("_mix_place"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"))
    n = F.greatest(F.lit(1), F.ceil(F.col("_mix_total") / block_words)).cast("bigint")
    return rows.join(t, F.col("_mix_source").eqNullSafe(F.col("_mix_s")), "left").withColumn("_mix_block", F.pmod("_mix_hash", n)).drop("_mix_s")


def planned(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", weights=WEIGHTS, repeats: int = MAX_REPEATS,
            block_words: int = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 7) -> DataFrame:
    """``docs`` with ``_mix_size``, ``_mix_total``, ``_mix_target`` and ``_mix_takes``.

    ``_mix_takes`` lists ``(epoch, shard, words)`` of every time the mix takes
    the row; documents that it does not take keep their row with an empty list.
    NULL texts have no words and are never taken. Equal rows fall into one
    block and may stand for each other. A NULL source is a source of its own.
    An empty table gives an empty table. Other columns stay; names that begin
    with ``_mix_`` are reserved.
    """
    rows = measured(docs, source, text, key, seed)
    sizes = cut_lineage(rows.select("_mix_source", "_mix_size", "_mix_hash"))
    targets = cut_lineage(source_targets(sizes, weights, repeats))
    draws = block_draws(sizes, targets, block_words, blocks_per_shard, seed)
    # On the border block of a source (one block each) documents are taken in hash order until the words are reached.
    border = draws.filter(F.exists("_mix_draws", lambda x: x["quota"].isNotNull())).select("_mix_place", "_mix_block")
    upto = Window.partitionBy("_mix_place", "_mix_block").orderBy("_mix_hash").rangeBetween(Window.unboundedPreceding, -1)
    edge = in_blocks(sizes, targets, block_words).join(border, ["_mix_place", "_mix_block"]).groupBy("_mix_place", "_mix_block", "_mix_hash").agg(
        F.sum("_mix_size").alias("_mix_sum"), F.count("*").alias("_mix_copies"))
    edge = edge.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(upto), F.lit(0)))
    edge = edge.select("_mix_place", "_mix_block", "_mix_hash", "_mix_before", "_mix_copies")
    rows = in_blocks(rows, targets, block_words).join(draws, ["_mix_place", "_mix_block"], "left").join(edge, ["_mix_place", "_mix_block", "_mix_hash"], "left")
    size, copies = F.col("_mix_size"), F.coalesce("_mix_copies", F.lit(1))
    # Equal rows share what is left evenly, rounded down.
    share = lambda quota: F.greatest(F.lit(0), F.least(size, F.floor((quota - F.col("_mix_before")) / copies))).cast("bigint")
    takes = F.transform(F.coalesce("_mix_draws", F.array().cast("array<struct<epoch:bigint,shard:bigint,quota:bigint>>")), lambda x: F.struct(
        x["epoch"].alias("epoch"), x["shard"].alias("shard"), F.when(x["quota"].isNull(), size).otherwise(share(x["quota"])).alias("words")))
    return rows.withColumn("_mix_takes", F.filter(takes, lambda x: x["words"] > 0)).drop("_mix_before", "_mix_copies", "_mix_draws")


def mixed(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", n_chars: str | None = "n_chars", seed: int = 7, **how) -> DataFrame:
    """The mix itself: one row of ``docs`` per take, shard by shard in shuffled order.

    A document cut at the border keeps its first words, joined by blanks, and
    its ``n_chars`` (when there is such a column) is counted anew.
    """
    cols = docs.columns
    rows = planned(docs, source, text, key, seed=seed, **how).withColumn("_mix_take", F.explode("_mix_takes"))
    cut = F.col("_mix_take.words") < F.col("_mix_size")
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1, F.col("_mix_take.words").cast("int")), " ")
    rows = rows.withColumn(text, F.when(cut, words).otherwise(F.col(text)))
    if n_chars and n_chars in cols:
        rows = rows.withColumn(n_chars, F.when(cut, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    shard = F.col("_mix_take.shard")
    return rows.repartition(shard).sortWithinPartitions(shard, F.xxhash64(F.lit(seed), "_mix_hash", "_mix_take.epoch")).select(*cols)
