"""Greedy burst waves (W01) without one task per hot key.

Semantics per (victim, source), rows ordered by (time, id): a wave starts at a
row when the rows at most ``window`` after it (bounds included) number at least
``threshold``; the wave takes all of them and the search goes on behind it,
otherwise it moves one row on. Rows without time, victim or source are left
out, and so are self-loops.

Whether a row starts a wave depends on every wave before it, which is a chain.
The chain is solved as a scan over time blocks: inside each block a table says
where a chain that arrives at position ``p`` leaves the block; the tables of 64
blocks are composed into one; a walk over the few composed tables fixes where
each block is entered; then all blocks list their own waves in parallel. A table
holds at most the candidates of one window, however many rows the key has.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import first_match
from ..session import cut_lineage
from .blocks import carried, numbered, running_total

BLOCK_WINDOWS = 16
FAN_IN = 64
SMALL_KEY = 20_000
BUCKET_ROWS = 100_000


def window_reach(rows: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """``rn`` and ``reach`` (the last row number inside the window) per row.

    ``rows`` holds the keys, ``us`` and a unique ``id``.
    """
    own = rows.select(*keys, "us", "id", F.col("us").alias("t"), F.lit(1).alias("c"))
    ends = rows.select(*keys, "us", "id", (F.col("us") + window_us).alias("t"), F.lit(2).alias("c"))
    run = running_total(own.unionByName(ends), keys, "t", [F.col("t"), F.col("c"), F.col("id")],
                        (F.col("c") == 1).cast("int"), "cum", max(window_us, 1) * BLOCK_WINDOWS)
    return run.groupBy(*keys, "us", "id").agg(
        F.max(F.when(F.col("c") == 1, F.col("cum"))).alias("rn"),
        F.max(F.when(F.col("c") == 2, F.col("cum"))).alias("reach"))


def _apply(table_upto: np.ndarray, table_exit: np.ndarray, p: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table_upto, p, side="left")
    hit = at < len(table_upto)
    return np.where(hit, table_exit[np.minimum(at, len(table_exit) - 1)], p)


def _squeeze(upto, exits):
    """Keep the last entry of every run of equal exits."""
    keep = np.append(exits[1:] != exits[:-1], True)
    return upto[keep], exits[keep]


def greedy_starts(cand: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Wave starts among candidates (keys, us, rn, reach), as the same columns.

    Keys with few candidates are walked directly, a group is then at most
    ``SMALL_KEY`` rows; only larger ones go through the block scan.
    """
    per_key = cand.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    large = per_key.where(F.col("__n") > SMALL_KEY).select(*keys)
    total = cand.count()
    if large.isEmpty():
        return _walk_keys(cand, keys, total)
    small = _walk_keys(cand.join(large, keys, "left_anti"), keys, total)
    return small.unionByName(_scan_blocks(cand.join(large, keys, "left_semi"), keys, window_us))


def _walk_keys(cand: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Walk whole keys, many per group: buckets of about ``BUCKET_ROWS`` rows, sorted by key and position."""
    buckets, columns = max(1, -(-total // BUCKET_ROWS)), cand.columns

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "rn"])
        key, free, picked = None, 1, []
        for i, (k, rn, reach) in enumerate(zip(zip(*[pdf[k] for k in keys]), pdf["rn"].tolist(), pdf["reach"].tolist())):
            if k != key:
                key, free = k, 1
            if rn >= free:
                picked.append(i)
                free = reach + 1
        return pdf.iloc[picked][columns]

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    return cand.groupBy(bucket).applyInPandas(walk, cand.schema)


def _scan_blocks(cand: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """The chain of a large key, solved block by block."""
    width = max(window_us, 1) * BLOCK_WINDOWS
    kt = ", ".join(f"{k} {cand.schema[k].dataType.simpleString()}" for k in keys)
    blocks = cand.withColumn("blk", F.floor(F.col("us") / width).cast("bigint"))
    blocks = blocks.withColumn("sup", F.floor(F.col("blk") / FAN_IN).cast("bigint"))

    def block_table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, land, us = pdf["rn"].to_numpy(), pdf["reach"].to_numpy() + 1, pdf["us"].to_numpy()
        nxt = np.searchsorted(rn, land)
        leave = land.copy()
        for i in range(len(rn) - 1, -1, -1):
            if nxt[i] < len(rn):
                leave[i] = leave[nxt[i]]
        # A chain from an earlier block arrives within one window of the border.
        last = int(np.searchsorted(us, int(pdf["blk"].iloc[0]) * width + window_us, side="right"))
        upto, exits = _squeeze(rn[: last + 1], leave[: last + 1])
        head = pdf.iloc[[0] * len(upto)]
        return pd.DataFrame({**{k: head[k].to_numpy() for k in keys}, "blk": head["blk"].to_numpy(),
                             "sup": head["sup"].to_numpy(), "upto": upto, "exit": exits})

    tables = cut_lineage(blocks.groupBy(*keys, "blk", "sup").applyInPandas(
        block_table, f"{kt}, blk bigint, sup bigint, upto bigint, exit bigint"))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("upto") for _, g in pdf.groupby("blk", sort=True)]
        entry = parts[0]["upto"].to_numpy()
        if len(parts) > 1:
            entry = np.append(entry, parts[1]["upto"].to_numpy()[0])
        p = entry
        for g in parts:
            p = _apply(g["upto"].to_numpy(), g["exit"].to_numpy(), p)
        upto, exits = _squeeze(entry, p)
        head = pdf.iloc[[0] * len(upto)]
        return pd.DataFrame({**{k: head[k].to_numpy() for k in keys}, "sup": head["sup"].to_numpy(),
                             "upto": upto, "exit": exits})

    composed = tables.groupBy(*keys, "sup").applyInPandas(compose, f"{kt}, sup bigint, upto bigint, exit bigint")

    def walk(level: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            p = np.array([int(pdf["entry"].iloc[0])])
            rows = []
            for b, g in pdf.groupby(level, sort=True):
                rows.append((b, int(p[0])))
                g = g.sort_values("upto")
                p = _apply(g["upto"].to_numpy(), g["exit"].to_numpy(), p)
            head = pdf.iloc[[0] * len(rows)]
            return pd.DataFrame({**{k: head[k].to_numpy() for k in keys}, level: [r[0] for r in rows],
                                 "entry": [r[1] for r in rows]})
        return run

    sup_entry = (composed.withColumn("entry", F.lit(1).cast("bigint")).groupBy(*keys)
                 .applyInPandas(walk("sup"), f"{kt}, sup bigint, entry bigint"))
    blk_entry = (tables.join(sup_entry, [*keys, "sup"]).groupBy(*keys, "sup")
                 .applyInPandas(walk("blk"), f"{kt}, blk bigint, entry bigint"))

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        rn, land = pdf["rn"].to_numpy(), pdf["reach"].to_numpy() + 1
        i, picked = int(np.searchsorted(rn, int(pdf["entry"].iloc[0]))), []
        while i < len(rn):
            picked.append(i)
            i = int(np.searchsorted(rn, land[i]))
        return pdf.iloc[picked][[*keys, "us", "rn", "reach"]]

    return blocks.join(blk_entry, [*keys, "blk"]).groupBy(*keys, "blk").applyInPandas(
        emit, f"{kt}, us bigint, rn bigint, reach bigint")


def burst_waves(events: DataFrame, victim: str = "host", source: str = "src_ip", us: str = "us", id_col: str = "id",
                user: str | None = "user", window_sec: int = 300, threshold: int = 10, max_refs: int = 20) -> DataFrame:
    """One row per wave: keys, ``wave_index``, ``fail_count``, users, bounds, first refs."""
    keys, window_us = ["victim_host", "src_ip"], int(window_sec * 1_000_000)
    rows = (events.select(F.col(victim).cast("string").alias("victim_host"), F.col(source).cast("string").alias("src_ip"),
                          F.col(us).alias("us"), F.col(id_col).alias("id"),
                          (F.col(user).cast("string") if user else F.lit(None).cast("string")).alias("user"))
            .where("us IS NOT NULL AND victim_host <> '' AND src_ip <> '' AND victim_host <> src_ip"))
    cand = cut_lineage(window_reach(rows.drop("user"), keys, window_us)
                       .where(F.col("reach") - F.col("rn") + 1 >= threshold).select(*keys, "us", "rn", "reach"))
    starts = cut_lineage(greedy_starts(cand, keys, window_us))
    width = max(window_us, 1) * BLOCK_WINDOWS
    waves = numbered(starts, keys, "us", [F.col("us")], "wave_index", width)
    # Every row of a hit key looks back to the last wave start at or before it.
    hit_keys = starts.select(*keys).distinct()
    rn = numbered(rows.join(hit_keys, keys, "left_semi"), keys, "us", [F.col("us"), F.col("id")], "rn", width)
    marked = rn.join(waves.select(*keys, "rn", F.struct(F.col("rn").alias("start"), F.col("reach"), "wave_index").alias("wave")),
                     [*keys, "rn"], "left")
    inside = (carried(marked, keys, "us", ["us", "id"], F.col("wave"), "w", width, include_self=True)
              .where(F.col("rn") <= F.col("w.reach")))
    return (inside.groupBy(*keys, F.col("w.wave_index").alias("wave_index"))
            .agg(F.count(F.lit(1)).alias("fail_count"),
                 F.sort_array(F.collect_set(F.when(F.col("user") != "", F.col("user")))).alias("users"),
                 F.min("us").alias("first_us"), F.max("us").alias("last_us"),
                 F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") < F.col("w.start") + max_refs,
                                                                F.struct("rn", "id")))), lambda x: x["id"]).alias("evidence_refs")))


def tier_for_count(n: Column, tiers=((10, "P0"), (5, "P2")), default: str = "P3") -> Column:
    """Highest tier whose minimum the count reaches."""
    return first_match(*[(n >= m, s) for m, s in sorted(tiers, reverse=True)], default=default)
