"""Ordered operators (W02-W09). Total order everywhere: time, then id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import text_or_null
from .blocks import carried, numbered, running_total


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key list by ``order``; rows whose keys are all empty stay.

    NULL and blank keys are one and the same. Runs as ``min_by``, so repeats
    fold before the shuffle and a heavily repeated key is no hot partition.
    """
    parts = [F.coalesce(text_or_null(F.col(k)), F.lit("")) for k in keys]
    empty = F.concat(*parts) == ""
    row = F.struct(*[F.col(c) for c in df.columns])
    return (df.where(~empty).select(row.alias("r"), F.struct(*order).alias("o"), *[p.alias(f"k{i}") for i, p in enumerate(parts)])
            .groupBy(*[f"k{i}" for i in range(len(parts))]).agg(F.min_by("r", "o").alias("r")).select("r.*")
            .unionByName(df.where(empty)))


def duplicate_audit(df: DataFrame, keys: list[str], order: list, id_col: str) -> DataFrame:
    """(retained, duplicate) id pairs of the rows that ``dedupe_first`` drops."""
    parts = [F.coalesce(text_or_null(F.col(k)), F.lit("")).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    d = df.select(id_col, *parts, F.struct(*order).alias("__o")).where(F.concat(*names) != "")
    first = d.groupBy(*names).agg(F.min_by(id_col, "__o").alias("retained_id"))
    return (d.join(first, names).where(F.col(id_col) != F.col("retained_id"))
            .select("retained_id", F.col(id_col).alias("duplicate_id")))


def dedupe_lateral(stages: DataFrame, order: list) -> DataFrame:
    """Lateral stages once per pair and class, other classes per pair, user and class.

    Stages of another kind all stay.
    """
    by_pair = F.col("lateral_class").isin("likely_lateral", "confirmed_lateral")
    lateral = F.col("stage") == "lateral_movement"
    d = stages.where(lateral).withColumn("__u", F.when(by_pair, F.lit("")).otherwise(F.coalesce("user", F.lit(""))))
    row = F.struct(*stages.columns)
    return (d.groupBy("source_host", "host", "__u", "lateral_class").agg(F.min_by(row, F.struct(*order)).alias("r"))
            .select("r.*").unionByName(stages.where(~F.coalesce(lateral, F.lit(False)))))


def dedupe_timeline(entries: DataFrame, order: list) -> DataFrame:
    """Timeline rows once per time, stage, host and evidence list."""
    return dedupe_first(entries.withColumn("__refs", F.to_json("evidence_refs")), ["us", "stage", "host", "__refs"], order).drop("__refs")


def dedupe_execution(stages: DataFrame, order: list) -> DataFrame:
    """Execution stages once per stage, host, second and set of evidence."""
    d = stages.withColumns({"__sec": F.floor(F.col("us") / 1_000_000), "__refs": F.to_json(F.array_sort("evidence_refs"))})
    return dedupe_first(d, ["stage", "host", "__sec", "__refs"], order).drop("__sec", "__refs")


def dedupe_logins(logins: DataFrame, order: list) -> DataFrame:
    """Login rows once per host, source, time, user and native id (NULL counts as empty)."""
    return dedupe_first(logins, ["host", "src_ip", "us", "user", "native_id"], order)


def sliding_rate(df: DataFrame, keys: list[str], us: str, id_col: str, limit: Column, slot_sec: int = 5,
                 slots: int = 61, hold_sec: int = 600) -> DataFrame:
    """Rows of the key so far in the last ``slots`` slots, against ``limit``.

    Adds ``rate``, ``anomaly``, ``anomaly_start`` (no hold was running) and
    ``held`` (an anomaly at or before the row is at most ``hold_sec`` old).
    """
    slot_us = slot_sec * 1_000_000
    floor_us = (F.floor(F.col(us) / slot_us) - (slots - 1)) * slot_us
    own = df.select(*keys, F.col(id_col).alias("__id"), F.col(us).alias("__t"), F.lit(1).alias("__c"))
    lows = df.select(*keys, F.col(id_col).alias("__id"), floor_us.cast("bigint").alias("__t"), F.lit(0).alias("__c"))
    width = slot_us * slots * 16
    run = running_total(own.unionByName(lows), keys, "__t", [F.col("__t"), F.col("__c"), F.col("__id")], F.col("__c"), "__n", width)
    rate = run.groupBy(F.col("__id").alias(id_col)).agg(
        F.sum(F.when(F.col("__c") == 1, F.col("__n")).otherwise(-F.col("__n"))).alias("rate"))
    d = df.join(rate, id_col).withColumn("anomaly", F.col("rate") > limit)
    hold = F.lit(hold_sec * 1_000_000)
    d = carried(d, keys, us, [us, id_col], F.when(F.col("anomaly"), F.col(us)), "__prev", width)
    fresh = F.coalesce(F.col(us) > F.col("__prev") + hold, F.lit(True))
    return (d.withColumn("anomaly_start", F.col("anomaly") & fresh)
            .withColumn("held", F.col("anomaly") | ~fresh).drop("__prev"))


def rolling_admission(df: DataFrame, keys: list[str], us: str, id_col: str, occurrences: int = 5,
                      window_sec: int = 3600) -> DataFrame:
    """Adds ``admitted_us`` (NULL if never) and ``decision`` per row.

    A key is admitted for good at the first row that is the ``occurrences``-th
    within the rolling window (bounds included). That row and all later ones are
    ``suppress``, the rows before it ``emit``.
    """
    width = window_sec * 1_000_000 * 16
    rn = numbered(df, keys, us, [F.col(us), F.col(id_col)], "__rn", width)
    if occurrences <= 1:
        hits = rn.select(*keys, "__rn", F.col(us).alias("__us"))
    else:
        back = rn.select(*[F.col(k) for k in keys], (F.col("__rn") + occurrences - 1).alias("__rn"), F.col(us).alias("__first"))
        hits = (rn.select(*keys, "__rn", F.col(us).alias("__us")).join(back, [*keys, "__rn"])
                .where(F.col("__us") - F.col("__first") <= window_sec * 1_000_000))
    adm = hits.groupBy(*keys).agg(F.min(F.struct("__rn", "__us")).alias("__a"))
    return (rn.join(adm, keys, "left").withColumn("admitted_us", F.col("__a.__us"))
            .withColumn("decision", F.when(F.col("__rn") >= F.col("__a.__rn"), "suppress").otherwise("emit"))
            .drop("__rn", "__a"))


def narrow_window(df: DataFrame, activity: Column, us: str, start_us: int, end_us: int, pad_us: int) -> DataFrame:
    """Rows inside [first activity - pad, last activity + pad], clamped to the asked bounds.

    Without activity the asked window stays. The bounds are one row, read as scalars.
    """
    inside = F.col(us).between(start_us, end_us)
    act = df.where(inside & activity).agg(F.min(us).alias("__f"), F.max(us).alias("__l"))
    low = act.select(F.greatest(F.lit(start_us), F.coalesce(F.col("__f") - pad_us, F.lit(start_us)))).scalar()
    high = act.select(F.least(F.lit(end_us), F.coalesce(F.col("__l") + pad_us, F.lit(end_us)))).scalar()
    return df.where(inside).withColumns({"from_us": low, "to_us": high}).where(F.col(us).between(F.col("from_us"), F.col("to_us")))


def sequence_refs(df: DataFrame, kind: str, us: str, id_col: str, evidence_id: Column, pad: int = 4, block_sec: int = 60) -> DataFrame:
    """``ref``: the row's evidence id, else its kind and its number within the kind.

    There are few kinds, so each holds a large share of the rows: the blocks are
    short, and a kind is numbered by as many tasks as it has minutes.
    """
    d = numbered(df, [kind], us, [F.col(us), F.col(id_col)], "__rn", block_sec * 1_000_000)
    n = F.col("__rn").cast("string")
    label = F.concat_ws("-", F.col(kind), F.when(F.length(n) < pad, F.lpad(n, pad, "0")).otherwise(n))
    return d.withColumn("ref", F.coalesce(text_or_null(evidence_id), label)).drop("__rn")


def counter_delta(df: DataFrame, series: list[str], us: str, id_col: str, counter: Column, out: str = "delta", block_sec: int = 3600) -> DataFrame:
    """Growth of a cumulative counter; a drop is a reset and yields the value itself.

    The first row of a series has no predecessor: NULL.
    """
    d = carried(df.withColumn("__cur", counter), series, us, [us, id_col], F.col("__cur"), "__prev", block_sec * 1_000_000)
    return d.withColumn(out, F.when(F.col("__prev").isNull(), F.lit(None))
                        .when(F.col("__cur") >= F.col("__prev"), F.col("__cur") - F.col("__prev"))
                        .otherwise(F.col("__cur"))).drop("__cur", "__prev")


def best_entry(df: DataFrame, group: list[str], ranks: list[Column], us: str, id_col: str) -> DataFrame:
    """Row with the lowest (ranks…, time, id) per group; rows without time are out."""
    d = df.where(F.col(us).isNotNull())
    pick = F.min_by(F.struct(*df.columns), F.struct(*ranks, F.col(us), F.col(id_col))).alias("r")
    return (d.groupBy(*group).agg(pick) if group else d.agg(pick).where("r IS NOT NULL")).select("r.*")
