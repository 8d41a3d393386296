"""Streams over landing folders, each next to its batch twin.

Late rows: stateless steps and state keyed by behaviour take them as they come;
windowed counts drop rows behind the watermark; ``order_guard`` marks them.
Unknown always means emit: no filter here drops a row it cannot judge.
"""
from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import snapshot_diff
from ..operators.rollups import assemble_fragments
from ..session import shared_dir
from ..sources import growing as G
from . import state


def follow_files(spark: SparkSession, path: str, schema, fmt: str = "json", glob: str | None = None, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """Growing folder as a stream, with the file's ``_path`` and ``_modified`` time.

    ``bytes_per_batch`` bounds what one batch, and so one key of a batch, can hold.
    """
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        r = r.option("maxBytesPerTrigger", bytes_per_batch)
    return r.load(path).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_modified"))


def backfill_then_follow(stream: DataFrame, since: Column, started: Column) -> DataFrame:
    """Files newer than ``since``; rows of files older than the start are marked ``backfill``."""
    return stream.where(F.col("_modified") >= since).withColumn("backfill", F.col("_modified") < started)


def drain(df: DataFrame, label: str, each_batch: Callable | None = None) -> DataFrame:
    """Run a stream over what is there and return the sink as a table (append).

    A query whose state expires by the clock would never find its end; it runs
    without batches that have no rows.
    """
    spark = df.sparkSession
    out, mark = shared_dir(spark, label), shared_dir(spark, f"{label}-checkpoint")
    w = df.writeStream.trigger(availableNow=True).option("checkpointLocation", mark)
    if each_batch is None:
        w = w.format("parquet").option("path", out).outputMode("append")
    else:
        w = w.foreachBatch(lambda batch, epoch: each_batch(batch, epoch, out))
    before = spark.conf.get(state.NO_DATA, "true")
    spark.conf.set(state.NO_DATA, "false" if state.expires(df) else before)
    try:
        query = w.start()
    finally:
        spark.conf.set(state.NO_DATA, before)
    query.awaitTermination()
    if each_batch is not None:
        return spark.read.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def stream_dedupe(stream: DataFrame, ts: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Drops repeats of a source id inside the horizon with bounded state.

    Rows without id are never repeats: they pass beside the stateful step, also
    when they are equal. A row with id that comes behind the watermark is
    dropped by Spark; where that may not be, use ``stream_dedupe_exact``.
    """
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    stream = stream.withWatermark(ts, within)
    return stream.where(named).dropDuplicatesWithinWatermark(keys).unionByName(stream.where(~named))


def stream_dedupe_exact(stream: DataFrame, key: str, us: str, id_col: str, within_sec: int = 3600, ttl_ms: int | None = None) -> DataFrame:
    """A repeat is a row at most ``within_sec`` after the last row of its key that was passed on.

    State: one time per key, which expires when the key was idle that long by
    the clock of the job. Output: key, time, id of the rows passed on. Late rows
    pass; a NULL key never repeats.
    """
    kt, it = (stream.schema[c].dataType.simpleString() for c in (key, id_col))
    rows = stream.select(key, F.col(us).cast("bigint").alias(us), id_col)
    step = state.Dedupe(within_sec * 1_000_000, ttl_ms or within_sec * 1000)
    known = state.with_state(rows.where(F.col(key).isNotNull()), [key], step, f"{key} {kt}, {us} bigint, {id_col} {it}")
    return known.unionByName(rows.where(F.col(key).isNull()))


def stream_assemble(stream: DataFrame, id_col: str, ts: str, kind: str, idx: str, value: str, required: tuple[str, str], max_age_sec: int = 60, delay: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """Records of one id, sent on when both required kinds are there or when they are too old.

    Emits id, the two value lists joined by blanks in index order, status
    (complete / expired). State goes with the emission. Lines without id belong
    to nothing: each is sent on by itself, as ``no_id``. A line without time is
    as old as the watermark. Batch twin: ``assemble_records``.

    Open lines are kept by ``buckets`` of ids, so a call and a state row serve
    many small ids; a bucket waits for the earliest end among its ids.
    """
    a, b = required
    it = stream.schema[id_col].dataType.simpleString()
    names = ["id", "ms", "due", "kind", "idx", "value"]

    def step(k, parts, kept: GroupState):
        now = kept.getCurrentWatermarkMs()
        frames = [pd.DataFrame(dict(zip(names, kept.get)))] if kept.exists else []
        frames += [pd.DataFrame({"id": p[id_col], "ms": p["ms"].fillna(now).astype("int64"), "due": -1, "kind": p["kind"], "idx": p["idx"], "value": p["value"]}) for p in parts if len(p)]
        if not frames:
            return
        sent, rest = state.assembled(pd.concat(frames, ignore_index=True), now, max_age_sec * 1000, (a, b))
        if len(rest["id"]):
            kept.update(tuple(rest[n] for n in names))
            kept.setTimeoutTimestamp(min(rest["due"]))
        elif kept.exists:
            kept.remove()
        if len(sent):
            yield sent.set_axis([id_col, a, b, "n_lines", "status"], axis=1)

    s = stream.withWatermark(ts, delay).select(id_col, ts, F.floor(F.unix_micros(ts) / 1000).alias("ms"), F.col(kind).alias("kind"), F.col(idx).cast("int").alias("idx"), F.coalesce(F.col(value).cast("string"), F.lit("None")).alias("value"))
    held = f"id array<{it}>, ms array<bigint>, due array<bigint>, kind array<string>, idx array<int>, value array<string>"
    whole = (s.where(F.col(id_col).isNotNull()).withColumn("__bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets))).groupBy("__bucket")
             .applyInPandasWithState(step, f"{id_col} {it}, {a} string, {b} string, n_lines bigint, status string", held, "append", GroupStateTimeout.EventTimeTimeout))
    only = lambda n: F.when(F.col("kind") == n, F.col("value")).otherwise("").alias(n)
    return whole.unionByName(s.where(F.col(id_col).isNull()).select(id_col, only(a), only(b), F.lit(1).cast("bigint").alias("n_lines"), F.lit("no_id").alias("status")))


def stream_learning(stream: DataFrame, key: str, us: str, id_col: str, occurrences: int = 5, window_sec: int = 3600, candidate_ms: int | None = None, admitted_ms: int = state.IDLE_MS) -> DataFrame:
    """Decision per row: a behaviour is suppressed from its ``occurrences``-th row in a rolling window on.

    State per fingerprint: the last few times, which expire after a window
    without rows, or the fact of admission, which expires after 30 idle days. A
    row behind the last one of its key is a clock fault: it is passed on and not
    learnt. Rows without fingerprint must bypass this (``learning_with_bypass``).
    """
    kt, it = (stream.schema[c].dataType.simpleString() for c in (key, id_col))
    step = state.Learning(occurrences, window_sec * 1_000_000, candidate_ms or window_sec * 1000, admitted_ms)
    return state.with_state(stream.select(key, us, id_col), [key], step, f"{key} {kt}, {us} bigint, {id_col} {it}, decision string, reason string")


def learning_with_bypass(stream: DataFrame, key: str, us: str, id_col: str, healthy: Column, **kw) -> DataFrame:
    """``stream_learning`` for healthy rows with a fingerprint; all others are emitted with the reason."""
    ok = F.col(key).isNotNull() & F.coalesce(healthy, F.lit(False))
    why = F.when(F.col(key).isNull(), "incomplete_fields").otherwise("source_unhealthy")
    rest = stream.where(~ok).select(key, us, id_col, F.lit("emit").alias("decision"), why.alias("reason"))
    return stream_learning(stream.where(ok), key, us, id_col, **kw).unionByName(rest)


def stream_rate(stream: DataFrame, key: str, us: str, id_col: str, limit: int, slot_sec: int = 5, slots: int = 61, hold_sec: int = 600, ttl_ms: int | None = None) -> DataFrame:
    """Rows of the key so far in the last ``slots`` slots against ``limit``, with the hold after an anomaly.

    State per key: the filled slots and the last anomaly; it expires when the
    key was idle for longer than both reach. Batch twin: ``sliding_rate``.
    """
    kt, it = (stream.schema[c].dataType.simpleString() for c in (key, id_col))
    step = state.Rate(limit, slot_sec * 1_000_000, slots, hold_sec * 1_000_000, ttl_ms or max(slot_sec * slots, hold_sec) * 1000)
    return state.with_state(stream.select(key, us, id_col), [key], step, f"{key} {kt}, {us} bigint, {id_col} {it}, rate bigint, anomaly boolean, anomaly_start boolean, held boolean")


def stream_rate_windowed(stream: DataFrame, ts: str, keys: list[str], limit: int, width: str = "305 seconds", slide: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """The same with built-in sliding windows, without Python: windows over the limit, once closed."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("rate")).where(F.col("rate") > limit)
            .select(*keys, F.col("window.start").alias("window_start"), "rate"))


def stream_snapshots(stream: DataFrame, group: list[str], snapshot: str, keys: list[str], fields: list[str], ttl_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """What each snapshot of a group (host, collection) changed against the one before: created, modified, deleted.

    State: the entities of the group, keyed by entity and changed in place, so a
    batch touches the groups it holds and, of those, the entities that changed.
    A snapshot comes in one batch; the first of a group is a baseline
    (``observed``); one that is not newer than the last is left out. An empty
    snapshot is a row with NULL keys. ``ttl_ms`` ends the state of groups that
    send no more. Fields are compared as text; of rows with one key the greatest
    stays. For one series of all rows use ``snapshot_diffs``.

    Every entity that changes is a call to the state store. Where groups are many
    and small, ``buckets`` keeps them together: one state row per bucket of
    groups, read and written once in a batch; idle groups end in the same way.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    rows = stream.select(*group, F.col(snapshot).cast("bigint").alias(snapshot), F.when(known, F.to_json(F.struct(*keys))).alias("entity"),
                         F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"}).alias("fields"))
    out = [f"{c} {kinds[c]}" for c in group] + [f"{snapshot} bigint", "entity string", "action string", "changed array<string>", "old map<string,string>"]
    if buckets:
        name = F.to_json(F.array(*[F.col(c).cast("string") for c in group]))
        rows = rows.select(F.pmod(F.xxhash64(*group), F.lit(buckets)).alias("__bucket"), *group, name.alias("__group"), snapshot, "entity", "fields")
        found = state.with_state(rows, ["__bucket"], state.SnapshotBuckets(ttl_ms), ", ".join(out))
    else:
        found = state.with_state(rows, group, state.Snapshots(ttl_ms), ", ".join(out))
    own = F.from_json("entity", ", ".join(f"{k} {kinds[k]}" for k in keys))
    return found.withColumn("__k", own).select(*group, snapshot, *[F.col(f"__k.{k}").alias(k) for k in keys], "action", "changed", "old")


def snapshot_diffs(keys: list[str], fields: list[str], snapshot: str, group: list[str] | None = None) -> Callable:
    """Batch step for ``drain``: each snapshot id of a batch is compared with the one before it of its group.

    ``group`` names whose snapshot it is (host, collection); without it all
    snapshots are one series. All snapshots of a batch are compared in one join,
    each row standing as the predecessor of the next id. The last snapshot of
    every group is kept next to the output, under the batch number, so a
    repeated batch reads the same predecessor. The first snapshot of a group is
    a baseline. An empty snapshot is a row with NULL keys.
    """
    own = list(group or ["__all"])

    def step(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        kept = f"{out}.last"
        stored = spark.read.parquet(f"{kept}/{epoch - 1}") if epoch > 0 else None
        if batch.isEmpty():
            if stored is not None:
                stored.write.mode("overwrite").parquet(f"{kept}/{epoch}")
            return
        cols = [*own, snapshot, *keys, *fields]
        rows = (batch if group else batch.withColumn("__all", F.lit(0))).select(*cols)
        ids = rows.select(*own, snapshot).distinct()
        ends = ids.groupBy(*own).agg(F.min(snapshot).alias("__first"), F.max(snapshot).alias("__last"))
        # The distinct ids of one batch: as few rows as the batch has snapshots.
        after = ids.select(*own, snapshot, F.lead(snapshot).over(Window.partitionBy(*own).orderBy(snapshot)).alias("__next")).where("__next IS NOT NULL")
        previous = rows.join(after, [*own, snapshot]).withColumn(snapshot, F.col("__next")).select(*cols)
        if stored is not None:
            known = stored.select(*own).distinct().withColumn("__known", F.lit(True))
            previous = previous.unionByName(stored.join(ends, own).withColumn(snapshot, F.col("__first")).select(*cols))
            rest = stored.join(ends, own, "left_anti").select(*cols)
        else:
            known, rest = ends.select(*own).limit(0).withColumn("__known", F.lit(True)), None
        marked = rows.join(ends, own).join(known, own, "left")
        base = (F.col(snapshot) == F.col("__first")) & F.col("__known").isNull()
        shown = lambda df: df if group else df.drop("__all")
        found = snapshot_diff(previous, marked.where(~base).select(*cols), [*own, snapshot, *keys], fields)
        found = found.unionByName(snapshot_diff(previous, marked.where(base).select(*cols), [*own, snapshot, *keys], fields, full=True))
        shown(found).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        last = marked.where(F.col(snapshot) == F.col("__last")).select(*cols)
        (last.unionByName(rest) if rest is not None else last).write.mode("overwrite").parquet(f"{kept}/{epoch}")
    return step


def stream_summary(stream: DataFrame, ts: str, keys: list[str], suppressed: Column, interval: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Observed, suppressed and emitted per interval, sent on when the watermark closes it."""
    w = stream.withColumn("__s", suppressed).withWatermark(ts, delay).groupBy(F.window(ts, interval), *keys)
    return w.agg(F.count(F.lit(1)).alias("observed"), F.count_if("__s").alias("suppressed"), F.count_if(~F.col("__s")).alias("emitted")).select(*keys, F.unix_micros("window.start").alias("interval_us"), "observed", "suppressed", "emitted")


def order_guard(source: str, us: str, delay_sec: int) -> Callable:
    """Batch step for ``drain``: marks rows behind the latest time of earlier batches as ``late``.

    ``late`` rows, and all rows of a source in a batch that had one, carry
    ``degraded``: nothing of them may be suppressed. Only one time per source is
    carried over, written per batch.
    """
    def step(batch: DataFrame, epoch: int, out: str) -> None:
        spark = batch.sparkSession
        kept = f"{out}.seen"
        seen = spark.read.parquet(f"{kept}/{epoch - 1}") if epoch > 0 else spark.createDataFrame([], f"__src {batch.schema[source].dataType.simpleString()}, __max bigint")
        late = F.coalesce(F.col(us) < F.col("__max") - delay_sec * 1_000_000, F.lit(False))
        d = batch.join(seen, F.col(source).eqNullSafe(F.col("__src")), "left").withColumn("late", late).drop("__src", "__max")
        bad = d.where("late").select(F.col(source).alias("__src")).distinct().withColumn("__bad", F.lit(True))
        d = d.join(bad, F.col(source).eqNullSafe(F.col("__src")), "left").withColumn("degraded", F.coalesce("__bad", F.lit(False))).drop("__src", "__bad")
        d.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        now = batch.groupBy(F.col(source).alias("__src")).agg(F.max(us).alias("__max"))
        seen.unionByName(now).groupBy("__src").agg(F.max("__max").alias("__max")).write.mode("overwrite").parquet(f"{kept}/{epoch}")
    return step


def fragment_rounds(keys: list[str], number: str, total: str, text: str) -> Callable:
    """Batch step for ``drain``: one micro-batch is one collection round.

    Whole groups are assembled; what is still open at the end of the round is
    flushed with its reason, never held back.
    """
    def step(batch: DataFrame, epoch: int, out: str) -> None:
        d = assemble_fragments(batch, keys, number, total, text)
        reason = F.when(F.col("status") == "complete", "assembled").when(F.col("status") == "conflict", "risk_fragment_conflict").otherwise("risk_fragment_incomplete")
        d.withColumn("reason", reason).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
    return step
