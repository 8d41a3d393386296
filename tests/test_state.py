"""Keyed stream state: array steps against plain loops, expiry, snapshots in place."""
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntspark.session import shared_dir
from huntspark.streaming import state as K, streams as T

S = 1_000_000


def loops_passed(times, last, span):
    keep = []
    for t in times:
        fresh = last is None or t - last > span or t < last
        keep.append(fresh)
        last = t if fresh else last
    return keep, last


def loops_learnt(times, recent, occurrences, span):
    admitted, reasons = False, []
    for t in times:
        reason = "learning"
        if not admitted:
            if recent and t < recent[-1]:
                reason = "clock_regression"
            else:
                recent = [x for x in recent if t - x <= span] + [t]
                admitted = len(recent) >= occurrences
        reasons.append("baseline_match" if admitted else reason)
    return reasons, [] if admitted else recent


def loops_rates(times, filled, last, limit, slot, slots, hold):
    out = []
    for t in times:
        s = t // slot
        filled[s] = filled.get(s, 0) + 1
        filled = {e: n for e, n in filled.items() if e > s - slots}
        rate = sum(n for e, n in filled.items() if e <= s)
        hot, fresh = rate > limit, last is None or t > last + hold
        out.append((rate, hot, hot and fresh, hot or not fresh))
        last = t if hot else last
    return out, filled, last


def test_array_steps_equal_loops():
    draw = random.Random(2)
    for _ in range(600):
        span, occurrences = draw.randint(1, 30), draw.randint(1, 5)
        last, recent, filled, hot_last = None, [], {}, None
        for _ in range(3):  # state goes from batch to batch; later ones may begin earlier
            times = sorted(draw.randint(0, 120) for _ in range(draw.randint(1, 12)))
            arr = np.array(times, np.int64)
            keep, new = K.passed_on(arr, last, span)
            assert (keep.tolist(), new) == loops_passed(times, last, span)
            last = new
            late, at, kept = K.learnt(arr, recent, occurrences, span)
            reasons = ["clock_regression"] * late + ["learning"] * (at - late) + ["baseline_match"] * (len(times) - at)
            want, after = loops_learnt(times, list(recent), occurrences, span)
            assert reasons == want
            recent = [] if at < len(times) else kept if late < len(times) else recent
            # Only what may still count is remembered.
            assert recent == [t for t in after if after[-1] - t <= span][-max(occurrences - 1, 0):] if occurrences > 1 else True
            slot, slots, limit, hold = draw.randint(1, 9), draw.randint(1, 6), draw.randint(0, 4), draw.randint(1, 30)
        slot, slots, limit, hold = draw.randint(1, 9), draw.randint(1, 6), draw.randint(0, 4), draw.randint(1, 30)
        for _ in range(3):
            times = sorted(draw.randint(0, 120) for _ in range(draw.randint(1, 12)))
            arr = np.array(times, np.int64)
            rate = K.rates(arr, np.array(sorted(filled), np.int64), np.array([filled[k] for k in sorted(filled)], np.int64), slot, slots)
            hot = rate > limit
            free, new = K.holds(arr, hot, hot_last, hold)
            want, filled, hot_last = loops_rates(times, dict(filled), hot_last, limit, slot, slots, hold)
            assert list(zip(rate.tolist(), hot.tolist(), (hot & free).tolist(), (hot | ~free).tolist())) == want and new == hot_last


def run(spark, df, mark, out):
    spark.conf.set(K.NO_DATA, "false")
    try:
        df.writeStream.trigger(availableNow=True).option("checkpointLocation", mark).format("parquet").option("path", out).start().awaitTermination()
    finally:
        spark.conf.unset(K.NO_DATA)
    return spark.read.schema(df.schema).parquet(out).collect()


def states(spark, mark, name):
    return {r.key[0] for r in spark.read.format("statestore").option("stateVarName", name).load(mark).collect()}


@pytest.mark.parametrize("kind,name", [("dedupe", "last"), ("learning", "recent"), ("rate", "filled")])
def test_state_expires_and_late_rows_pass(spark, kind, name):
    path, mark, out = (shared_dir(spark, x) for x in ("in", "mark", "out"))
    add = lambda rows: spark.createDataFrame(rows, "k string, us bigint, id bigint").coalesce(1).write.mode("append").parquet(path)

    def stream():
        st = T.follow_files(spark, path, "k string, us bigint, id bigint", "parquet").drop("_path", "_modified")
        return {"dedupe": lambda: T.stream_dedupe_exact(st, "k", "us", "id", 3600, ttl_ms=1500), "learning": lambda: T.stream_learning(st, "k", "us", "id", 3, 3600, candidate_ms=1500),
                "rate": lambda: T.stream_rate(st, "k", "us", "id", 5, ttl_ms=1500)}[kind]()

    add([("a", 10 * S, 1)])
    run(spark, stream(), mark, out)
    assert states(spark, mark, name) == {"a"}
    time.sleep(2)
    add([("b", 11 * S, 2), ("a", 5 * S, 3)])
    got = run(spark, stream(), mark, out)
    assert sorted(r.id for r in got) == [1, 2, 3]
    if kind == "learning":
        assert {r.reason for r in got} == {"learning"}  # the expired time of a is no clock to fall behind
    time.sleep(2)
    add([("c", 12 * S, 4)])
    run(spark, stream(), mark, out)
    assert states(spark, mark, name) == {"c"}


def test_snapshots_in_place(spark):
    path, mark, out = (shared_dir(spark, x) for x in ("in", "mark", "out"))
    schema = "host string, part string, snap int, key string, v int, w string"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: T.stream_snapshots(T.follow_files(spark, path, schema, "parquet").drop("_path", "_modified"), ["host", "part"], "snap", ["key"], ["v", "w"])
    add([("A", "x", 1, "p", 1, None), ("A", "x", 1, "q", 1, "s"), ("A", "x", 1, "q", 2, None), ("A", "x", 1, "", 5, None), ("B", "x", 1, "p", 1, None)])
    run(spark, stream(), mark, out)
    before = spark.read.format("statestore").option("stateVarName", "entities").load(mark)
    assert {(r.key.host, r.user_map_key.entity, r.user_map_value.seen) for r in before.collect()} == {("A", '{"key":"p"}', 1), ("A", '{"key":"q"}', 1), ("B", '{"key":"p"}', 1)}
    add([("A", "x", 2, "p", 1, None), ("A", "x", 2, "q", 2, "t"), ("A", "x", 2, "r", 1, None), ("A", "x", 3, None, None, None), ("A", "y", 9, "p", 1, None), ("A", "x", 1, "old", 1, None)])
    got = {(r.host, r.part, r.snap, r.key, r.action, tuple(r.changed), tuple(sorted(r.old.items()))) for r in run(spark, stream(), mark, out)}
    assert got == {("A", "x", 1, "p", "observed", (), ()), ("A", "x", 1, "q", "observed", (), ()), ("B", "x", 1, "p", "observed", (), ()), ("A", "x", 2, "q", "modified", ("w",), (("w", None),)), ("A", "x", 2, "r", "created", (), ()),
                   ("A", "x", 3, "p", "deleted", (), (("v", "1"), ("w", None))), ("A", "x", 3, "q", "deleted", (), (("v", "2"), ("w", "t"))), ("A", "x", 3, "r", "deleted", (), (("v", "1"), ("w", None))), ("A", "y", 9, "p", "observed", (), ())}
    after = spark.read.format("statestore").option("stateVarName", "entities").load(mark)
    assert {(r.key.host, r.key.part, r.user_map_key.entity, r.user_map_value.seen) for r in after.collect()} == {("A", "y", '{"key":"p"}', 9), ("B", "x", '{"key":"p"}', 1)}


def test_lines_without_id_stand_alone(spark):
    path = shared_dir(spark, "in")
    schema = "id string, t timestamp, kind string, i int, v string"
    spark.createDataFrame([(None, "a", 1, "x"), (None, "b", 2, "y"), ("k", "a", 1, "x"), ("k", "b", 2, "y")], "id string, kind string, i int, v string").select("id", F.timestamp_seconds(F.lit(100)).alias("t"), "kind", "i", "v").write.parquet(path)
    st = T.follow_files(spark, path, schema, "parquet").drop("_path", "_modified")
    got = sorted((str(r.id), r.a, r.b, r.n_lines, r.status) for r in T.drain(T.stream_assemble(st, "id", "t", "kind", "i", "v", ("a", "b")), "x").collect())
    assert got == [("None", "", "y", 1, "no_id"), ("None", "x", "", 1, "no_id"), ("k", "x", "y", 2, "complete")]
