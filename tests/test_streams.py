"""Stream state over several batches."""
import time

import pytest
from pyspark.sql import functions as F

from huntspark.session import shared_dir
from huntspark.streaming import streams as T

S = 1_000_000


def feed(spark, batches, schema):
    path = shared_dir(spark, "feed")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)
    return T.follow_files(spark, path, spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1).drop("_path", "_modified")


def test_learning_keeps_state_between_batches(spark):
    st = feed(spark, [[("f", i * S, i) for i in range(3)], [("f", (3 + i) * S, 3 + i) for i in range(3)] + [("g", 0, 9)], [("f", 2 * S, 20)]], "fp string, us bigint, id bigint")
    got = {r.id: r.decision for r in T.drain(T.stream_learning(st, "fp", "us", "id", 5, 3600), "l").collect()}
    assert got == {0: "emit", 1: "emit", 2: "emit", 3: "emit", 4: "suppress", 5: "suppress", 9: "emit", 20: "suppress"}


def test_backwards_time_is_not_learnt(spark):
    st = feed(spark, [[("f", 100 * S, 1)], [("f", 50 * S, 2)]], "fp string, us bigint, id bigint")
    assert {r.id: r.reason for r in T.drain(T.stream_learning(st, "fp", "us", "id", 2, 3600), "l").collect()} == {1: "learning", 2: "clock_regression"}


def test_exact_dedupe_reopens_after_the_hour(spark):
    st = feed(spark, [[("f", 0, 1), ("f", 3600 * S, 2)], [("f", 3601 * S, 3)]], "k string, us bigint, id bigint")
    assert sorted(r.id for r in T.drain(T.stream_dedupe_exact(st, "k", "us", "id"), "d").collect()) == [1, 3]


def test_rate_hold_crosses_batches(spark):
    st = feed(spark, [[("f", i * S, i) for i in range(4)], [("f", 600 * S, 10), ("f", 604 * S, 11)]], "k string, us bigint, id bigint")
    got = {r.id: (r.rate, r.anomaly, r.held) for r in T.drain(T.stream_rate(st, "k", "us", "id", 3), "r").collect()}
    assert got[3] == (4, True, True) and got[10] == (1, False, True) and got[11] == (2, False, False)


def test_snapshots_over_batches(spark):
    st = feed(spark, [[(1, "a", 1), (2, "a", 1)], [(1, "b", 2), (3, "a", 2)]], "id bigint, v string, snap int")
    got = {(r.id, r.snap, r.action) for r in T.drain(st, "s", T.snapshot_diffs(["id"], ["v"], "snap")).collect()}
    assert got == {(1, 1, "observed"), (2, 1, "observed"), (1, 2, "modified"), (2, 2, "deleted"), (3, 2, "created")}


def test_order_guard_over_batches(spark):
    st = feed(spark, [[("s", 100 * S, 1)], [("s", 95 * S, 2), ("s", 10 * S, 3), ("t", 0, 4)]], "src string, us bigint, id bigint")
    got = {r.id: (r.late, r.degraded) for r in T.drain(st, "o", T.order_guard("src", "us", 10)).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, True), 4: (False, False)}
