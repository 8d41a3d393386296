"""Block-wise ordered work against brute force, with a key that owns most rows."""
import random

import pytest
from pyspark.sql import functions as F

from huntspark.operators import blocks as B, bursts
from huntspark.operators.joins import nearest_asof, related_in_window


def rows(seed, n=300, span=4000, hot=0.7):
    r = random.Random(seed)
    return [(i, "hot" if r.random() < hot else r.choice("abc"), r.randrange(span), r.randrange(9)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return lambda data: spark.createDataFrame(data, "id bigint, k string, us bigint, v bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_running_total_and_numbers(table, seed):
    data = rows(seed)
    got = {r.id: (r.tot, r.rn) for r in B.numbered(B.running_total(table(data), ["k"], "us", [F.col("us"), F.col("id")], F.col("v"), "tot", 500), ["k"], "us", [F.col("us"), F.col("id")], "rn", 300).collect()}
    for i, k, us, _ in data:
        before = [d for d in data if d[1] == k and (d[2], d[0]) <= (us, i)]
        assert got[i] == (sum(d[3] for d in before), len(before))


@pytest.mark.parametrize("forward", [True, False])
def test_carried(table, forward):
    data = rows(3)
    got = {r.id: r.c for r in B.carried(table(data), ["k"], "us", ["us", "id"], F.when(F.col("v") > 6, F.col("id")), "c", 400, forward).collect()}
    for i, k, us, _ in data:
        side = [d for d in data if d[1] == k and d[3] > 6 and (((d[2], d[0]) < (us, i)) if forward else ((d[2], d[0]) > (us, i)))]
        want = (max if forward else min)(side, key=lambda d: (d[2], d[0]))[0] if side else None
        assert got[i] == want


@pytest.mark.parametrize("before,after", [(50, 50), (0, 200), (300, 10)])
def test_window_aggregates_and_existence(table, before, after):
    left, right = rows(4, 150), rows(5, 200)
    l, r = table(left), table(right)
    near = {i: [d for d in right if d[1] == k and us - before <= d[2] <= us + after] for i, k, us, _ in left}
    agg = B.with_window_agg(l, r.withColumn("best", F.struct("v", "id")), ["k"], "id", "us", "us", before, after, {"s": ("v", "sum"), "m": ("best", "max"), "lo": ("us", "min")})
    for row in agg.collect():
        n = near[row.id]
        assert row.s == sum(d[3] for d in n)
        assert (row.m.id if row.m else None) == (max((d[3], d[0]) for d in n)[1] if n else None)
        assert row.lo == (min(d[2] for d in n) if n else None)
    assert {r.id: r.e for r in B.exists_in_window(l, r, ["k"], "us", "us", before, after, "e").collect()} == {i: bool(n) for i, n in near.items()}
    assert {r.id: r.c for r in B.counted_in_window(l, r, ["k"], "id", "us", "us", before, after, "c", 100).collect()} == {i: len(n) for i, n in near.items()}
    r2 = r.select(F.col("id").alias("rid"), F.col("k").alias("rk"), F.col("us").alias("rus"))
    pairs = {(p.id, p.rid) for p in B.interval_pairs(l, r2, [("k", "rk")], "us", "rus", before, after).collect()}
    assert pairs == {(i, d[0]) for i, n in near.items() for d in n}


def test_rows_without_key_or_time_find_nothing(spark, table):
    l = table([(1, None, 5, 0), (2, "a", None, 0), (3, "a", 5, 0)])
    r = table([(9, "a", 6, 1), (8, None, 5, 1), (7, "a", None, 1)])
    got = {x.id: x.s for x in B.with_window_agg(l, r, ["k"], "id", "us", "us", 10, 10, {"s": ("v", "sum")}).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def greedy(data, window, threshold):
    """The definition, row by row."""
    out = []
    for k in sorted({d[1] for d in data}):
        g = sorted((d[2], d[0]) for d in data if d[1] == k)
        i, wave = 0, 0
        while i < len(g):
            j = i
            while j < len(g) and g[j][0] - g[i][0] <= window:
                j += 1
            if j - i >= threshold:
                wave += 1
                out.append((k, wave, j - i, g[i][0], g[j - 1][0], tuple(x[1] for x in g[i:j][:3])))
                i = j
            else:
                i += 1
    return out


@pytest.mark.parametrize("small_key", [20_000, 0])
@pytest.mark.parametrize("seed,span,threshold", [(1, 3000, 4), (2, 600, 5), (3, 30_000, 3), (4, 250_000, 2)])
def test_burst_waves(spark, table, monkeypatch, small_key, seed, span, threshold):
    """Direct walk and block scan give the greedy waves; the hot key is dense and has ties."""
    monkeypatch.setattr(bursts, "SMALL_KEY", small_key)
    monkeypatch.setattr(bursts, "BLOCK_WINDOWS", 2)
    monkeypatch.setattr(bursts, "FAN_IN", 3)
    data = rows(seed, 400, span)
    df = table([(i, k, us * 1_000_000, v) for i, k, us, v in data]).withColumn("src", F.lit("s"))
    got = bursts.burst_waves(df, "k", "src", user=None, window_sec=60, threshold=threshold, max_refs=3)
    want = [(k, w, n, a * 1_000_000, b * 1_000_000, refs) for k, w, n, a, b, refs in greedy(data, 60, threshold)]
    assert sorted((r.victim_host, r.wave_index, r.fail_count, r.first_us, r.last_us, tuple(r.evidence_refs)) for r in got.collect()) == sorted(want)


def test_burst_bounds(spark, table):
    """Ten failures within the window are one wave, nine are none; self-loops and blank sources never count."""
    s = 1_000_000
    ten = [(i, "v1", i * 30 * s, 0) for i in range(10)]
    df = table(ten + [(100 + i, "v2", i * 30 * s, 0) for i in range(9)]).withColumn("src", F.lit("a"))
    more = table([(200 + i, "v3", i * s, 0) for i in range(12)])
    df = df.unionByName(more.withColumn("src", F.lit("v3"))).unionByName(more.withColumn("k", F.lit("v4")).withColumn("src", F.lit("")))
    got = bursts.burst_waves(df, "k", "src", user=None).collect()
    assert [(r.victim_host, r.fail_count) for r in got] == [("v1", 10)]


def test_two_bursts_are_two_waves(table):
    s = 1_000_000
    df = table([(i, "v", i * s, 0) for i in range(10)] + [(50 + i, "v", (5000 + i) * s, 0) for i in range(11)]).withColumn("src", F.lit("a"))
    assert sorted((r.wave_index, r.fail_count) for r in bursts.burst_waves(df, "k", "src", user=None).collect()) == [(1, 10), (2, 11)]


def test_nearest_prefers_the_earlier_row(table):
    l, r = table([(1, "a", 100, 0), (2, "a", 900, 0), (3, "b", 5, 0)]), table([(10, "a", 90, 0), (11, "a", 110, 0), (12, "a", 700, 0)])
    got = {x.id: x.near_id for x in nearest_asof(l, r.select("k", "us", F.col("id").alias("rid")), ["k"], "us", "id", "rid", 150).collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_related_listener_tolerance(spark):
    df = lambda d: spark.createDataFrame(d, "id bigint, us bigint, hosts array<string>, lp string")
    l = df([(1, 0, ["a"], "x"), (2, 0, ["a"], None), (3, 0, ["z"], "x"), (4, None, ["a"], "x"), (5, 0, [], "x")])
    r = df([(9, 300_000_000, ["a", "b"], "y")])
    assert {x.id: x.f for x in related_in_window(l, r, "id", "hosts", "lp", "us", 300, "f").collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    r = df([(9, 300_000_001, ["a"], None)])
    assert not related_in_window(l, r, "id", "hosts", "lp", "us", 300, "f").where("f").count()
