"""Steps whose work grows with the rows, against plain loops over odd rows."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from huntspark.operators import gateway as G, joins as J
from huntspark.plans import trace as TR
from huntspark.session import shared_dir
from huntspark.streaming import state as K, streams as T

S = 1_000_000
MIN = 60 * S


def feed(spark, rows, schema, path=None):
    path = path or shared_dir(spark, "feed")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


# -- F1 -------------------------------------------------------------------------
def test_assembled_equals_loops():
    draw = random.Random(5)
    for _ in range(200):
        held, now = {}, 0
        kept = {n: [] for n in ("id", "ms", "due", "kind", "idx", "value")}
        for _ in range(4):
            new = [(draw.randint(1, 9), draw.randint(0, 60), draw.choice(["a", "b", "c", None]), draw.randint(1, 12), draw.choice("xyz")) for _ in range(draw.randint(0, 7))]
            frame = pd.DataFrame({n: [r[i] for r in new] for n, i in (("id", 0), ("ms", 1), ("kind", 2), ("idx", 3), ("value", 4))}).assign(due=-1)
            frames = [f for f in (pd.DataFrame(kept), frame) if len(f)]
            got = pd.DataFrame({"id": [], "status": []})
            if frames:
                got, kept = K.assembled(pd.concat(frames, ignore_index=True), now, 20, ("a", "b"))
            want = set()
            for k in {r[0] for r in new} | set(held):
                mine = [r[1:] for r in new if r[0] == k]
                lines, due = held.get(k, ([], None))
                lines = lines + mine
                due = max(min(x[0] for x in lines) + 20, now + 1) if mine else due
                whole = {"a", "b"} <= {x[1] for x in lines}
                if whole or (not mine and due < now):
                    pick = lambda n: " ".join(v for _, kind, _, v in sorted(lines, key=lambda x: (x[2], x[3])) if kind == n)
                    want.add((k, pick("a"), pick("b"), len(lines), "complete" if whole else "expired"))
                    held.pop(k, None)
                else:
                    held[k] = (lines, due)
            assert {tuple(r) for r in got.itertuples(index=False)} == want if want else not len(got)
            assert sorted(kept["id"]) == sorted(k for k, (lines, _) in held.items() for _ in lines)
            assert dict(zip(kept["id"], kept["due"])) == {k: due for k, (_, due) in held.items()}
            now += draw.randint(0, 25)


def test_ids_share_a_call_and_expire_alone(spark):
    """All ids in one bucket: one state row serves them, and each ends at its own time."""
    schema = "id bigint, s int, kind string, i int, v string"
    path = feed(spark, [(1, 0, "a", 1, "p"), (1, 1, "b", 1, "q"), (2, 5, "a", 2, "r"), (2, 5, "a", 1, "s"), (3, 50, "b", 1, None)], schema)
    mark, out = shared_dir(spark, "mark"), shared_dir(spark, "out")

    def run():
        st = T.follow_files(spark, path, schema, "parquet").drop("_path", "_modified").withColumn("t", F.timestamp_seconds(F.col("s") + 100))
        df = T.stream_assemble(st, "id", "t", "kind", "i", "v", ("a", "b"), max_age_sec=10, delay="0 seconds", buckets=1)
        df.writeStream.trigger(availableNow=True).option("checkpointLocation", mark).format("parquet").option("path", out).start().awaitTermination()
        return {tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect()}

    first = run()
    assert first == {(1, "p", "q", 2, "complete"), (2, "s r", "", 2, "expired")}
    assert spark.read.format("statestore").load(mark).count() == 1
    feed(spark, [(3, 55, "a", 7, "t"), (4, 300, "a", 1, "u")], schema, path)
    assert run() - first == {(3, "t", "None", 2, "complete")}
    feed(spark, [(5, 400, "b", 1, "w")], schema, path)
    assert (4, "u", "", 1, "expired") in run()


# -- F2 -------------------------------------------------------------------------
def odd_sides(spark, seed):
    draw = random.Random(seed)
    some = lambda *v: draw.choice(v)
    rows = lambda n: [(some(1, 2, 3, 4, 5, None), some(None, *range(0, 4000, 100)), some("h1", "H1 ", "h2", "", None), some("1", "2", None), some("10.0.0.1:80", "10.0.0.1", "10.0.0.2", None)) for _ in range(n)]
    schema = "evidence_id int, s int, host string, pid string, src_ip string"
    make = lambda n: spark.createDataFrame(rows(n), schema).withColumn("us", F.col("s").cast("bigint") * S).drop("s")
    return make(25), make(40)


SPEC = J.JoinSpec("j", "l", "r", [J.Key("host", "host"), J.Key("pid", "pid", optional=True)], [J.Key("src_ip", "src_ip")], 300, 500)


@pytest.mark.parametrize("anchor", [None, 2000 * S])
def test_counted_and_right_ends_equal_the_edges(spark, anchor):
    for seed in range(3):
        l, r = odd_sides(spark, seed)
        edges = J.matrix_join(l, r, SPEC, anchor).select("join_id", "left_ref", "right_ref", "confidence").collect()
        lefts, rights = {}, {}
        for e in edges:
            n, c = lefts.get(e.left_ref, (0, 0))
            lefts[e.left_ref] = (n + 1, max(c, e.confidence))
            rights[e.right_ref] = max(rights.get(e.right_ref, 0), e.confidence)
        assert edges and {x.left_ref: (x.n, x.confidence) for x in J.matrix_join(l, r, SPEC, anchor, counted=True).collect()} == lefts
        got = J.chain_rights({"l": l, "r": r}, {"j": SPEC}, ["j"], anchor).collect()
        assert {x.right_ref: x.confidence for x in got} == rights and len(got) == len(rights)


def join_rows(df):
    """The rows that the largest join of a plan puts out."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().get("numOutputRows").get().value())
        if p.nodeName().endswith("QueryStage"):
            todo.append(p.plan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return most


def test_counting_forms_no_edges(spark):
    l = spark.range(400).selectExpr("id AS evidence_id", "0L AS us", "concat('h', id % 2) AS host")
    spec = J.JoinSpec("j", keys=[J.Key("host", "host")])
    got = J.matrix_join(l, l, spec, counted=True)
    assert join_rows(got) == 400
    assert {(r.n, r.confidence) for r in got.collect()} == {(200, 0.85)}


# -- F3 -------------------------------------------------------------------------
def loops_refs(alerts, requests, signs, context, before, after):
    got = set()
    for i, us, ip, path in alerts:
        for c_us, c_ip, c_path, host, status in requests:
            if None in (us, path, c_us, host) or path != c_path or not 200 <= status <= 399 or (ip and c_ip and ip != c_ip) or abs(us - c_us) > context:
                continue
            got |= {(i, ref) for ref, s_us, s_host, ind in signs if ind and s_us is not None and s_host == host and c_us - before <= s_us <= c_us + after}
    return got


@pytest.mark.parametrize("minutes", [(10, 5, 30), (120, 1, 2), (0, 3, 0), (30, 0, 0)])
def test_success_refs_equal_loops(spark, minutes):
    draw = random.Random(sum(minutes))
    for _ in range(2):
        at = lambda: draw.choice([None] + [m * MIN for m in range(0, 400, 3)])
        alerts = [(draw.choice([1, 2, 3, 4, None]), at(), draw.choice(["x", "y", None]), draw.choice(["/a", "/b", None])) for _ in range(20)]
        requests = [(at(), draw.choice(["x", "y", None]), draw.choice(["/a", "/b", None]), draw.choice(["h", "g", None]), draw.choice([200, 302, 404])) for _ in range(60)]
        signs = [(draw.choice([*range(30), None]), at(), draw.choice(["h", "g", None]), draw.choice(["i", "k", None])) for _ in range(60)]
        got = G.success_refs(spark.createDataFrame(alerts, "alert_id int, us bigint, src_ip string, path_key string"),
                             spark.createDataFrame(requests, "us bigint, src_ip string, path_key string, target_ip string, status int"),
                             spark.createDataFrame(signs, "evidence_id int, us bigint, host string, indicator string"), *minutes).collect()
        want = loops_refs(alerts, requests, signs, *[m * MIN for m in minutes])
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_success_refs_meet_no_more_pairs_than_they_return(spark):
    alerts = spark.range(40).selectExpr("id AS alert_id", "id * 1000000L AS us", "'x' AS src_ip", "'/a' AS path_key")
    requests = spark.range(40).selectExpr("id * 1000000L AS us", "'x' AS src_ip", "'/a' AS path_key", "'h' AS target_ip", "200 AS status")
    signs = spark.range(40).selectExpr("id AS evidence_id", "id * 1000000L AS us", "'h' AS host", "'i' AS indicator")
    got = G.success_refs(alerts, requests, signs, 10, 5, 30)
    assert got.count() == 1600 and join_rows(got) <= 1600


# -- F4 -------------------------------------------------------------------------
def test_verdict_equals_that_of_all_edges(spark):
    """Also where a web row bears the id of an exec, so that left references decide what overlaps."""
    draw = random.Random(4)
    rows = lambda n, ids: spark.createDataFrame([(draw.choice(ids), draw.choice(["A", "B", "C", "D", None]), draw.choice([None, *range(0, 3000, 7)])) for _ in range(n)], "evidence_id int, host string, s int").withColumn("us", F.col("s").cast("bigint") * S).drop("s")
    for ids in (range(40), range(400)):
        tables = {"web_access_log": rows(30, ids), "host_exec": rows(40, ids), "host_connect": rows(20, ids), "host_file_op": rows(5, ids), "host_persistence": rows(5, ids)}
        tables = {k: spark.createDataFrame(t.collect(), t.schema) for k, t in tables.items()}
        logins = rows(1, range(1)).selectExpr("host AS src", "host AS dst", "us", "evidence_id", "'failed' AS result")
        spec = {"j": J.JoinSpec("j", "web_access_log", "host_exec", [J.Key("host", "host")], before_sec=50, after_sec=200)}
        t = TR.trace_intrusion(tables, spec, ["j"], {"j": "execution"}, logins, None, [], 500 * S, lookback_sec=30)
        mean = {}
        for r in t.stages.collect():
            mean.setdefault(r.host, []).append(r.confidence)
        got = {r.host: r.confidence for r in t.verdict.collect()}
        assert mean and {h: round(min(0.95, sum(map(lambda c: round(c, 6), v)) / len(v)), 2) for h, v in mean.items() if h is not None} == pytest.approx({h: got[h] for h in mean if h is not None}, abs=0.0101)


def test_verdict_forms_no_edges(spark):
    n = 300
    at = spark.range(n).selectExpr("id AS evidence_id", "'A' AS host", "id * 1000000L AS us")
    tables = {"web_access_log": at.withColumn("evidence_id", F.col("evidence_id") + n), "host_exec": at, "host_connect": at.limit(0), "host_file_op": at.limit(0), "host_persistence": at.limit(0)}
    logins = at.limit(0).selectExpr("host AS src", "host AS dst", "us", "evidence_id", "'failed' AS result")
    spec = {"j": J.JoinSpec("j", "web_access_log", "host_exec", [J.Key("host", "host")], before_sec=3600, after_sec=3600)}
    t = TR.trace_intrusion(tables, spec, ["j"], {"j": "execution"}, logins, None, [], 0)
    assert join_rows(t.verdict) <= 2 * n and [tuple(r) for r in t.verdict.collect()] == [("A", "initial_access_only", 0.85)]


# -- F5 -------------------------------------------------------------------------
@pytest.mark.parametrize("buckets", [1, 8])
def test_snapshot_buckets_equal_single_groups(spark, buckets):
    draw = random.Random(9)
    schema = "host string, part int, snap int, key string, v int, w string"
    path = shared_dir(spark, "in")
    runs = {b: (shared_dir(spark, "mark"), shared_dir(spark, "out")) for b in (None, buckets)}
    got = {}
    for batch in range(3):
        rows = [(draw.choice(["A", "B", None]), draw.choice([1, 2]), batch * 2 + draw.choice([0, 1, 2]), draw.choice(["p", "q", "r", "", None]), draw.choice([1, 2, None]), draw.choice(["s", None])) for _ in range(25)]
        feed(spark, rows, schema, path)
        for b, (mark, out) in runs.items():
            st = T.follow_files(spark, path, schema, "parquet").drop("_path", "_modified")
            df = T.stream_snapshots(st, ["host", "part"], "snap", ["key"], ["v", "w"], buckets=b)
            spark.conf.set(K.NO_DATA, "false")
            df.writeStream.trigger(availableNow=True).option("checkpointLocation", mark).format("parquet").option("path", out).start().awaitTermination()
            spark.conf.unset(K.NO_DATA)
            got[b] = sorted(str((r.host, r.part, r.snap, r.key, r.action, r.changed, sorted(r.old.items()))) for r in spark.read.schema(df.schema).parquet(out).collect())
        assert got[None] == got[buckets] and len(got[None]) > 10
    assert spark.read.format("statestore").option("stateVarName", "held").load(runs[buckets][0]).count() <= min(buckets, 6)


class _Held:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_idle_groups_leave_their_bucket():
    step, clock = K.SnapshotBuckets(1000), [0]
    step.names, step.held = ["host", "snap", "entity", "action", "changed", "old"], _Held()
    timer = type("Timer", (), {"getCurrentProcessingTimeInMs": lambda self: clock[0]})()
    send = lambda host, snap: [tuple(r) for r in step.handleInputRows((0,), [(0, host, host, snap, "p", "{}")], timer)]
    assert [r[3] for r in send("A", 1) + send("B", 1)] == ["observed", "observed"]
    clock[0] = 900
    assert send("A", 2) == [] and step.held.value[0] == ["B", "A"]
    clock[0] = 1500
    assert send("C", 1)[0][3] == "observed" and step.held.value[0] == ["A", "C"]
    assert send("B", 2)[0][3] == "observed"


# -- pipeline -------------------------------------------------------------------
def test_few_pieces_are_with_the_library_at_once(monkeypatch):
    import pyarrow as pa

    from huntspark.llm import queries, tokens

    path = queries.vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"w{i * j} x" for j in range(30)) for i in range(20)]
    whole = [x for x, *_ in [(ids.tolist(),) for _, ids, _ in tokens.encoded(pa.array(texts), path, 2)]]
    monkeypatch.setattr(tokens, "BATCH", 7)
    work, seen = tokens.Encoder(path), []
    asked = work.tokenizer

    class Spy:
        def encode_batch_fast(self, some, **kw):
            seen.append(len(some))
            return asked.encode_batch_fast(some, **kw)

    work.tokenizer = Spy()
    monkeypatch.setitem(tokens._ENCODERS, (path, False), work)
    assert [ids.tolist() for _, ids, _ in tokens.encoded(pa.array(texts), path, 2)] == whole
    assert max(seen) == 7 and len(seen) > 10 and (work.keys[1:] > work.keys[:-1]).all()
