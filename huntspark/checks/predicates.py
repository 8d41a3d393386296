"""Filters and condition compilers on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..functions.net import cidr_bounds, ipv4_to_long, normalize_ip
from ..operators import predicates as Q
from .base import EV, evidence, table
from .normalize import GOOD_IP_SQL, RAW_IP

A, B = "2024-01-05T00:00:00Z", "2024-01-20T12:00:00Z"


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.expr("CASE WHEN event_id % 7 > 0 THEN cast(ts AS timestamp) END").alias("t"))


def f01(spark, d):
    return Q.strict_window(_timed(spark, d), "t", A, B).select("event_id", "event_type")


F01_SQL = "SELECT event_id, event_type FROM events WHERE event_id % 7 > 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'"


def f02(spark, d):
    return Q.lenient_window(_timed(spark, d), "t", A, B).select("event_id", "event_type")


F02_SQL = "SELECT event_id, event_type FROM events WHERE event_id % 7 = 0 OR (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00')"


def f02_report(spark, d):
    return Q.window_report(_timed(spark, d), "t", ["event_type"], A, B)


F02R_SQL = """WITH t AS (SELECT event_type, event_id % 7 = 0 AS nt, ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00' AS i FROM events)
SELECT event_type, count(*) AS original, count(*) FILTER (nt OR i) AS kept, count(*) FILTER (NOT nt AND NOT i) AS dropped, count(*) FILTER (nt) AS untimestamped FROM t GROUP BY 1"""


def f03(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("CASE k % 3 WHEN 0 THEN 'localhost' ELSE host END").alias("host"), F.expr("CASE k % 2 WHEN 0 THEN concat('10.0.0.', user_id % 250) END").alias("host_ip"))
    return Q.host_scope(e, ["host-3", "10.0.0.5", "localhost", "host-8"])


F03_SQL = f"""WITH {EV}, e AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'localhost' ELSE host END AS host, CASE k % 2 WHEN 0 THEN '10.0.0.' || (user_id % 250) END AS host_ip FROM ev)
SELECT * FROM e WHERE host IN ('host-3', 'host-8') OR host_ip = '10.0.0.5' OR (host = 'localhost' AND host_ip IS NULL)"""


def f04(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("CASE WHEN k % 5 = 0 THEN 'n/a' WHEN k % 5 = 1 THEN NULL ELSE cast(k AS string) END").alias("listener_port"))
    return Q.port_scope(e, "listener_port", [22, 43, 84, "x"])


F04_SQL = f"WITH {EV} SELECT event_id, CASE WHEN k % 5 = 0 THEN 'n/a' WHEN k % 5 > 1 THEN k::VARCHAR END AS listener_port FROM ev WHERE k % 5 < 2 OR k IN (22, 43, 84)"

SEV = "concat('P', least(cast(substr(o_orderpriority, 1, 1) AS int) - 1, 4))"
SEV_SQL = "'P' || least(CAST(substr(o_orderpriority, 1, 1) AS INT) - 1, 4)"


def f05(spark, d):
    return Q.severity_floor(table(spark, d, "orders").select("o_orderkey", F.expr(SEV).alias("severity")), "severity", "P1")


F05_SQL = f"SELECT o_orderkey, {SEV_SQL} AS severity FROM orders WHERE {SEV_SQL} IN ('P0', 'P1')"


def items(spark, d):
    """Orders as risk items."""
    return table(spark, d, "orders").select(
        "o_orderkey", F.expr(SEV).alias("severity"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'exec' WHEN 'O' THEN 'connect' ELSE 'ssh' END").alias("risk_module"),
        F.concat(F.lit("host-"), (F.col("o_custkey") % 50).cast("string")).alias("host"), (F.col("o_orderkey") % 100).cast("int").alias("listener_port"),
        F.expr("concat('run ', o_orderpriority, ' --key ', o_orderkey % 10)").alias("command"),
        F.expr("filter(array(IF(o_orderkey % 2 = 0, 'reverse_shell', NULL), IF(o_orderkey % 3 = 0, 'noise_command', NULL), IF(o_orderkey % 5 = 0, 'persistence_modify', NULL)), x -> x IS NOT NULL)").alias("matched_rules"),
        F.concat(F.lit("10."), (F.col("o_orderkey") % 20).cast("string"), F.lit(".0.1")).alias("dst_ip"), F.lit("suspicious").alias("verdict"), F.lit("observe").alias("recommended_action"),
        F.lit(0.6).alias("confidence"), F.expr("IF(o_orderkey % 4 = 0, NULL, array('Web', 'x'))").alias("tags"))


ITEMS = f"""it AS (SELECT o_orderkey, o_orderkey AS n, o_orderpriority, {SEV_SQL} AS severity, CASE o_orderstatus WHEN 'F' THEN 'exec' WHEN 'O' THEN 'connect' ELSE 'ssh' END AS risk_module,
  'host-' || (o_custkey % 50) AS host, o_orderkey % 100 AS listener_port, 'run ' || o_orderpriority || ' --key ' || (o_orderkey % 10) AS command, '10.' || (o_orderkey % 20) || '.0.1' AS dst_ip FROM orders)"""

CONDITION = {"any": [
    {"all": [{"risk_module": ["exec", "ssh"]}, {"command_regex": r"urgent.*--key [0-4]$"}, {"not": {"matched_rules_any": ["noise_command"]}}]},
    {"all": [{"severity_in": ["P2"]}, {"listener_port_in": [7, 8, 22, 80]}]},
    {"all": [{"predicate": "hot_host"}, {"tags_contains": ["WEB"]}, {"matched_rules_all": ["reverse_shell", "persistence_modify"]}]},
    {"all": [{"type": "guardrail_matched", "matched_rules_any": ["persistence_modify", "zz"], "skip_when": {"matched_rule": "persistence_modify", "unless_predicates_any": ["hot_host"]}},
             {"field_equals": {"field": "risk_module", "value": "connect"}}, {"command_contains": "LOW"}]},
    {"all": [{"dst_ip_in": ["10.3.0.1"]}, {"field_regex": {"field": "host", "pattern": "^HOST-1"}}]}, {"nonsense": 1}]}


def f06(spark, d):
    it = items(spark, d)
    preds = {"hot_host": {"field_regex": {"field": "host", "pattern": "-[0-9]$"}}}
    return it.where(Q.compile_condition(it, CONDITION, predicates=preds)).select("o_orderkey", "risk_module")


F06_SQL = f"""WITH {ITEMS} SELECT o_orderkey, risk_module FROM it WHERE
 (risk_module IN ('exec', 'ssh') AND regexp_matches(command, '(?i)urgent.*--key [0-4]$') AND n % 3 <> 0) OR (severity = 'P2' AND listener_port IN (7, 8, 22, 80))
 OR (regexp_matches(host, '-[0-9]$') AND n % 4 <> 0 AND n % 2 = 0 AND n % 5 = 0)
 OR (n % 5 = 0 AND NOT regexp_matches(host, '-[0-9]$') AND risk_module = 'connect' AND contains(lower(command), 'low'))
 OR (dst_ip = '10.3.0.1' AND regexp_matches(host, '(?i)^host-1'))"""

THREE = {"any": [
    {"all": [{"field": "price", "op": "between", "value": [1000, 100000]}, {"not": {"field": "status", "op": "eq", "value": "f", "fold": True}}]},
    {"all": [{"field": "prio", "op": "prefix", "value": "1"}, {"field": "price", "op": "exists"}, {"field": "parts", "op": "array_any", "each": {"op": "eq", "value": "HIGH"}}]},
    {"all": [{"field": "ip", "op": "cidr", "value": "10.4.0.0/14"}, {"field": "parts", "op": "array_none", "each": {"op": "contains", "value": "low", "fold": True}}, {"field": "status", "op": "not_in", "value": ["P", "O"]}]},
    {"not": {"any": [{"field": "status", "op": "neq", "value": "O"}, {"field": "price", "op": "gte", "value": 200000}]}},
    {"field": "status", "op": "gt", "value": 3}, {"field": "absent", "op": "eq", "value": 1}]}


def f07(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("IF(o_orderkey % 7 = 0, NULL, o_orderstatus)").alias("status"), F.expr("IF(o_orderkey % 5 = 0, NULL, o_totalprice)").alias("price"),
                                         F.col("o_orderpriority").alias("prio"), F.split("o_orderpriority", "-").alias("parts"), F.expr("IF(o_orderkey % 3 = 0, 'bad', concat('10.', o_orderkey % 12, '.0.1'))").alias("ip"))
    return o.where(Q.ThreeValued(o).match(THREE)).select("o_orderkey", "status")


F07_SQL = """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price, o_orderpriority AS prio,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 12 END AS net FROM orders)
SELECT o_orderkey, status FROM o WHERE (price BETWEEN 1000 AND 100000 AND NOT lower(status) = 'f') OR (prio LIKE '1%' AND price IS NOT NULL AND split_part(prio, '-', 2) = 'HIGH')
 OR (net BETWEEN 4 AND 7 AND NOT contains(lower(prio), 'low') AND status NOT IN ('P', 'O')) OR NOT (status <> 'O' OR price >= 200000)"""


def f08(spark, d):
    e = evidence(spark, d).withColumn("ip", normalize_ip(F.expr(RAW_IP)))
    return e.select("event_id", Q.cidr_match(F.col("ip"), ["10.0.0.0/17", "198.51.100.0/26"]).alias("hit"))


F08_SQL = f"""WITH {EV}, g AS (SELECT event_id, k, user_id, {GOOD_IP_SQL} AS ip FROM ev)
SELECT event_id, coalesce((ip LIKE '10.0.%' AND user_id % 256 < 128) OR (ip LIKE '198.51.100.%' AND k < 64), false) AS hit FROM g"""


def f08_lookup(spark, d):
    """Nations as networks 10.<nation key * 8>.0.0/13, customers as addresses."""
    nets = table(spark, d, "nation").select("n_name", (F.lit(cidr_bounds("10.0.0.0/13")[0]) + F.col("n_nationkey").cast("bigint") * 8 * 65536).alias("lo")).withColumn("hi", F.col("lo") + 8 * 65536 - 1)
    c = table(spark, d, "customer").withColumn("num", ipv4_to_long(F.concat(F.lit("10."), (F.col("c_custkey") % 256).cast("string"), F.lit(".7.7"))))
    return Q.cidr_lookup(c.select("c_custkey", "num"), "num", nets).select("c_custkey", "n_name")


F08L_SQL = "SELECT c_custkey, n_name FROM customer JOIN nation ON (c_custkey % 256) // 8 = n_nationkey"
PATTERNS = ["the ", "../", "union", "que", "ing", "%2e"]


def f09(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.array_join(Q.pattern_hits(F.col("text"), PATTERNS), ",").alias("hits"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.array_join(Q.url_pattern_hits(F.concat("url", F.lit("?f=%252e%252e%255cx")), PATTERNS + [".com"]), ",").alias("hits"))
    return docs.unionByName(pages)


def _hits_sql(text, patterns):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({text}, '{p.lower()}') THEN '{p}' END" for p in patterns) + "], lambda x: x IS NOT NULL), ',')"


F09_SQL = f"""SELECT 'd' || doc_id AS id, {_hits_sql('lower(text)', PATTERNS)} AS hits FROM documents UNION ALL
SELECT 'p' || page_id, {_hits_sql("(lower(replace(url, '+', ' ')) || '?f=../x')", PATTERNS + ['.com'])} FROM pages"""
FP = {"whitelist_url_fragments": ["/health", "src1"], "patterns": [{"id": "both_words", "contains": ["the", "and"]}, {"id": "digits", "regex": "[0-9]{3}", "flags": "i"}],
      "exploit_tokens_text": [" or ", "union", "<script"], "exploit_tokens_regex": [" or ", "union", ";", "|"]}


def f10(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/x/"), F.col("source")).alias("url"), F.col("text").alias("payload"))
    return t.select("doc_id", Q.false_positive_reason(t, FP).alias("reason"))


F10_SQL = r"""WITH t AS (SELECT doc_id, source, trim(text) AS p, lower(text) AS l FROM documents) SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'whitelist_url:src1'
 WHEN contains(p, 'the') AND contains(p, 'and') AND NOT (contains(l, ' or ') OR contains(l, 'union') OR contains(l, '<script')) THEN 'both_words'
 WHEN regexp_matches(p, '[0-9]{3}') AND NOT (contains(l, ' or ') OR contains(l, 'union') OR contains(l, ';') OR contains(l, '|')) THEN 'digits' END AS reason FROM t"""


def f11(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    other = F.expr("CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN concat('GET ', regexp_replace(url, '#.*$', ''), ' HTTP/1.1') WHEN 2 THEN concat(regexp_replace(url, '[?#].*$', ''), 'zz') ELSE '' END")
    return p.select("page_id", web.urls_correlate(F.col("url"), other).alias("same"))


F11_SQL = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN lower(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '')) IS NOT NULL WHEN 1 THEN true ELSE false END AS same FROM pages"""


def f12(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.expr("CASE page_id % 3 WHEN 0 THEN '10.0.0.1:80' WHEN 1 THEN '10.0.0.2' END").alias("target_ip"), F.expr("CASE page_id % 5 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN '2.2.2.2' END").alias("src_ip"))
    return p.where(Q.degraded_scope(p, "10.0.0.1", ["1.1.1.1"], [], ["/en/"])).select("page_id", "target_ip")


F12_SQL = """WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://[^/]*', '')) AS path, CASE page_id % 3 WHEN 0 THEN '10.0.0.1:80' WHEN 1 THEN '10.0.0.2' END AS target_ip FROM pages)
SELECT page_id, target_ip FROM p WHERE page_id % 3 <> 1 AND page_id % 5 <> 1 AND (page_id % 3 = 0 OR (path <> '' AND (contains(path, '/en/') OR contains('/en/', path))))"""


def f13(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("IF(k % 2 = 0, concat('\"10.0.0.', k, '\"'), NULL)").alias("src_ip"), F.expr("concat('10.0.0.', user_id % 250, ':80')").alias("client_ip"))
    return Q.attacker_events(e, "10.0.0.12").select("event_id")


F13_SQL = f"WITH {EV} SELECT event_id FROM ev WHERE k = 12 OR user_id % 250 = 12"


def f14(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr("concat(url, CASE page_id % 7 WHEN 0 THEN '?cmd=ls' WHEN 1 THEN '?q=<ScRipt' WHEN 2 THEN '?x=${jndi:ldap' WHEN 3 THEN '?u=union+select&f=/etc/passwd' ELSE '' END)").alias("url"), F.expr("IF(page_id % 9 = 0, 'waf_alert', 'web_access_log')").alias("asset_type"))
    refs = table(spark, d, "benchmark").select((F.col("item_id") * 5 + 1).alias("ref"))
    return Q.attack_like_rows(p, "page_id", refs).select("page_id")


F14_SQL = """SELECT page_id FROM pages WHERE page_id % 7 < 3 OR page_id % 9 = 0 OR page_id IN (SELECT item_id * 5 + 1 FROM benchmark)
 OR regexp_matches(lower(url), 'webshell|/cmdi/|cmd=|command=|exec=|shell=|;id|;whoami|;cat|\\.php\\?c=|\\.php\\?cmd|upload\\.php|\\.\\./|union select')"""


def f15(spark, d):
    e = evidence(spark, d).select("event_id", F.col("user_id").alias("pid"), F.expr("IF(k % 2 = 0, '', 'C:\\\\x\\\\Collector.EXE')").alias("exe"), F.expr("IF(k % 3 = 0, 'auditctl -D -k hunt_x', 'ls')").alias("command_line"), F.lit("").alias("comm"))
    return e.where(~Q.self_noise(e, own_pids=[7], own_images=["collector.exe"], audit_key_prefix="hunt_")).select("event_id")


F15_SQL = f"WITH {EV} SELECT event_id FROM ev WHERE user_id <> 7 AND k % 2 = 0 AND k % 3 <> 0"


def f16(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("array(concat('/etc/f', k % 5), IF(k % 2 = 0, '/root/.ssh/id', '/tmp/x'), '/var/y')").alias("paths"))
    out = Q.sensitive_paths(e, "paths", ["/root/.ssh/", "/etc/f1"])
    return out.select("event_id", F.array_join("paths", ",").alias("paths"))


F16_SQL = f"""WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN k % 5 = 1 THEN '/etc/f1' END, CASE WHEN k % 2 = 0 THEN '/root/.ssh/id' END) AS paths FROM ev WHERE k % 5 = 1 OR k % 2 = 0"""


def f17(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("IF(k % 3 = 0, '', host)").alias("host"), F.expr("IF(k % 4 = 0, NULL, us)").alias("timestamp"), F.expr("IF(k % 5 = 0, NULL, 'nginx')").alias("listener_process"), F.expr("IF(k % 10 = 0, 80, NULL)").alias("listener_port"))
    ok, bad = Q.split_rejects(e, ["host", "timestamp"], [("listener_port", "listener_process")])
    return ok.select("event_id", F.lit("").alias("missing")).unionByName(bad.select("event_id", F.array_join("missing", ",").alias("missing")))


F17_SQL = f"""WITH {EV} SELECT event_id, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'host' END, CASE WHEN k % 4 = 0 THEN 'timestamp' END, CASE WHEN k % 5 = 0 AND k % 10 <> 0 THEN 'listener_port|listener_process' END) AS missing FROM ev"""

CHECKS = {
    "F01_strict_window": (f01, F01_SQL), "F02_lenient_window": (f02, F02_SQL), "F02_window_report": (f02_report, F02R_SQL), "F03_host_scope": (f03, F03_SQL),
    "F04_port_scope": (f04, F04_SQL), "F05_severity_floor": (f05, F05_SQL), "F06_compile_condition": (f06, F06_SQL), "F07_compile_condition_3vl": (f07, F07_SQL),
    "F08_cidr_match": (f08, F08_SQL), "F08_cidr_lookup": (f08_lookup, F08L_SQL), "F09_pattern_hits": (f09, F09_SQL), "F10_false_positive_check": (f10, F10_SQL),
    "F11_url_correlate": (f11, F11_SQL), "F12_degraded_scope_filter": (f12, F12_SQL), "F13_attacker_events": (f13, F13_SQL), "F14_attack_like_web": (f14, F14_SQL),
    "F15_drop_self_noise": (f15, F15_SQL), "F16_sensitive_paths": (f16, F16_SQL), "F17_split_rejects": (f17, F17_SQL),
}
