"""Evidence joins on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import gateway as G, joins as J, lateral as L, windows as W
from .base import DAY, EV, HOUR, evidence, table

H6 = 6 * HOUR
T0 = 1_704_067_200_000_000


def _side(spark, d, kind):
    e = evidence(spark, d).where(F.col("event_type") == kind)
    return e.select(F.col("event_id").alias("evidence_id"), F.expr("IF(k % 17 = 0, NULL, us)").alias("us"), F.expr("concat(' Host-', user_id)").alias("host"), (F.col("k") % 4).cast("string").alias("listener_pid"),
                    F.expr("concat('10.0.', user_id % 3, '.', k % 4, IF(k % 2 = 0, ':80', ''))").alias("src_ip"))


SPEC = J.JoinSpec("click_to_purchase", "click", "purchase", [J.Key("host", "host"), J.Key("listener_pid", "listener_pid", optional=True)], secondary=[J.Key("src_ip", "src_ip")], before_sec=6 * 3600, after_sec=6 * 3600)
EDGE = ["join_id", "left_ref", "right_ref", "confidence"]


def j01(spark, d):
    e = J.matrix_join(_side(spark, d, "click"), _side(spark, d, "purchase"), SPEC, anchor_us=T0 + 5 * DAY)
    return e.select(*EDGE, F.size("match_keys").cast("bigint").alias("n_keys"))


SIDES = """s AS (SELECT event_id, event_type, CASE WHEN k % 17 > 0 THEN us END AS us, user_id, k % 4 AS lp, (user_id % 3) * 10 + k % 4 AS ip FROM ev)"""


def _edges_sql(a, b, jid):
    return f"""SELECT '{jid}' AS join_id, l.event_id::VARCHAR AS left_ref, r.event_id::VARCHAR AS right_ref, l.us AS lus, r.us AS rus,
   round(least(0.95, 0.85 + 0.05 * ((l.lp = r.lp)::INT + (l.ip = r.ip)::INT)), 2)::DOUBLE AS confidence, 1 + (l.lp = r.lp)::INT + (l.ip = r.ip)::INT AS n
   FROM s l JOIN s r ON l.user_id = r.user_id AND l.event_type = '{a}' AND r.event_type = '{b}' AND (r.us IS NULL OR r.us BETWEEN coalesce(l.us, {T0 + 5 * DAY}) - {H6}::BIGINT AND coalesce(l.us, {T0 + 5 * DAY}) + {H6}::BIGINT)"""


J01_SQL = f"WITH {EV}, {SIDES} SELECT join_id, left_ref, right_ref, confidence, n::BIGINT AS n_keys FROM ({_edges_sql('click', 'purchase', 'click_to_purchase')})"


def _paths(spark, d):
    left = table(spark, d, "pages").select("page_id", web.normalize_url_path(F.col("url")).alias("path"))
    return left, left.select(F.col("page_id").alias("rule_id"), F.col("path").alias("prefix"))


def j02_prefix(spark, d):
    l, r = _paths(spark, d)
    return J.prefix_join(l, r, "path", "prefix").select("page_id", "rule_id")


J02P_SQL = r"""WITH p AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?]*', ''), '\?$', '')) AS path FROM pages),
r AS (SELECT page_id AS rule_id, path AS prefix FROM p)
SELECT page_id, rule_id FROM p JOIN r ON starts_with(path, prefix) OR starts_with(prefix, path) WHERE path <> '' AND prefix <> ''"""


def j02_modes(spark, d):
    """Inventory lookup, DNS answers and address matches on one spec each."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("evidence_id"), F.lit(0).cast("bigint").alias("us"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("host"),
                                           F.concat(F.lit("10.0.0."), F.col("c_nationkey").cast("string")).alias("dst_ip"), F.concat(F.lit("'10.0.1."), F.col("c_nationkey").cast("string"), F.lit("'")).alias("src_ip"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("evidence_id"), F.lit(0).cast("bigint").alias("us"), F.concat(F.lit("10.9.0."), F.col("s_nationkey").cast("string")).alias("ip"),
                                           F.concat(F.lit("answers 10.0.0."), F.col("s_nationkey").cast("string"), F.lit(" and 10.0.0."), ((F.col("s_nationkey") + 1) % 25).cast("string")).alias("response"),
                                           F.concat(F.lit("10.0.1."), F.col("s_nationkey").cast("string"), F.lit(":443")).alias("client_ip"))
    inv = table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("host"), F.concat(F.lit("10.9.0."), F.col("n_nationkey").cast("string")).alias("ip"))
    specs = [J.JoinSpec("by_inventory", keys=[J.Key("host", "ip", "hostname_to_ip")]), J.JoinSpec("by_dns", keys=[J.Key("dst_ip", "response", "dns_answer_ip")]), J.JoinSpec("by_ip", keys=[J.Key("src_ip", "client_ip")])]
    out = None
    for sp in specs:
        e = J.matrix_join(c, s, sp, host_ips=inv, counted=True)
        out = e if out is None else out.unionByName(e)
    return out


J02M_SQL = """WITH e AS (SELECT 'by_inventory' AS join_id, c_custkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey < 12
 UNION ALL SELECT 'by_dns', c_custkey FROM customer JOIN supplier ON c_nationkey = s_nationkey OR c_nationkey = (s_nationkey + 1) % 25
 UNION ALL SELECT 'by_ip', c_custkey FROM customer JOIN supplier ON c_nationkey = s_nationkey)
SELECT join_id, c_custkey::VARCHAR AS left_ref, count(*) AS n, 0.85::DOUBLE AS confidence FROM e GROUP BY ALL"""


def _chain(spark, d):
    k = lambda: [J.Key("host", "host"), J.Key("listener_pid", "listener_pid", optional=True)]
    mk = lambda i, a, b: J.JoinSpec(i, a, b, k(), [J.Key("src_ip", "src_ip")], 6 * 3600, 6 * 3600)
    specs = {"c2p": mk("c2p", "click", "purchase"), "v2e": mk("v2e", "view", "error"), "e2s": mk("e2s", "error", "signup"), "none": J.JoinSpec("none", "click", "purchase", [J.Key("host", "listener_pid")]),
             "absent": mk("absent", "click", "dns"), "whole": J.JoinSpec("whole", path=["c2p", "inner", "c2p"]), "inner": J.JoinSpec("inner", path=["v2e", "e2s"])}
    tables = {t: _side(spark, d, t) for t in ("click", "purchase", "view", "error", "signup")}
    return tables, specs, ["whole", "none", "absent"]


def j03(spark, d):
    t, s, c = _chain(spark, d)
    return J.run_chain(t, s, c, anchor_us=T0 + 5 * DAY, limit=None).select(*EDGE)


CHAIN = f"""{EV}, {SIDES}, ed AS ({_edges_sql('click', 'purchase', 'c2p')} UNION ALL {_edges_sql('view', 'error', 'v2e')} UNION ALL {_edges_sql('error', 'signup', 'e2s')})"""
J03_SQL = f"WITH {CHAIN} SELECT join_id, left_ref, right_ref, confidence FROM ed"


def j03_gaps(spark, d):
    t, s, c = _chain(spark, d)
    return J.chain_gaps(J.run_chain(t, s, c, anchor_us=T0 + 5 * DAY), s, c, list(t))


J03G_SQL = "SELECT 'none' AS join_id, 'no_match' AS gap UNION ALL SELECT 'absent', 'not_evaluated' FROM (SELECT count(*) FROM events)"


def j04(spark, d):
    t, s, c = _chain(spark, d)
    e = J.run_chain(t, s, c, anchor_us=T0 + 5 * DAY)
    return J.join_coverage(e, J.chain_gaps(e, s, c, list(t)), ["c2p", "v2e", "e2s", "none", "absent"])


J04_SQL = f"""WITH {CHAIN}, m AS (SELECT DISTINCT join_id FROM ed), sp(join_id, st) AS (VALUES ('c2p', 'no_match'), ('v2e', 'no_match'), ('e2s', 'no_match'), ('none', 'no_match'), ('absent', 'not_evaluated')),
p AS (SELECT join_id, CASE WHEN join_id IN (SELECT join_id FROM m) THEN 'matched' ELSE st END AS status FROM sp)
SELECT join_id, status, (SELECT round(count(*) FILTER (status = 'matched') / count(*), 2) FROM p)::DOUBLE AS coverage_ratio FROM p"""


def _hosted(spark, d, kind):
    return evidence(spark, d).where(F.col("event_type") == kind).select("event_id", F.expr("IF(k % 19 = 0, NULL, us)").alias("us"), F.expr("IF(k % 13 = 0, array(host, concat('host-', user_id + 1)), array(host))").alias("hosts"), F.expr("IF(k % 5 = 0, NULL, k % 3)").alias("lp"))


def j05(spark, d):
    return J.related_in_window(_hosted(spark, d, "click"), _hosted(spark, d, "purchase"), "event_id", "hosts", "lp", "us", 6 * 3600, "related").select("event_id", "related")


J05_SQL = f"""WITH {EV}, s AS (SELECT event_id, event_type, CASE WHEN k % 19 > 0 THEN us END AS us, unnest(CASE WHEN k % 13 = 0 THEN [user_id, user_id + 1] ELSE [user_id] END) AS h, CASE WHEN k % 5 > 0 THEN k % 3 END AS lp FROM ev),
m AS (SELECT DISTINCT l.event_id FROM s l JOIN s r ON l.event_type = 'click' AND r.event_type = 'purchase' AND l.h = r.h AND abs(l.us - r.us) <= {H6}::BIGINT AND (l.lp IS NULL OR r.lp IS NULL OR l.lp = r.lp))
SELECT event_id, event_id IN (SELECT event_id FROM m) AS related FROM ev WHERE event_type = 'click'"""


def gw_alerts(spark, d):
    return evidence(spark, d).where("event_type = 'error'").select(
        F.col("event_id").alias("alert_id"), "us", F.expr("IF(k % 7 = 0, NULL, concat('ip', user_id % 20))").alias("src_ip"), F.expr("CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END").alias("method"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 6).cast("string")).alias("path_key"), F.expr("CASE k % 4 WHEN 0 THEN 'Block' WHEN 1 THEN 'deny' WHEN 2 THEN 'pass' ELSE 'log' END").alias("action"), (F.col("k") % 10 == 9).alias("attack_success"),
        F.expr("IF(k % 3 = 0, concat('t', k), NULL)").alias("target_ip"))


def gw_requests(spark, d):
    return evidence(spark, d).where("event_type = 'view'").select(
        F.col("event_id").alias("evidence_id"), "us", F.expr("IF(k % 9 = 0, NULL, concat('ip', user_id % 20))").alias("src_ip"), F.expr("CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'GET' WHEN 2 THEN 'GET' ELSE 'POST' END").alias("method"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 6).cast("string")).alias("path_key"), F.expr("concat('/p/', user_id % 6, CASE k % 3 WHEN 0 THEN '?cmd=id' WHEN 1 THEN '?f=..%2f' ELSE '' END)").alias("url"),
        F.expr("element_at(array(200, 403, 404, 302), cast(k % 4 AS int) + 1)").alias("status"), F.expr("IF(k % 6 = 0, NULL, IF(k % 6 = 1, 500, 200))").alias("upstream_status"), (F.col("value") * 10).cast("bigint").alias("bytes_sent"),
        F.expr("IF(k % 4 = 3, NULL, concat('host-', user_id % 12))").alias("target_ip"))


GW = f"""{EV}, al AS (SELECT event_id AS alert_id, us, CASE WHEN k % 7 > 0 THEN user_id % 20 END AS ip, CASE k % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS method, user_id % 6 AS path, k % 4 < 2 AS blocked, k % 4 AS act, k % 10 = 9 AS done, CASE WHEN k % 3 = 0 THEN 't' || k END AS tgt FROM ev WHERE event_type = 'error'),
rq AS (SELECT event_id AS evidence_id, us, CASE WHEN k % 9 > 0 THEN user_id % 20 END AS ip, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'GET' WHEN 2 THEN 'GET' ELSE 'POST' END AS method, user_id % 6 AS path, [200, 403, 404, 302][k % 4 + 1] AS status,
  CASE k % 3 WHEN 0 THEN 'cmd=' WHEN 1 THEN '../' END AS hit, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 500 ELSE 200 END AS up, trunc(value * 10)::BIGINT AS bytes, CASE WHEN k % 4 <> 3 THEN user_id % 12 END AS tgt FROM ev WHERE event_type = 'view'),
pr AS (SELECT a.alert_id, a.blocked, a.act, a.done, r.*, abs(a.us - r.us) AS gap, (a.method IS NULL OR a.method = r.method) AS same_method, a.us AS a_us FROM al a JOIN rq r ON a.path = r.path AND (a.ip IS NULL OR r.ip IS NULL OR a.ip = r.ip))"""


def j06(spark, d):
    return G.request_pairs(gw_alerts(spark, d), gw_requests(spark, d), 7200).select("alert_id", "evidence_id")


J06_SQL = f"WITH {GW} SELECT alert_id, evidence_id FROM pr WHERE same_method AND gap <= {2 * HOUR}::BIGINT"
MISS = dict(patterns=["cmd=", "../"], minutes=240, tight_sec=5400, critical=["cmd="])


def j07(spark, d):
    m = G.gateway_misses(gw_requests(spark, d), gw_alerts(spark, d), **MISS)
    return m.select("evidence_id", "reason", "severity", F.array_join("pattern_hits", ",").alias("hits"))


MISSES = f"""{GW}, wk AS (SELECT DISTINCT coalesce(ip, -1) AS ip, path, coalesce(method, '') AS method FROM pr WHERE status = 403 AND blocked AND same_method AND gap <= 5400000000),
fl AS (SELECT evidence_id, bool_or(NOT blocked AND gap <= 14400000000) AS pass, bool_or(blocked AND gap <= 14400000000) AS near, bool_or(blocked AND same_method AND gap <= 5400000000) AS tight FROM pr GROUP BY 1),
ms AS (SELECT r.evidence_id, r.ip, r.hit, CASE WHEN coalesce(tight, false) AND w.path IS NULL THEN 'waf_block_bypass' WHEN coalesce(near, false) THEN 'waf_partial_block_same_path' ELSE 'gateway_exploit_no_waf_alert' END AS reason, CASE WHEN hit = 'cmd=' THEN 'critical' ELSE 'high' END AS severity
  FROM rq r LEFT JOIN fl USING (evidence_id) LEFT JOIN wk w ON w.ip = coalesce(r.ip, -1) AND w.path = r.path AND w.method = coalesce(r.method, '') WHERE hit IS NOT NULL AND status IN (200, 302) AND NOT coalesce(pass, false))"""
J07_SQL = f"WITH {MISSES} SELECT evidence_id, reason, severity, hit AS hits FROM ms"


def j07_summary(spark, d):
    return G.miss_summary(G.gateway_misses(gw_requests(spark, d), gw_alerts(spark, d), **MISS), 3)


J07S_SQL = f"""WITH {MISSES} SELECT 'reason' AS kind, reason AS name, count(*) AS n FROM ms GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM ms GROUP BY ALL
UNION ALL (SELECT 'source', CASE WHEN ip IS NULL THEN 'unknown' ELSE 'ip' || ip END AS name, count(*) AS n FROM ms GROUP BY ALL ORDER BY n DESC, name LIMIT 3)"""


def j08(spark, d):
    a = gw_alerts(spark, d).withColumn("us", F.expr("IF(alert_id % 6 = 0, NULL, us)"))
    return G.gateway_coverage(a, gw_requests(spark, d), T0, T0 + 20 * DAY, 3600).select("alert_id", "coverage")


J08_SQL = f"""WITH {GW}, f AS (SELECT alert_id, bool_or(gap <= {HOUR}::BIGINT) AS tight, true AS loose FROM pr WHERE same_method AND us BETWEEN {T0} AND {T0 + 20 * DAY} GROUP BY 1)
SELECT alert_id, CASE WHEN alert_id % 6 = 0 AND loose THEN 'matched' WHEN tight THEN 'matched' WHEN loose THEN 'outside_tight_window' ELSE 'no_matching_request' END AS coverage FROM al LEFT JOIN f USING (alert_id)"""


def j09(spark, d):
    return G.success_hint(gw_alerts(spark, d), gw_requests(spark, d), minutes=240, patterns=["cmd=", "../"])


J09_SQL = f"""WITH {GW}, c AS (SELECT alert_id, evidence_id, bytes, us, act, CASE WHEN act < 3 THEN 1 WHEN bytes >= 500 THEN 1 ELSE 0 END AS lv FROM (SELECT p.*, a.ip AS aip FROM pr p JOIN al a USING (alert_id)) WHERE NOT done AND (aip IS NULL OR aip = ip) AND gap <= 14400000000
   AND status = 200 AND (up IS NULL OR up = 200) AND bytes >= 64 AND hit IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY lv DESC, bytes DESC, us, evidence_id DESC) AS rn FROM c)
SELECT alert_id, CASE WHEN lv = 1 THEN 'likely' ELSE 'possible' END AS level, CASE WHEN act = 2 THEN 'waf_pass_backend_200' WHEN act < 2 THEN 'waf_block_bypass_backend_200' ELSE 'exploit_url_backend_200_large_body' END AS reason, bytes AS bytes_sent, evidence_id AS evidence_ref FROM b WHERE rn = 1"""


def j10(spark, d):
    a = gw_alerts(spark, d).withColumn("path_key", F.expr("CASE WHEN alert_id % 8 = 0 THEN NULL WHEN alert_id % 8 = 1 THEN concat(path_key, '/x') ELSE path_key END"))
    r = gw_requests(spark, d).withColumn("path_key", F.expr("IF(evidence_id % 11 = 0, NULL, path_key)"))
    return G.enrich_targets(a, r, 3 * 3600).select("alert_id", "target_ip", "target_ip_source")


J10_SQL = f"""WITH {GW}, a AS (SELECT *, CASE WHEN alert_id % 8 = 0 THEN '' WHEN alert_id % 8 = 1 THEN '/p/' || path || '/x' ELSE '/p/' || path END AS pk FROM al), r AS (SELECT *, CASE WHEN evidence_id % 11 = 0 THEN '' ELSE '/p/' || path END AS pk FROM rq WHERE tgt IS NOT NULL),
m AS (SELECT alert_id, min_by('host-' || r.tgt, (r.us, evidence_id)) AS ip FROM a JOIN r ON a.ip = r.ip AND abs(a.us - r.us) <= {3 * HOUR}::BIGINT AND (a.pk = '' OR r.pk = '' OR contains(a.pk, r.pk) OR contains(r.pk, a.pk)) WHERE a.tgt IS NULL GROUP BY 1)
SELECT alert_id, coalesce(tgt, m.ip) AS target_ip, CASE WHEN tgt IS NOT NULL THEN 'own' WHEN m.ip IS NOT NULL THEN 'access' END AS target_ip_source FROM a LEFT JOIN m USING (alert_id)"""


def host_rows(spark, d):
    return evidence(spark, d).where("event_type IN ('click', 'purchase')").select(F.col("event_id").alias("evidence_id"), "us", F.concat(F.lit("host-"), (F.col("user_id") % 15).cast("string")).alias("host"),
                                                                                F.expr("CASE WHEN event_type = 'click' AND k % 5 = 0 THEN 'host_exec:shell' WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'host_connect:outbound' END").alias("indicator"))


HOSTS = """hr AS (SELECT event_id AS ref, us AS h_us, user_id % 15 AS h, CASE WHEN event_type = 'click' AND k % 5 = 0 THEN 'host_exec:shell' WHEN event_type = 'purchase' AND k % 3 = 0 THEN 'host_connect:outbound' END AS ind FROM ev WHERE event_type IN ('click', 'purchase')),
sg AS (SELECT alert_id, ref, h_us, ind FROM pr JOIN hr ON hr.h = pr.tgt AND h_us BETWEEN pr.us - 3600000000 AND pr.us + 7200000000 WHERE ind IS NOT NULL AND status IN (200, 302) AND gap <= 7200000000)"""


def j11(spark, d):
    return G.success_evidence(gw_alerts(spark, d), gw_requests(spark, d), host_rows(spark, d), 120, 60, 120)


J11_SQL = f"""WITH {GW}, {HOSTS}, f AS (SELECT alert_id, min_by(ind, (h_us, ref)) AS ind, min_by(ref, (h_us, ref)) AS ref FROM sg GROUP BY 1)
SELECT alert_id, ind IS NOT NULL AS success, ind AS indicator, ref AS first_ref FROM al LEFT JOIN f USING (alert_id)"""


def j11_refs(spark, d):
    return G.success_refs(gw_alerts(spark, d), gw_requests(spark, d), host_rows(spark, d), 120, 60, 120)


J11R_SQL = f"WITH {GW}, {HOSTS} SELECT DISTINCT alert_id, ref FROM sg"


def j12(spark, d):
    c = G.campaign_success(gw_requests(spark, d).where("src_ip = 'ip3'"), host_rows(spark, d), T0, T0 + 10 * DAY, ["host-14"])
    return c.withColumn("indicators", F.array_join("indicators", ","))


J12_SQL = f"""WITH {GW}, {HOSTS.split(',' + chr(10) + 'sg AS')[0]}, t AS (SELECT DISTINCT tgt FROM rq WHERE ip = 3 AND tgt IS NOT NULL AND us BETWEEN {T0} AND {T0 + 10 * DAY} UNION SELECT 14),
x AS (SELECT *, h IN (SELECT tgt FROM t) AS hit FROM hr WHERE h_us BETWEEN {T0} AND {T0 + 10 * DAY})
SELECT count(*) FILTER (hit AND ind IS NOT NULL) > 0 AS attack_success, count(*) FILTER (hit AND ind IS NOT NULL) AS success_count, count(*) FILTER (hit) AS supporting_count, 0::BIGINT AS uncorrelated_count, (SELECT count(*) FROM t) AS target_count,
 string_agg(DISTINCT ind, ',' ORDER BY ind) FILTER (hit) AS indicators, 'field_correlated' AS attribution, CASE WHEN count(*) FILTER (hit AND ind IS NOT NULL) > 0 THEN 'escalate_investigate' ELSE 'log_and_monitor' END AS recommended_action FROM x"""


def _kind(spark, d, kind):
    return evidence(spark, d).where(F.col("event_type") == kind).select(F.col("event_id").alias("evidence_id"), "host", "us")


def j13(spark, d):
    c = L.execution_chain(_kind(spark, d, "click"), _kind(spark, d, "purchase"), _kind(spark, d, "view"), _kind(spark, d, "error"), 4 * 3600, 6 * 3600, 12 * 3600)
    return c.select("evidence_id", "connects", "file_ops", "persistence", "confidence")


J13_SQL = f"""WITH {EV}, n AS (SELECT c.event_id AS evidence_id, count(*) FILTER (o.event_type = 'purchase' AND abs(o.us - c.us) <= {4 * HOUR}) AS connects, count(*) FILTER (o.event_type = 'view' AND abs(o.us - c.us) <= {6 * HOUR}) AS file_ops,
 count(*) FILTER (o.event_type = 'error' AND abs(o.us - c.us) <= {12 * HOUR}) AS persistence FROM ev c JOIN ev o ON c.host = o.host WHERE c.event_type = 'click' GROUP BY 1)
SELECT *, round(least(0.95, 0.85 + 0.08 * connects), 2)::DOUBLE AS confidence FROM n"""


def j13_refs(spark, d):
    return L.execution_refs(_kind(spark, d, "click"), [(_kind(spark, d, "purchase"), 4 * 3600), (_kind(spark, d, "error"), 12 * 3600)])


J13R_SQL = f"""WITH {EV} SELECT c.event_id AS evidence_id, o.event_id AS ref FROM ev c JOIN ev o ON c.host = o.host AND c.event_type = 'click' AND ((o.event_type = 'purchase' AND abs(o.us - c.us) <= {4 * HOUR}) OR (o.event_type = 'error' AND abs(o.us - c.us) <= {12 * HOUR}))"""


def j13_persistence(spark, d):
    return L.persistence_chain(_kind(spark, d, "error"), T0 + 5 * DAY, 3600, T0 + 9 * DAY).select("evidence_id", "host", "us", "stage", "confidence")


J13P_SQL = f"WITH {EV} SELECT event_id AS evidence_id, host, us, 'persistence' AS stage, 0.84::DOUBLE AS confidence FROM ev WHERE event_type = 'error' AND us BETWEEN {T0 + 5 * DAY - HOUR} AND {T0 + 9 * DAY}"


def logins(spark, d):
    """Suppliers log in to a few other suppliers, by orders."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("s"), ((F.col("l_suppkey") * 3 + F.col("l_partkey") % 2) % 97).cast("string")).alias("dst"),
                     F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"),
                     F.expr("IF(l_returnflag = 'R' AND l_quantity > 40 AND l_suppkey % 4 > 0, 'accepted', 'failed')").alias("result"), F.col("l_returnflag").alias("flag"))


LOGINS = """lg AS (SELECT 's' || l_suppkey AS src, 's' || ((l_suppkey * 3 + l_partkey % 2) % 97) AS dst, epoch_us(l_shipdate) AS us, l_orderkey * 10 + l_linenumber AS evidence_id,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 40 AND l_suppkey % 4 > 0 THEN 'accepted' ELSE 'failed' END AS result, l_returnflag AS flag FROM lineitem)"""


def j14(spark, d):
    lg = logins(spark, d)
    seeds = table(spark, d, "supplier").where("s_suppkey IN (1, 6)").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("host"))
    out = L.lateral_hops(seeds, lg.drop("flag"), lg.where("flag = 'A'").select("src", "dst", "us", "evidence_id"), max_hops=3, near_sec=20 * 86400)
    return out.select("src", "dst", "us", "evidence_id", F.col("hop").cast("bigint").alias("hop"), "lateral_class", "confidence")


J14_SQL = f"""WITH RECURSIVE {LOGINS}, ok AS (SELECT * FROM lg WHERE src <> dst), ed AS (SELECT src, dst, min(us) AS us, min_by(evidence_id, (us, evidence_id)) AS evidence_id FROM ok WHERE result = 'accepted' GROUP BY 1, 2),
w(host, hop) AS (SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_suppkey IN (1, 6) UNION SELECT dst, hop + 1 FROM w JOIN ed ON ed.src = w.host WHERE hop < 3), b AS (SELECT host, min(hop) AS hop FROM w GROUP BY 1),
fw AS (SELECT DISTINCT e.src, e.dst FROM ed e JOIN lg f ON f.src = e.src AND f.dst = e.dst AND f.flag = 'A' AND abs(f.us - e.us) <= {20 * DAY}::BIGINT)
SELECT e.src, e.dst, e.us, e.evidence_id, (b.hop + 1)::BIGINT AS hop, 'confirmed_lateral' AS lateral_class, CASE WHEN fw.src IS NOT NULL THEN 0.88 ELSE 0.82 END::DOUBLE AS confidence
FROM b JOIN ed e ON e.src = b.host LEFT JOIN fw ON fw.src = e.src AND fw.dst = e.dst WHERE b.hop < 3
UNION ALL SELECT b.host, NULL, NULL, NULL, (b.hop + 1)::BIGINT, 'suspected_lateral', 0.55::DOUBLE FROM b WHERE b.hop < 3 AND b.host NOT IN (SELECT src FROM ed) AND (SELECT count(*) FROM ok WHERE ok.src = b.host AND result = 'failed') >= 5"""


def _commands(spark, d):
    return evidence(spark, d).select(F.col("event_id").alias("evidence_id"), "us", F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("host"),
                                     F.expr("CASE k % 4 WHEN 0 THEN concat('ssh root@10.0.0.', k % 30) WHEN 1 THEN concat('scp x ops@10.0.1.', k, ':/') WHEN 2 THEN concat('SSH 10.0.2.', k % 9) ELSE concat('ping 10.0.3.', k) END").alias("command"))


def j15(spark, d):
    src = _commands(spark, d).where("host IN ('10.0.0.3', '10.0.0.5', '10.0.0.8')").select("host")
    return L.lateral_from_exec(_commands(spark, d), src).select("src", "dst", "user", "us", "evidence_id", "confidence")


J15_SQL = f"""WITH {EV}, c AS (SELECT event_id, us, '10.0.0.' || (user_id % 40) AS src, k FROM ev WHERE user_id % 40 IN (3, 5, 8)),
t AS (SELECT event_id, us, src, '10.0.0.' || (k % 30) AS dst, unnest(['root', '?']) AS "user" FROM c WHERE k % 4 = 0)
SELECT src, dst, "user", min(us) AS us, min_by(event_id, (us, event_id)) AS evidence_id, 0.78::DOUBLE AS confidence FROM t WHERE src <> dst GROUP BY 1, 2, 3"""


def j16(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("dst"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
                                                               F.expr("CASE o_orderstatus WHEN 'F' THEN 'suspected_lateral' ELSE 'likely_lateral' END").alias("lateral_class"), F.lit(0.78).alias("confidence"), F.array(F.col("o_orderkey")).alias("evidence_refs"), F.col("o_orderkey").alias("n"))
    lg = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderpriority").alias("dst"), F.concat(F.lit("u"), (F.col("o_orderkey") % 2).cast("string")).alias("user"),
                                                                    F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_orderkey").alias("evidence_id"))
    return L.confirm_lateral(o, lg).select("n", "lateral_class", "confidence", "attempt_us", "confirmed_us", F.array_join(F.transform("evidence_refs", lambda x: x.cast("string")), ",").alias("refs"))


J16_SQL = """WITH f AS (SELECT o_custkey, o_orderpriority, o_orderkey % 2 AS u, min(o_orderdate) AS dt, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS ref FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2, 3),
c AS (SELECT o_custkey, o_orderpriority, min(epoch_us(dt)) AS cus, list(ref) AS refs FROM f GROUP BY 1, 2), j AS (SELECT o.*, c.cus, c.refs, o.o_orderstatus = 'F' AND c.cus IS NOT NULL AS hit FROM orders o LEFT JOIN c USING (o_custkey, o_orderpriority))
SELECT o_orderkey AS n, CASE WHEN hit THEN 'confirmed_lateral' WHEN o_orderstatus = 'F' THEN 'suspected_lateral' ELSE 'likely_lateral' END AS lateral_class, CASE WHEN hit THEN 0.92 ELSE 0.78 END::DOUBLE AS confidence, CASE WHEN hit THEN epoch_us(o_orderdate) END AS attempt_us,
 CASE WHEN hit THEN cus END AS confirmed_us, array_to_string(list_sort(CASE WHEN hit THEN list_distinct(list_append(refs, o_orderkey)) ELSE [o_orderkey] END), ',') AS refs FROM j"""


def _lat(spark, d):
    return evidence(spark, d).where("event_type = 'signup'").select(F.concat(F.lit("a"), (F.col("k") % 3).cast("string")).alias("src"), F.col("host").alias("dst"), "us", F.expr("IF(k % 5 = 0, 'confirmed_lateral', 'suspected_lateral')").alias("lateral_class"), F.lit(0.78).alias("confidence"), "event_id")


def _risky(spark, d):
    return evidence(spark, d).where("event_type IN ('click', 'view')").select("host", "us", (F.col("k") % 2 == 0).alias("shell"), (F.col("k") % 3 == 0).alias("download"))


def j17(spark, d):
    s = L.target_exec_burst(_lat(spark, d), _risky(spark, d), ["shell", "download"], after_sec=2 * 86400)
    return s.select("src", "dst", "first_us", "event_count", F.array_join("categories", ",").alias("categories"), "confidence")


BURST = f"""{EV}, st AS (SELECT 'a' || (k % 3) AS src, host AS dst, us, CASE WHEN k % 5 = 0 THEN 'confirmed_lateral' ELSE 'suspected_lateral' END AS cls, event_id FROM ev WHERE event_type = 'signup'),
fs AS (SELECT src, dst, min(us) AS us FROM st WHERE cls = 'suspected_lateral' GROUP BY 1, 2),
hi AS (SELECT src, dst, min(e.us) AS first_us, count(*) AS event_count, concat_ws(',', CASE WHEN bool_or(k % 3 = 0) THEN 'download' END, CASE WHEN bool_or(k % 2 = 0) THEN 'shell' END) AS categories, bool_or(k % 3 = 0)::INT + bool_or(k % 2 = 0)::INT AS nc
  FROM fs JOIN ev e ON e.host = fs.dst AND e.event_type IN ('click', 'view') AND (k % 2 = 0 OR k % 3 = 0) AND e.us BETWEEN fs.us AND fs.us + {2 * DAY} GROUP BY 1, 2),
sg AS (SELECT src, dst, first_us, event_count, categories, round(least(0.9, 0.86 + least(0.04, greatest(event_count - 3, 0) * 0.008)), 2)::DOUBLE AS confidence FROM hi WHERE event_count >= 2 AND (event_count >= 3 OR nc >= 2))"""
J17_SQL = f"WITH {BURST} SELECT * FROM sg"


def j17_upgrade(spark, d):
    s = L.target_exec_burst(_lat(spark, d), _risky(spark, d), ["shell", "download"], after_sec=2 * 86400)
    return L.upgrade_with_burst(_lat(spark, d), s)


J17U_SQL = f"""WITH {BURST} SELECT st.src, st.dst, st.us, CASE WHEN sg.src IS NOT NULL AND cls = 'suspected_lateral' THEN 'likely_lateral' ELSE cls END AS lateral_class, CASE WHEN sg.src IS NOT NULL AND cls = 'suspected_lateral' THEN greatest(0.78, confidence) ELSE 0.78 END::DOUBLE AS confidence
FROM st LEFT JOIN sg ON sg.src = st.src AND sg.dst = st.dst"""


def j18(spark, d):
    e = evidence(spark, d)
    return J.nearest_asof(e.where("event_type = 'error'").select("user_id", "us", "event_id"), e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id")), ["user_id"], "us", "event_id", "view_id", H6).select("event_id", "near_id", "near_us")


J18_SQL = f"""WITH {EV}, c AS (SELECT a.event_id, b.event_id AS near_id, b.us AS near_us, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.us - a.us), b.us, b.event_id DESC) AS rn FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view')
SELECT e.event_id, near_id, near_us FROM ev e LEFT JOIN c ON c.event_id = e.event_id AND rn = 1 AND abs(near_us - e.us) <= {H6}::BIGINT WHERE e.event_type = 'error'"""


def j19(spark, d):
    e = evidence(spark, d)
    ev = e.where("event_type IN ('view', 'error')").select("event_id", "us", "host", (F.col("k") % 8).alias("pid"), (F.col("k") % 5).alias("ppid"))
    life = e.where("event_type IN ('click', 'signup')").select("host", (F.col("k") % 8).alias("pid"), (F.col("k") % 3).alias("ppid"), F.col("us").alias("start_us"), (F.col("us") + DAY * (F.col("k") % 6)).alias("end_us"), F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("listener"))
    return J.process_attribution(ev, life, "event_id").select("event_id", "attribution", "listener")


J19_SQL = f"""WITH {EV}, e AS (SELECT event_id, us, host, k % 8 AS pid, k % 5 AS ppid FROM ev WHERE event_type IN ('view', 'error')), l AS (SELECT host, k % 8 AS pid, k % 3 AS ppid, us AS s, us + {DAY} * (k % 6) AS t, 'L' || event_id AS listener FROM ev WHERE event_type IN ('click', 'signup')),
o AS (SELECT e.event_id, arg_max((l.t, l.ppid, l.listener), l.s) AS m FROM e JOIN l ON l.host = e.host AND l.pid = e.pid AND l.s <= e.us GROUP BY 1), p AS (SELECT e.event_id, arg_max((l.t, l.listener), l.s) AS m FROM e JOIN l ON l.host = e.host AND l.pid = e.ppid AND l.s <= e.us GROUP BY 1),
x AS (SELECT e.event_id, e.ppid, CASE WHEN o.m[1] >= e.us THEN o.m[3] END AS ol, CASE WHEN o.m[1] >= e.us THEN o.m[2] END AS op, CASE WHEN p.m[1] >= e.us THEN p.m[2] END AS pl FROM e LEFT JOIN o USING (event_id) LEFT JOIN p USING (event_id))
SELECT event_id, CASE WHEN ol IS NOT NULL AND ppid > 0 AND op > 0 AND ppid <> op THEN 'unknown' WHEN ol IS NOT NULL THEN 'verified' WHEN pl IS NOT NULL THEN 'verified_parent' ELSE 'unrelated' END AS attribution,
 CASE WHEN ol IS NOT NULL AND ppid > 0 AND op > 0 AND ppid <> op THEN NULL ELSE coalesce(ol, pl) END AS listener FROM x"""


def j20(spark, d):
    e = evidence(spark, d)
    procs = e.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("instance"), F.expr("IF(k % 6 = 0, '', concat('p', event_id - 1 - k))").alias("parent"), "us", F.col("event_id").alias("evidence_id"))
    starts = e.where("event_type = 'error'").select(F.col("event_id").alias("start_id"), F.expr("concat('p', event_id - 1 - k)").alias("parent"), "us")
    return L.ancestor_replay(starts, procs).select("start_id", F.col("depth").cast("bigint").alias("depth"), "ancestor_ref")


J20_SQL = f"""WITH RECURSIVE {EV}, w AS (SELECT s.event_id AS start_id, s.us AS su, 1 AS depth, p.event_id AS ref, CASE WHEN p.k % 6 > 0 THEN p.event_id - 1 - p.k END AS nx FROM ev s JOIN ev p ON p.event_id = s.event_id - 1 - s.k AND s.us - p.us <= {DAY}::BIGINT WHERE s.event_type = 'error'
 UNION ALL SELECT start_id, su, depth + 1, p.event_id, CASE WHEN p.k % 6 > 0 THEN p.event_id - 1 - p.k END FROM w JOIN ev p ON p.event_id = w.nx AND su - p.us <= {DAY}::BIGINT WHERE depth < 16)
SELECT start_id, depth::BIGINT AS depth, ref AS ancestor_ref FROM w"""


def j21(spark, d):
    inv = table(spark, d, "customer").select(F.col("c_name").alias("host"), F.concat(F.lit("10.1.0."), F.col("c_nationkey").cast("string")).alias("ip"))
    ev = table(spark, d, "orders").select(F.expr("concat('Customer#', lpad(cast(o_custkey AS string), 9, '0'))").alias("host"), F.concat(F.lit("10.2."), F.substring("o_orderpriority", 1, 1), F.lit(".9")).alias("ip"))
    return J.host_ip_map([inv, ev])


J21_SQL = """WITH o AS (SELECT 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS host, max('10.2.' || substr(o_orderpriority, 1, 1) || '.9') AS ip FROM orders GROUP BY 1), c AS (SELECT c_name AS host, '10.1.0.' || c_nationkey AS ip FROM customer)
SELECT host, coalesce(o.ip, c.ip) AS ip FROM c FULL JOIN o USING (host)"""


def j21_enrich(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("concat('Customer#', lpad(cast(o_custkey + 5 AS string), 9, '0'))").alias("host"))
    inv = table(spark, d, "customer").select(F.col("c_name").alias("host"), F.col("c_mktsegment").alias("segment"))
    return J.enrich_from_inventory(rows, inv).select("o_orderkey", "segment", "registered")


J21E_SQL = "SELECT o_orderkey, c_mktsegment AS segment, c_custkey IS NOT NULL AS registered FROM orders LEFT JOIN customer ON c_name = 'Customer#' || lpad((o_custkey + 5)::VARCHAR, 9, '0')"


def _stages(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: F.col(c).cast("string")
    m = li.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("stage_id")).agg(F.collect_set(s("l_partkey")).alias("evidence_refs"), F.round(F.max("l_discount") + 0.6, 2).alias("confidence"))
    h = li.where("l_returnflag = 'R'").groupBy(F.concat(F.lit("h"), s("l_orderkey")).alias("sid"), F.col("l_orderkey")).agg(F.collect_set(s("l_partkey")).alias("evidence_refs"), F.round(F.max("l_tax") + 0.7, 2).alias("confidence"))
    return m, h.select((-F.col("l_orderkey")).alias("stage_id"), "evidence_refs", "confidence")


def j22(spark, d):
    m, h = _stages(spark, d)
    return J.merge_stages(m, h).select("stage_id", "confidence", "source")


J22_SQL = """WITH li AS (SELECT * FROM lineitem), m AS (SELECT l_orderkey AS id, round(max(l_discount) + 0.6, 2) AS c FROM li WHERE l_returnflag = 'A' GROUP BY 1), mr AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM li WHERE l_returnflag = 'A'),
h AS (SELECT l_orderkey AS id, round(max(l_tax) + 0.7, 2) AS c FROM li WHERE l_returnflag = 'R' GROUP BY 1), hr AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM li WHERE l_returnflag = 'R'),
up AS (SELECT mr.id, max(h.c) AS c FROM mr JOIN hr USING (ref) JOIN h ON h.id = hr.id GROUP BY 1)
SELECT m.id AS stage_id, round(greatest(m.c, coalesce(up.c, 0)), 2)::DOUBLE AS confidence, 'matrix' AS source FROM m LEFT JOIN up ON up.id = m.id
UNION ALL SELECT -id, c, 'heuristic_fallback' FROM h WHERE id NOT IN (SELECT hr.id FROM hr JOIN mr USING (ref))"""


def j22_entry(spark, d):
    e = evidence(spark, d).where("event_type IN ('view', 'click')").select("host", "us", (F.col("k") % 3).alias("outcome_rank"), (F.col("k") % 4).alias("vector_rank"), F.array(F.col("event_id")).alias("evidence_refs"), "event_type", "event_id")
    pick = lambda t: W.best_entry(e.where(F.col("event_type") == t), ["host"], [F.col("event_id") % 5], "us", "event_id").drop("event_type", "event_id")
    out = J.merge_initial_access(pick("view"), pick("click"), ["host"])
    return out.withColumn("supporting_refs", F.array_join(F.transform("supporting_refs", lambda x: x.cast("string")), ","))


J22E_SQL = f"""WITH {EV}, c AS (SELECT host, us, k % 3 AS o, k % 4 AS v, event_id, CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS h, row_number() OVER (PARTITION BY host, event_type ORDER BY event_id % 5, us, event_id) AS rn FROM ev WHERE event_type IN ('view', 'click')),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY o, v, h, us) AS pos FROM c WHERE rn = 1)
SELECT host, min(us) FILTER (pos = 1) AS us, min(o) FILTER (pos = 1) AS outcome_rank, min(v) FILTER (pos = 1) AS vector_rank, min(event_id) FILTER (pos = 1) AS primary_ref, coalesce(string_agg(event_id::VARCHAR, ',') FILTER (pos = 2), '') AS supporting_refs,
 string_agg(CASE h WHEN 0 THEN 'matrix' ELSE 'heuristic' END, '+' ORDER BY h DESC) AS correlation_source FROM r GROUP BY host"""


def j22_attach(spark, d):
    m, _ = _stages(spark, d)
    e = table(spark, d, "part").select(F.concat(F.lit("j"), (F.col("p_size") % 7).cast("string")).alias("join_id"), F.col("p_partkey").cast("string").alias("left_ref"), (F.col("p_partkey") * 2).cast("string").alias("right_ref"))
    return J.attach_join_ids(m, e).select("stage_id", F.array_join("join_ids", ",").alias("join_ids"))


J22A_SQL = """WITH mr AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'A'), e AS (SELECT 'j' || (p_size % 7) AS j, p_partkey AS ref FROM part UNION SELECT 'j' || (p_size % 7), p_partkey * 2 FROM part)
SELECT id AS stage_id, coalesce(string_agg(DISTINCT j, ',' ORDER BY j), '') AS join_ids FROM mr LEFT JOIN e USING (ref) GROUP BY 1"""


def j23(spark, d):
    t, s, c = _chain(spark, d)
    e = J.run_chain(t, s, c, anchor_us=T0 + 5 * DAY, limit=None)
    ev = evidence(spark, d).select(F.col("event_id").alias("evidence_id"), F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"), (F.floor(F.col("us") / DAY) * 1_000_000).cast("bigint").alias("us"))
    st = J.stages_from_edges(e, ev, {"c2p": "execution", "v2e": "initial_access", "e2s": "enrichment"})
    return st.select("stage", "host", "second", F.size("evidence_refs").cast("bigint").alias("n_refs"), F.array_join("join_ids", ",").alias("join_ids"), "confidence")


J23_SQL = f"""WITH {CHAIN}, x AS (SELECT CASE join_id WHEN 'c2p' THEN 'execution' ELSE 'initial_access' END AS stage, join_id, left_ref, right_ref, confidence, 'h' || (user_id % 5) AS host, ev.us // {DAY}::BIGINT AS second FROM ed JOIN ev ON ev.event_id::VARCHAR = right_ref WHERE join_id <> 'e2s'),
r AS (SELECT stage, host, second, unnest([left_ref, right_ref]) AS ref FROM x)
SELECT stage, host, second, (SELECT count(DISTINCT ref) FROM r WHERE r.stage = x.stage AND r.host = x.host AND r.second = x.second) AS n_refs, string_agg(DISTINCT join_id, ',' ORDER BY join_id) AS join_ids, round(max(confidence), 2)::DOUBLE AS confidence FROM x GROUP BY stage, host, second"""


def j24(spark, d):
    c = _commands(spark, d)
    src = c.where("host IN ('10.0.0.3', '10.0.0.5')").select("host")
    lg = evidence(spark, d).select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("src"), F.concat(F.lit("10.5.0."), (F.col("k") % 12).cast("string")).alias("dst"), F.expr("IF(event_type = 'click', 'accepted', 'failed')").alias("result"))
    return L.second_hop_targets(c, lg, src).select("target", F.array_join("via", ",").alias("via"))


J24_SQL = f"""WITH {EV}, c AS (SELECT DISTINCT CASE k % 4 WHEN 0 THEN '10.0.0.' || (k % 30) WHEN 1 THEN '10.0.1.' || k ELSE '10.0.2.' || (k % 9) END AS t FROM ev WHERE user_id % 40 IN (3, 5) AND k % 4 < 3),
n AS (SELECT t FROM c WHERE t NOT IN ('10.0.0.3', '10.0.0.5')), a AS (SELECT t FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE starts_with(o.t, n.t) AND o.t <> n.t)), l AS (SELECT DISTINCT '10.5.0.' || (k % 12) AS t FROM ev WHERE event_type = 'click' AND user_id % 40 IN (3, 5))
SELECT t AS target, string_agg(via, ',' ORDER BY via) AS via FROM (SELECT t, 'command' AS via FROM a UNION ALL SELECT t, 'login' FROM l) GROUP BY 1"""


def j25(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("IF(l_linenumber = 1, l_returnflag, NULL)").alias("key"))
    return J.route_by_id(li, "l_orderkey", "key", {"exec": ["A", "N"], "file": ["N"]}).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "module")


J25_SQL = """WITH k AS (SELECT DISTINCT l_orderkey, m FROM lineitem JOIN (VALUES ('A', 'exec'), ('N', 'exec'), ('N', 'file')) v(f, m) ON f = l_returnflag WHERE l_linenumber = 1)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, m AS module FROM lineitem JOIN k USING (l_orderkey) WHERE l_linenumber > 1
UNION ALL SELECT l_orderkey, 1::BIGINT, m FROM lineitem JOIN (VALUES ('A', 'exec'), ('N', 'exec'), ('N', 'file')) v(f, m) ON f = l_returnflag WHERE l_linenumber = 1"""


def snapshots(spark, d):
    o = table(spark, d, "orders")
    cur = o.where("o_orderkey % 11 > 0").select("o_orderkey", F.expr("IF(o_orderkey % 13 = 0, 'X', o_orderstatus)").alias("status"), F.expr("IF(o_orderkey % 17 = 0, NULL, o_orderpriority)").alias("prio"))
    prev = o.where("o_orderkey % 7 > 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.expr("IF(o_orderkey % 34 = 0, NULL, o_orderpriority)").alias("prio"))
    return prev, cur


SNAP = """p AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 34 > 0 THEN o_orderpriority END AS prio FROM orders WHERE o_orderkey % 7 > 0), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 17 > 0 THEN o_orderpriority END AS prio FROM orders WHERE o_orderkey % 11 > 0),
j AS (SELECT o_orderkey, p.status AS os, c.status AS ns, p.prio AS op, c.prio AS np FROM p FULL JOIN c USING (o_orderkey)),
df AS (SELECT *, CASE WHEN os IS NULL THEN 'created' WHEN ns IS NULL THEN 'deleted' WHEN os <> ns OR op IS DISTINCT FROM np THEN 'modified' END AS action FROM j)"""


def j26(spark, d):
    p, c = snapshots(spark, d)
    return J.snapshot_diff(p, c, ["o_orderkey"], ["status", "prio"]).select("o_orderkey", "action", F.array_join("changed", ",").alias("changed"), F.col("old")["status"].alias("old_status"), F.col("old")["prio"].alias("old_prio"))


J26_SQL = f"""WITH {SNAP} SELECT o_orderkey, action, CASE WHEN action = 'modified' THEN concat_ws(',', CASE WHEN os <> ns THEN 'status' END, CASE WHEN op IS DISTINCT FROM np THEN 'prio' END) ELSE '' END AS changed,
 CASE WHEN action = 'deleted' OR (action = 'modified' AND os <> ns) THEN os END AS old_status, CASE WHEN action = 'deleted' OR (action = 'modified' AND op IS DISTINCT FROM np) THEN op END AS old_prio FROM df WHERE action IS NOT NULL"""


def j26_process(spark, d):
    p, c = snapshots(spark, d)
    return J.process_diff(p, c, ["o_orderkey"], ["status"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


J26P_SQL = f"WITH {SNAP} SELECT CASE WHEN os IS NULL THEN 'started' WHEN ns IS NULL THEN 'exited' ELSE 'changed' END AS action, count(*) AS n FROM j WHERE os IS NULL OR ns IS NULL OR os <> ns GROUP BY 1"


def j27(spark, d):
    t = table(spark, d, "documents")
    new = t.select("doc_id", F.expr("regexp_replace(text, 'the', 'THE')").alias("text"))
    return J.line_diff(t.select("doc_id", "text"), new, "doc_id", "text")


J27_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM documents UNION ALL SELECT doc_id, unnest(string_split(regexp_replace(text, 'the', 'THE', 'g'), chr(10))), 1 FROM documents),
s AS (SELECT doc_id, line, sum(n)::BIGINT AS x FROM l GROUP BY 1, 2) SELECT doc_id, line, greatest(-x, 0) AS removed, greatest(x, 0) AS added FROM s WHERE x <> 0"""


def j28(spark, d):
    t, s, _ = _chain(spark, d)
    pid, e = J.scenario_edges(t, s, {"web": {"chain": ["c2p"]}, "ssh": {"chain": ["inner"]}}, [("s9", "web"), ("s5", "ssh"), ("s1", "web")], ["s1", "s5"], T0 + 5 * DAY, limit=None)
    return e.select(F.lit(pid).alias("pattern"), *EDGE)


J28_SQL = f"WITH {CHAIN} SELECT 'ssh' AS pattern, join_id, left_ref, right_ref, confidence FROM ed WHERE join_id IN ('v2e', 'e2s')"


def j29(spark, d):
    nets = table(spark, d, "region").select(F.col("r_regionkey").alias("network_id"), F.col("r_name").alias("network"))
    hosts = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("host_id"), F.col("n_name").alias("hostname"), F.array(F.concat(F.lit("alias-"), F.col("n_nationkey").cast("string"))).alias("aliases"), F.col("n_regionkey").alias("network_id"))
    assets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN array() WHEN 1 THEN array(concat(' nation_', s_nationkey, ' ')) WHEN 2 THEN array(concat('ALIAS-', s_nationkey), concat('NATION_', (s_nationkey + 1) % 25)) ELSE array('nowhere') END").alias("coverage"))
    return J.asset_topology(nets, hosts, assets).select("asset_id", "link_kind", "host_id", "network")


J29_SQL = """WITH t AS (SELECT s_suppkey, s_nationkey AS n FROM supplier WHERE s_suppkey % 4 IN (1, 2) UNION ALL SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 4 = 2)
SELECT s.s_suppkey AS asset_id, CASE s.s_suppkey % 4 WHEN 1 THEN 'single' WHEN 2 THEN 'coverage' ELSE 'platform' END AS link_kind, n::BIGINT AS host_id, r_name AS network FROM supplier s LEFT JOIN t USING (s_suppkey) LEFT JOIN nation ON n_nationkey = n LEFT JOIN region ON r_regionkey = n_regionkey"""

CHECKS = {
    "J01_matrix_join": (j01, J01_SQL), "J02_path_prefix": (j02_prefix, J02P_SQL), "J02_match_modes": (j02_modes, J02M_SQL), "J03_run_chain": (j03, J03_SQL), "J03_chain_gaps": (j03_gaps, J03G_SQL), "J04_join_coverage": (j04, J04_SQL),
    "J05_related_in_window": (j05, J05_SQL), "J06_waf_request_match": (j06, J06_SQL), "J07_gateway_miss_scan": (j07, J07_SQL), "J07_miss_summary": (j07_summary, J07S_SQL), "J08_gateway_coverage": (j08, J08_SQL), "J09_gateway_success_hint": (j09, J09_SQL),
    "J10_waf_enrich": (j10, J10_SQL), "J11_success_evidence": (j11, J11_SQL), "J11_success_refs": (j11_refs, J11R_SQL), "J12_campaign_success": (j12, J12_SQL), "J13_execution_chain": (j13, J13_SQL), "J13_execution_refs": (j13_refs, J13R_SQL),
    "J13_persistence_chain": (j13_persistence, J13P_SQL), "J14_lateral_hops": (j14, J14_SQL), "J15_lateral_from_exec": (j15, J15_SQL), "J16_confirm_lateral": (j16, J16_SQL), "J17_target_exec_burst": (j17, J17_SQL), "J17_upgrade_with_burst": (j17_upgrade, J17U_SQL),
    "J18_nearest_asof": (j18, J18_SQL), "J19_process_attribution": (j19, J19_SQL), "J20_ancestor_replay": (j20, J20_SQL), "J21_host_ip_map": (j21, J21_SQL), "J21_enrich_from_inventory": (j21_enrich, J21E_SQL), "J22_merge_stages": (j22, J22_SQL),
    "J22_merge_initial_access": (j22_entry, J22E_SQL), "J22_attach_join_ids": (j22_attach, J22A_SQL), "J23_stages_from_edges": (j23, J23_SQL), "J24_second_hop_targets": (j24, J24_SQL), "J25_route_by_id": (j25, J25_SQL), "J26_snapshot_diff": (j26, J26_SQL), "J26_process_diff": (j26_process, J26P_SQL),
    "J27_line_diff": (j27, J27_SQL), "J28_correlation_summary": (j28, J28_SQL), "J29_asset_topology": (j29, J29_SQL),
}
