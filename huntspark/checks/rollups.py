"""Aggregations, discovery, ranking and set operations on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import discovery as D, joins as J, lateral as L, rollups as A, rules as R, setops as U, windows as W
from .base import DAY, EV, HOUR, evidence, table
from .joins import CHAIN, EDGE, T0, _chain, logins, snapshots, LOGINS, SNAP
from .predicates import ITEMS, items
from .rules import POL, POLICY

S = lambda c: F.col(c).cast("string")


def _risks(spark, d):
    it = R.behavior_policy(items(spark, d), POLICY)
    return it.withColumns({"risk_id": F.concat(F.lit("r"), S("o_orderkey")), "us": F.col("o_orderkey") * 7 % 10007, "seq": F.col("o_orderkey"), "host": F.concat(F.lit("h"), (F.col("listener_port") % 3).cast("string")),
                           "listener_port": F.lit(None).cast("int"), "command": F.expr("concat('run  ', o_orderkey % 4)"), "policy_rule_id": F.when(F.col("o_orderkey") % 2 == 0, F.col("policy_rule_id")).otherwise(F.lit("")), "summary": F.concat(F.lit("s"), S("o_orderkey"))})


RISKS = f"""{POL}, rk AS (SELECT n, 'h' || (listener_port % 3) AS host, risk_module, CASE WHEN n % 2 = 0 THEN rule WHEN n % 3 = 0 THEN 'noise_command' WHEN n % 5 = 0 THEN 'persistence_modify' ELSE '' END AS hint, 'run ' || (n % 4) AS cmd, n * 7 % 10007 AS us,
  req AND NOT sup AS a, CAST(substr(sev2, 2) AS INT) AS rank FROM po),
ic AS (SELECT host, risk_module, hint, cmd, count(*) AS event_count, count(*) FILTER (a) AS alert_count, coalesce(min(rank) FILTER (a), min(rank)) AS rank, min(us) AS first_us, max(us) AS last_us, min_by('s' || n, (NOT a, n)) AS rep,
  array_to_string(list_slice(list_sort(list(n)), 1, 5), ',') AS ids FROM rk GROUP BY ALL)"""


def a01(spark, d):
    f = A.incidents(_risks(spark, d), ["seq"])
    return f.select("incident_id", "host", "risk_module", "rule_hint", "severity", "alert_required", "event_count", "alert_count", "first_us", "last_us", F.col("representative.summary").alias("summary"),
                    F.array_join(F.transform("sample_ids", lambda x: F.substring(x, 2, 20)), ",").alias("ids"))


A01_SELECT = """SELECT 'incident-' || substring(sha256(host || '|' || risk_module || '|' || hint || '|||' || cmd || '|'), 1, 10) AS incident_id, host, risk_module, hint AS rule_hint, 'P' || least(rank, 3) AS severity, alert_count > 0 AS alert_required,
 event_count, alert_count, first_us, last_us, rep AS summary, ids FROM ic"""
A01_SQL = f"WITH {RISKS} {A01_SELECT}"


def l01(spark, d):
    return A.top_incidents(A.incidents(_risks(spark, d), ["seq"]), 7).select("incident_id", "severity", "alert_count", "event_count")


L01_SQL = f"WITH {RISKS}, z AS ({A01_SELECT}) SELECT incident_id, severity, alert_count, event_count FROM z ORDER BY NOT alert_required, severity, alert_count DESC, event_count DESC, incident_id LIMIT 7"


def a02(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("P"), (F.col("l_quantity").cast("int") % 4).cast("string")).alias("severity"), (F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey") * 100_000 + F.round(F.col("l_extendedprice") % 997 * 100).cast("bigint")).alias("seq"),
                                            F.array(F.concat(F.lit("r"), (F.col("l_suppkey") % 6).cast("string")), F.col("l_linestatus")).alias("matched_rules"))
    m = A.merge_items(li, ["l_orderkey", "l_returnflag"], "seq")
    return m.select("l_orderkey", "l_returnflag", "severity", "seq", "merged", F.array_join("matched_rules", ",").alias("rules"))


A02_SQL = """WITH i AS (SELECT l_orderkey AS ok, l_returnflag AS rf, CAST(l_quantity AS INT) % 4 AS rank, l_partkey * 1000000000 + l_suppkey * 100000 + round(l_extendedprice % 997 * 100)::BIGINT AS seq, ['r' || (l_suppkey % 6), l_linestatus] AS rules FROM lineitem),
p AS (SELECT *, min(rank) OVER (PARTITION BY ok, rf ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM i),
o AS (SELECT ok, rf, CASE WHEN best IS NULL OR rank < best THEN 0 ELSE 1 END AS c, CASE WHEN best IS NULL OR rank < best THEN rank ELSE seq END AS pos, unnest(rules) AS rule, generate_subscripts(rules, 1) AS ix FROM p),
r AS (SELECT ok, rf, rule, min((c, pos, ix)) AS k FROM o GROUP BY 1, 2, 3), q AS (SELECT ok, rf, string_agg(rule, ',' ORDER BY k) AS rules FROM r GROUP BY 1, 2)
SELECT i.ok AS l_orderkey, i.rf AS l_returnflag, 'P' || min(rank) AS severity, min_by(seq, (rank, seq)) AS seq, count(*) AS merged, any_value(q.rules) AS rules FROM i JOIN q ON q.ok = i.ok AND q.rf = i.rf GROUP BY 1, 2"""


def a03(spark, d):
    e = evidence(spark, d).where("event_type = 'error'").select("us", "event_id", F.expr("IF(user_id % 9 = 0, NULL, host)").alias("client_ip"), (F.col("k") % 12).cast("string").alias("query"))
    r = A.nxdomain_rollup(e, tiers=((12, "P1"), (6, "P2")), max_refs=4)
    return r.withColumn("evidence_refs", F.array_join(F.transform("evidence_refs", lambda x: x.cast("string")), ","))


A03_SQL = f"""WITH {EV}, e AS (SELECT *, CASE WHEN user_id % 9 = 0 THEN 'unknown' ELSE host END AS c, row_number() OVER (PARTITION BY CASE WHEN user_id % 9 = 0 THEN 'unknown' ELSE host END ORDER BY us, event_id) AS rn FROM ev WHERE event_type = 'error')
SELECT c AS client_ip, count(*) AS query_count, count(DISTINCT k % 12) AS unique_queries, min(us) AS first_us, CASE WHEN count(*) >= 12 THEN 'P1' WHEN count(*) >= 6 THEN 'P2' ELSE 'P3' END AS severity,
 string_agg(event_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 4) AS evidence_refs FROM e GROUP BY 1"""


def a04(spark, d):
    return A.repeat_count(evidence(spark, d), ("host", "event_type"))


A04_SQL = f"WITH {EV} SELECT host, event_type, count(*) AS repeats FROM ev GROUP BY 1, 2"


def a05(spark, d):
    o = table(spark, d, "orders").select(F.expr("CASE o_orderstatus WHEN 'F' THEN 'confirmed_attack' WHEN 'O' THEN 'suspicious' ELSE 'false_positive' END").alias("alert_verdict"), F.expr("IF(o_orderkey % 9 = 0, 'success_confirmed', 'blocked')").alias("attack_outcome"),
                                         F.expr("IF(o_orderkey % 9 = 0, 'escalate_investigate', IF(o_orderkey % 9 = 1, 'block_ip', 'log_only'))").alias("recommended_action"), F.expr("CASE o_orderkey % 7 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' END").alias("hint_level"),
                                         F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'log_missing' WHEN 1 THEN 'no_matching_request' ELSE 'matched' END").alias("coverage"), F.concat(F.lit("ip"), S("o_custkey")).alias("src_ip"), F.expr("IF(o_orderpriority LIKE '5%', 'unknown', o_orderpriority)").alias("attack_type"))
    m = table(spark, d, "customer").select(F.concat(F.lit("ip"), S("c_custkey")).alias("src_ip"))
    b = A.batch_summary(o, m, 3)
    return b.withColumn("top_attack_types", F.array_join("top_attack_types", ",")).withColumn("top_ips", F.array_join("top_ips", ","))


A05_SQL = """WITH t AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1 ORDER BY n DESC, v LIMIT 3), i AS (SELECT 'ip' || k AS v, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY 1 ORDER BY n DESC, v LIMIT 3)
SELECT count(*) AS total, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS false_positive, 0::BIGINT AS scanning_or_probe, count(*) FILTER (o_orderstatus = 'O') AS suspicious, count(*) FILTER (o_orderstatus = 'F') AS confirmed_attack,
 count(*) FILTER (o_orderkey % 9 = 0) AS success_confirmed, count(*) FILTER (o_orderkey % 9 = 0) AS escalate_count, count(*) FILTER (o_orderkey % 9 = 1) AS direct_block_count, count(*) FILTER (o_orderkey % 7 = 0) AS hint_likely, count(*) FILTER (o_orderkey % 7 = 1) AS hint_possible,
 count(*) FILTER (o_orderkey % 5 = 0) AS gateway_log_missing, count(*) FILTER (o_orderkey % 5 = 1) AS gateway_log_unmatched, (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM t) AS top_attack_types, (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM i) AS top_ips, (SELECT count(*) FROM customer) AS gateway_miss_count FROM orders"""


def a06(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("us"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("country"), F.expr("IF(c_custkey % 3 = 0, '', concat('city', c_custkey % 4))").alias("city"), F.expr("IF(c_custkey % 2 = 0, 'waf', 'web')").alias("source"))
    g = A.geo_mode(c, "c_nationkey", ["country", "city"], "source", "us", "id", 3)
    return g.select(F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "event_count", F.array_join("sources", ",").alias("sources"), "country", "city", F.array_join(F.transform("evidence_refs", lambda x: x.cast("string")), ",").alias("refs"))


A06_SQL = """WITH c AS (SELECT c_nationkey AS k, c_custkey AS id, c_mktsegment AS country, CASE WHEN c_custkey % 3 > 0 THEN 'city' || (c_custkey % 4) END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'waf' ELSE 'web' END AS s FROM customer),
m AS (SELECT k, country AS v, count(*) AS n, min(id) AS f FROM c GROUP BY 1, 2), y AS (SELECT k, city AS v, count(*) AS n, min(id) AS f FROM c WHERE city IS NOT NULL GROUP BY 1, 2)
SELECT k::BIGINT AS c_nationkey, count(*) AS event_count, string_agg(DISTINCT s, ',' ORDER BY s) AS sources, (SELECT v FROM m WHERE m.k = c.k ORDER BY n DESC, f LIMIT 1) AS country, (SELECT v FROM y WHERE y.k = c.k ORDER BY n DESC, f LIMIT 1) AS city,
 array_to_string(list_slice(list_sort(list(id)), 1, 3), ',') AS refs FROM c GROUP BY k"""


def a07(spark, d):
    e = evidence(spark, d).select("host", "event_type", F.expr("IF(k % 6 = 0, NULL, us)").alias("us"), "event_id")
    return A.activity_range(e, "host", "event_type", "us", "event_id").withColumn("sources", F.array_join("sources", ","))


A07_SQL = f"""WITH {EV}, e AS (SELECT host, event_type, event_id, CASE WHEN k % 6 > 0 THEN us END AS us FROM ev) SELECT host, count(*) AS event_count, count(us) AS timestamped_count, min(us) AS first_us, max(us) AS last_us,
 min_by(event_type, (us, event_id)) FILTER (us IS NOT NULL) AS first_source, max_by(event_type, (us, event_id)) FILTER (us IS NOT NULL) AS last_source, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM e GROUP BY 1"""


def a08(spark, d):
    e = evidence(spark, d).select(F.expr("concat('203.0.113.', user_id % 250)").alias("src_ip"), F.expr("IF(k % 2 = 0, concat('10.0.0.', k), concat('\"8.8.4.', k, '\"'))").alias("client_ip"))
    return A.rank_attackers(e, ["src_ip", "client_ip"], 10)


A08_SQL = f"""WITH {EV}, x AS (SELECT '203.0.113.' || (user_id % 250) AS ip FROM ev UNION ALL SELECT '8.8.4.' || k FROM ev WHERE k % 2 = 1) SELECT ip, count(*) AS sightings FROM x GROUP BY 1 ORDER BY sightings DESC, ip LIMIT 10"""


def a09(spark, d):
    e = evidence(spark, d).withColumn("evidence_id", F.col("event_id"))
    v = A.infer_victims(e, F.col("event_type") == "signup", {"dl": F.col("k") % 5 == 0, "shell": F.col("k") % 7 == 0}, top=5)
    return v.withColumn("categories", F.array_join("categories", ","))


A09_SQL = f"""WITH {EV} SELECT host, count(*) FILTER (event_type = 'signup') AS web_exec_count, count(*) FILTER (k % 5 = 0 OR k % 7 = 0) AS high_risk_count, concat_ws(',', CASE WHEN bool_or(k % 5 = 0) THEN 'dl' END, CASE WHEN bool_or(k % 7 = 0) THEN 'shell' END) AS categories, min(us) AS first_us
FROM ev GROUP BY 1 HAVING web_exec_count > 0 AND high_risk_count > 0 ORDER BY high_risk_count DESC, web_exec_count DESC, first_us, host LIMIT 5"""


def _attempts(spark, d):
    return table(spark, d, "orders").select(F.expr("IF(o_custkey % 50 = 0, '', concat('a', o_custkey % 50))").alias("asset_id"), F.expr("element_at(array('success', 'failed', 'cache_hit', 'dry_run'), cast(o_orderkey % 4 AS int) + 1)").alias("status"), (F.col("o_orderkey") % 10 == 0).alias("truncated"),
                                            (F.col("o_orderkey") % 90).alias("returned"), F.concat(F.lit("c"), S("o_orderkey")).alias("connector_id"), (F.col("o_orderkey") % 33 == 0).alias("partial"), F.expr("IF(o_orderkey % 21 = 0, array('timeout'), NULL)").alias("incomplete_reasons"))


def a10(spark, d):
    ret = table(spark, d, "customer").where("c_custkey % 50 BETWEEN 1 AND 40").groupBy(F.concat(F.lit("a"), (F.col("c_custkey") % 50).cast("string")).alias("asset_id")).agg((F.count(F.lit(1)) * 40).alias("n"))
    dr = table(spark, d, "supplier").groupBy(F.concat(F.lit("a"), (F.col("s_suppkey") % 50).cast("string")).alias("asset_id")).agg((F.count(F.lit(1)) * 300).alias("n"))
    return A.fetch_stats(_attempts(spark, d), ret, dr)


A10_SQL = """WITH g AS (SELECT 'a' || (o_custkey % 50) AS asset_id, count(*) AS request_count, count(*) FILTER (o_orderkey % 4 < 2) AS query_count, count(*) FILTER (o_orderkey % 4 = 0) AS successful, count(*) FILTER (o_orderkey % 4 = 1) AS failed, count(*) FILTER (o_orderkey % 4 = 2) AS cache_hits,
  count(*) FILTER (o_orderkey % 10 = 0) AS truncated, coalesce(sum(o_orderkey % 90) FILTER (o_orderkey % 4 = 0), 0)::BIGINT AS fetched FROM orders WHERE o_custkey % 50 > 0 GROUP BY 1), r AS (SELECT 'a' || (c_custkey % 50) AS asset_id, count(*) * 40 AS retained FROM customer WHERE c_custkey % 50 BETWEEN 1 AND 40 GROUP BY 1),
w AS (SELECT 'a' || (s_suppkey % 50) AS asset_id, count(*) * 300 AS d FROM supplier GROUP BY 1), x AS (SELECT g.*, retained, greatest(0, fetched - retained) AS rem, coalesce(d, 0) AS d FROM g LEFT JOIN r USING (asset_id) LEFT JOIN w USING (asset_id))
SELECT asset_id, request_count, query_count, successful, failed, cache_hits, truncated, fetched, retained, CASE WHEN retained IS NOT NULL THEN least(rem, d) END AS window_filtered, CASE WHEN retained IS NOT NULL THEN rem - least(rem, d) END AS deduplicated FROM x"""


def a11(spark, d):
    a = _attempts(spark, d)
    dec = table(spark, d, "nation").select(F.concat(F.lit("a"), (F.col("n_nationkey") + 40).cast("string")).alias("asset_id"))
    return A.query_integrity(a, dec).withColumn("reasons", F.array_join("reasons", ","))


GAPS = """g AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'a' || (o_custkey % 50) END AS asset_id, 'c' || o_orderkey AS connector_id, concat_ws(',', CASE WHEN o_orderkey % 33 = 0 THEN 'partial_response' END, CASE WHEN o_orderkey % 4 = 1 THEN 'query_failed' END,
  CASE WHEN o_orderkey % 21 = 0 THEN 'timeout' END, CASE WHEN o_orderkey % 10 = 0 THEN 'truncated' END) AS reasons FROM orders),
gg AS (SELECT * FROM g WHERE reasons <> '' UNION ALL SELECT 'a' || (n_nationkey + 40), NULL, 'not_queried' FROM nation WHERE 'a' || (n_nationkey + 40) NOT IN (SELECT asset_id FROM g))"""
A11_SQL = f"WITH {GAPS} SELECT * FROM gg"


def a11_status(spark, d):
    a = _attempts(spark, d)
    return A.integrity_status(a, A.query_integrity(a))


A11S_SQL = f"WITH {GAPS} SELECT 'incomplete' AS status, count(*) AS gap_count FROM g WHERE reasons <> ''"


def _mixed_lines(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"), "event_id", F.expr("""CASE WHEN user_id % 12 < 4 THEN props WHEN user_id % 12 < 7 THEN concat('Jan  1 00:00:00 h sshd[', event_id, ']: Failed password for x from 1.2.3.4')
      WHEN user_id % 12 < 10 THEN concat('1.2.3.4 - - [01/Jan/2024:00:00:00 +0000] "GET /', event_id, ' HTTP/1.1" 200 5') WHEN user_id % 12 = 10 AND event_id % 2 = 0 THEN '{"k": ' WHEN event_id % 5 = 0 THEN props ELSE concat('k=', event_id, ' a="x"') END""").alias("line"))


def a12(spark, d):
    return D.discover_format(_mixed_lines(spark, d), "source", ["event_id"], "line")


A12_SQL = f"""WITH {EV}, e AS (SELECT user_id % 12 AS s, event_id, k, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS rn FROM ev),
v AS (SELECT s, count(*) AS n, count(*) FILTER (rn <= 50 AND (s < 4 OR (s = 10 AND event_id % 2 = 1 AND event_id % 5 = 0) OR (s = 11 AND event_id % 5 = 0))) AS j, count(*) FILTER (rn <= 50 AND s BETWEEN 4 AND 6) AS a, count(*) FILTER (rn <= 50 AND s BETWEEN 7 AND 9) AS g FROM e GROUP BY 1)
SELECT 's' || s AS source, n, CASE WHEN j >= greatest(1, n // 2) THEN 'json_lines' WHEN a >= greatest(1, n // 3) THEN 'syslog_auth' WHEN g >= greatest(1, n // 3) THEN 'nginx_combined' ELSE 'text_unknown' END AS format FROM v"""


def a13(spark, d):
    e = evidence(spark, d).select("event_type", F.expr("CASE WHEN k % 3 = 0 THEN concat('{\"a\":1,', substr(props, 2)) WHEN k % 3 = 1 THEN props ELSE 'text' END").alias("line"))
    return D.profile_keys(e, ["event_type"], "line")


A13_SQL = f"WITH {EV} SELECT event_type, 'k' AS key, count(*) AS n FROM ev WHERE k % 3 < 2 GROUP BY 1 UNION ALL SELECT event_type, 'a', count(*) FROM ev WHERE k % 3 = 0 GROUP BY 1"


def a14(spark, d):
    k = table(spark, d, "events").select(F.explode(F.array(F.lit("client_ip"), F.lit("cmd"), F.lit("my_url_field"), F.lit("us"), F.lit("host"), F.lit("src_ip"), F.lit("zzz"), F.col("event_type"))).alias("key"))
    return D.suggest_aliases(k, ["src_ip", "timestamp", "url", "host", "user", "command"], {"src_ip": "addr"})


A14_SQL = """WITH k AS (SELECT DISTINCT event_type AS key FROM events), s(key, alias_of) AS (VALUES ('client_ip', 'src_ip'), ('cmd', 'command'), ('my_url_field', 'url'), ('us', 'user'))
SELECT key, alias_of FROM s UNION ALL SELECT key, CASE WHEN contains(key, 'url') THEN 'url' END FROM k WHERE contains(key, 'url')"""


def _reqs(spark, d):
    return (table(spark, d, "nation").select(F.concat(F.lit("t"), (F.col("n_nationkey") % 5).cast("string")).alias("asset_type"), F.expr("IF(n_nationkey % 2 = 0, 'required', 'recommended')").alias("level"), F.expr("IF(n_nationkey = 3, 'evidence_id', concat('f', n_nationkey % 7))").alias("field")).distinct())


def _present(spark, d):
    return table(spark, d, "supplier").select(F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string")).alias("asset_type"), F.concat(F.lit("f"), (F.col("s_nationkey") % 3).cast("string")).alias("field")).distinct()


def a15(spark, d):
    return D.field_gaps(_present(spark, d), _reqs(spark, d), {"f0": "f4", "f1": "f5"})


REQS = """r AS (SELECT DISTINCT 't' || (n_nationkey % 5) AS asset_type, CASE WHEN n_nationkey % 2 = 0 THEN 'required' ELSE 'recommended' END AS level, CASE WHEN n_nationkey = 3 THEN 'evidence_id' ELSE 'f' || (n_nationkey % 7) END AS field FROM nation),
p0 AS (SELECT DISTINCT 't' || (s_suppkey % 4) AS asset_type, s_nationkey % 3 AS f FROM supplier), p AS (SELECT asset_type, 'f' || f AS field FROM p0 UNION SELECT asset_type, 'f' || (f + 4) FROM p0 WHERE f < 2),
gp AS (SELECT * FROM r WHERE field <> 'evidence_id' AND (asset_type, field) NOT IN (SELECT asset_type, field FROM p))"""
A15_SQL = f"WITH {REQS} SELECT asset_type, level, field FROM gp"


def a15_coverage(spark, d):
    return D.field_coverage(_present(spark, d), _reqs(spark, d), {"f0": "f4", "f1": "f5"}).withColumn("missing", F.array_join("missing", ","))


A15C_SQL = f"WITH {REQS} SELECT t.asset_type, count(gp.field) = 0 AS ok, coalesce(string_agg(DISTINCT gp.field, ',' ORDER BY gp.field), '') AS missing FROM (SELECT DISTINCT asset_type FROM r) t LEFT JOIN gp ON gp.asset_type = t.asset_type AND gp.level = 'required' GROUP BY 1"


def a16(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.expr("concat('part=', l_partkey, IF(l_linenumber % 2 = 0, concat(' qty=', l_quantity), ''), ' supp=\"', l_suppkey, '\"')").alias("line"))
    return D.draft_parser(lines, "l_returnflag", ["n"], "line").withColumn("keys", F.array_join("keys", ","))


def _registered(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.concat(F.lit("t"), (F.col("s_nationkey") % 6).cast("string")).alias("asset_type"), F.expr("IF(s_suppkey % 3 = 0, array('host', 'ts'), array('host', 'ts', 'src_ip'))").alias("fields"),
                                              F.expr("CASE s_suppkey % 4 WHEN 0 THEN array('web_zone') WHEN 1 THEN array('full') WHEN 2 THEN array('internal') ELSE array() END").alias("zones"), F.expr("IF(s_suppkey % 5 = 0, array('h1', 'h2'), array())").alias("hosts"), F.expr("IF(s_suppkey % 7 = 0, 3, IF(s_suppkey % 7 = 1, NULL, 90))").alias("retention_days"))


def a17(spark, d):
    q = table(spark, d, "nation").select(F.concat(F.lit("q"), (F.col("n_nationkey") % 10).cast("string")).alias("requirement_id"), F.expr("IF(n_nationkey % 10 < 4, 'P0', 'P1')").alias("priority"), F.concat(F.lit("t"), (F.col("n_nationkey") % 8).cast("string")).alias("asset_type"),
                                         F.expr("IF(n_nationkey % 2 = 0, array('host'), array('host', 'src_ip'))").alias("fields"), F.expr("element_at(array('any', 'full', 'web_zone', 'internal', 'target_hosts'), n_nationkey % 5 + 1)").alias("hint"))
    out = D.evaluate_requirements(q, _registered(spark, d), 7, ["h1", "h2"])
    return out.withColumn("gaps", F.array_join("gaps", ","))


A17_SQL = """WITH q AS (SELECT 'q' || (n_nationkey % 10) AS rid, CASE WHEN n_nationkey % 10 < 4 THEN 'P0' ELSE 'P1' END AS pr, n_nationkey % 8 AS t, n_nationkey % 2 = 1 AS need_src, n_nationkey % 5 AS h FROM nation),
a AS (SELECT s_suppkey AS id, s_nationkey % 6 AS t, s_suppkey % 3 > 0 AS src, s_suppkey % 4 AS z, s_suppkey % 5 = 0 AS hosts, CASE WHEN s_suppkey % 7 = 0 THEN false ELSE true END AS kept FROM supplier),
j AS (SELECT q.*, a.id, a.src, a.kept, CASE WHEN a.z = 3 AND NOT hosts THEN 'none' WHEN h = 0 THEN 'full' WHEN h = 1 THEN CASE WHEN z = 1 THEN 'full' ELSE 'none' END
   WHEN h = 2 THEN CASE WHEN z = 0 THEN 'full' WHEN hosts THEN 'partial' ELSE 'none' END WHEN h = 3 THEN CASE WHEN hosts OR z = 2 THEN 'full' ELSE 'none' END
   ELSE CASE WHEN hosts THEN 'full' WHEN z = 2 THEN 'partial' ELSE 'none' END END AS cov FROM q LEFT JOIN a USING (t)),
k AS (SELECT *, CASE WHEN id IS NULL THEN 2 WHEN (src OR NOT need_src) AND cov = 'full' AND kept THEN 0 ELSE 1 END AS st, CASE WHEN id IS NULL THEN 'not_registered' ELSE concat_ws(',', CASE WHEN need_src AND NOT src THEN 'src_ip' END, CASE WHEN cov <> 'full' THEN 'coverage_' || cov END, CASE WHEN NOT kept THEN 'retention_insufficient' END) END AS gaps FROM j)
SELECT requirement_id, priority, status, asset_id, gaps FROM (SELECT rid AS requirement_id, pr AS priority, ['ready', 'partial', 'missing'][st + 1] AS status, id AS asset_id, gaps, row_number() OVER (PARTITION BY rid ORDER BY st, id) AS rn FROM k) WHERE rn = 1"""


def a18(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("g"), F.expr("IF(o_orderpriority < '3', 'P0', 'P1')").alias("priority"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' OR o_custkey % 40 < 20 THEN 'partial' ELSE 'missing' END").alias("status"))
    return D.completeness_score(o, ["g"], 0.7, 0.5)


A18_SQL = """WITH o AS (SELECT o_custkey % 40 AS g, o_orderpriority < '3' AS p0, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' OR o_custkey % 40 < 20 THEN 'partial' ELSE 'missing' END AS s FROM orders),
a AS (SELECT g, count(*) FILTER (p0) AS c0, count(*) FILTER (p0 AND s = 'ready') AS r0, count(*) FILTER (p0 AND s = 'missing') AS m0, count(*) FILTER (NOT p0) AS c1, count(*) FILTER (NOT p0 AND s = 'ready') + 0.5 * count(*) FILTER (NOT p0 AND s = 'partial') AS r1 FROM o GROUP BY 1)
SELECT g, round(least(greatest(0.40::DOUBLE * (r0 / greatest(c0, 1)) + 0.35::DOUBLE * (r1::DOUBLE / greatest(c1, 1)) + (0.15::DOUBLE * 0.7 + 0.10::DOUBLE * 0.5), 0), 1), 2)::DOUBLE AS score, CASE WHEN m0 > 0 THEN 'not_traceable' WHEN c1 > 0 AND r1 / c1 >= 0.8 THEN 'full_traceable' ELSE 'partial_traceable' END AS verdict FROM a"""


def a18_breach(spark, d):
    s = D.completeness_score(table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("g"), F.expr("IF(o_orderpriority < '3', 'P0', 'P1')").alias("priority"), F.expr("CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderstatus = 'O' OR o_custkey % 40 < 20 THEN 'partial' ELSE 'missing' END").alias("status")), ["g"], 0.7, 0.5)
    types = table(spark, d, "region").select(F.expr("CASE r_regionkey WHEN 0 THEN 'waf_alert' WHEN 1 THEN 'host_exec' ELSE 'dns_log' END").alias("asset_type"))
    out = D.breach_confirmable(s, types, ["S1"]).select("g", F.lit("with_host").alias("kind"), "verdict", "can_confirm_breach")
    return out.unionByName(D.breach_confirmable(s, types.where("asset_type <> 'host_exec'"), ["S4"]).select("g", F.lit("without").alias("kind"), "verdict", "can_confirm_breach"))


A18B_SQL = f"""WITH s AS ({A18_SQL}) SELECT g, 'with_host' AS kind, verdict, verdict <> 'not_traceable' AS can_confirm_breach FROM s UNION ALL SELECT g, 'without', CASE WHEN verdict = 'not_traceable' THEN verdict ELSE 'alert_triage_only' END, false FROM s"""


def a18_keys(spark, d):
    a = table(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("asset_type"), F.concat(F.lit("k"), (F.col("s_suppkey") % 6).cast("string")).alias("correlation_key"))
    b = table(spark, d, "nation").where("n_nationkey < 4").select((F.col("n_nationkey") % 5).alias("asset_type"), F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("correlation_key"))
    return D.correlation_key_score(a, b)


A18K_SQL = """WITH x AS (SELECT DISTINCT s_suppkey % 6 AS k FROM supplier WHERE s_nationkey % 5 = s_suppkey % 6 AND s_suppkey % 6 < 4) SELECT count(*) AS n, CASE WHEN count(*) >= 4 THEN 1.0 WHEN count(*) >= 3 THEN 0.7 ELSE 0.4 END::DOUBLE AS key_score FROM x"""


def _counts(spark, d):
    return evidence(spark, d).groupBy(F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 40).cast("string")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def a19(spark, d):
    r = table(spark, d, "nation").select(F.concat(F.lit("rule"), (F.col("n_nationkey") % 12).cast("string")).alias("rule_id"), F.expr("concat(IF(n_nationkey % 3 = 0, 'signup', 'error'), '/', n_nationkey * 2)").alias("source"), F.expr("IF(n_nationkey < 12, 'primary', 'auxiliary')").alias("role"))
    return D.source_coverage(_counts(spark, d), r).withColumn("missing_sources", F.array_join("missing_sources", ","))


RULESRC = f"""{EV}, c AS (SELECT DISTINCT event_type || '/' || (user_id % 40) AS source FROM ev), r AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 3 = 0 THEN 'signup' ELSE 'error' END || '/' || (n_nationkey * 2) AS source FROM nation),
x AS (SELECT n, source, source IN (SELECT source FROM c) AS ok FROM r)"""
A19_SQL = f"""WITH {RULESRC} SELECT 'rule' || (n % 12) AS rule_id, CASE WHEN NOT bool_and(ok OR n >= 12) THEN 'unavailable' WHEN NOT bool_and(ok OR n < 12) THEN 'degraded' ELSE 'available' END AS status, coalesce(string_agg(source, ',' ORDER BY source) FILTER (NOT ok), '') AS missing_sources FROM x GROUP BY 1"""


def a19_level(spark, d):
    s = table(spark, d, "nation").select(F.concat(F.lit("s"), (F.col("n_nationkey") % 6).cast("string")).alias("scenario"), F.expr("concat(IF(n_nationkey % 3 = 0, 'signup', 'error'), '/', n_nationkey * 2)").alias("source"), F.expr("IF(n_nationkey < 8, 'required', 'recommended')").alias("role"))
    return D.coverage_level(_counts(spark, d), s)


A19L_SQL = f"WITH {RULESRC} SELECT 's' || (n % 6) AS scenario, CASE WHEN NOT bool_and(ok OR n >= 8) THEN 'insufficient' WHEN bool_and(ok OR n < 8) THEN 'full' ELSE 'partial' END AS level FROM x GROUP BY 1"


def _assessed(spark, d):
    return items(spark, d).withColumn("techniques", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("T"), (F.col("o_orderkey") % 4).cast("string")))))


def a20(spark, d):
    return A.assessment_summary(_assessed(spark, d), "matched_rules", "techniques")


SUMM = f"""{ITEMS}, z AS (SELECT 'severity' AS kind, severity AS name FROM it UNION ALL SELECT 'tag', 'reverse_shell' FROM it WHERE n % 2 = 0 UNION ALL SELECT 'tag', 'noise_command' FROM it WHERE n % 3 = 0 UNION ALL SELECT 'tag', 'persistence_modify' FROM it WHERE n % 5 = 0 UNION ALL SELECT 'technique', 'T' || (n % 4) FROM it WHERE n % 3 = 0)"""
A20_SQL = f"WITH {SUMM} SELECT kind, name, count(*) AS n FROM z GROUP BY 1, 2"


def a20_top(spark, d):
    return A.top_tags(A.assessment_summary(_assessed(spark, d), "matched_rules", "techniques"), 2)


A20T_SQL = f"WITH {SUMM} SELECT kind, name, count(*) AS n FROM z WHERE kind = 'tag' GROUP BY 1, 2 ORDER BY n DESC, name LIMIT 2"


def a21(spark, d):
    t = table(spark, d, "documents").select("source", F.col("text").alias("snippet"), F.expr("IF(contains(text, 'the'), 0, IF(contains(text, 'que'), 1, 2))").alias("p"))
    return A.host_highlights(t, "source", "snippet", F.col("p"), 4).select("source", "snippet", F.col("priority").cast("bigint").alias("priority"), F.col("position").cast("bigint").alias("position"))


A21_SQL = """WITH s AS (SELECT source, text AS snippet, min(CASE WHEN contains(text, 'the') THEN 0 WHEN contains(text, 'que') THEN 1 ELSE 2 END) AS priority FROM documents GROUP BY 1, 2)
SELECT * FROM (SELECT source, snippet, priority::BIGINT AS priority, row_number() OVER (PARTITION BY source ORDER BY priority, encode(snippet)) AS position FROM s WHERE snippet <> '') WHERE position <= 4"""


def a22(spark, d):
    sr = table(spark, d, "part").select("p_brand", F.col("p_type").alias("stage"), F.concat(F.lit("r"), (F.col("p_size") % 10).cast("string")).alias("rule"))
    pt = table(spark, d, "part").select(F.col("p_type").alias("stage")).distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(F.concat(F.lit("pat"), F.col("position").cast("string")).alias("pattern_id"), "position", "stage",
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("pattern_id", "position", "stage", F.concat(F.lit("r"), ((F.col("position") * 3 + F.col("i")) % 10).cast("string")).alias("rule"))
    return A.chain_pattern(sr, pt, ["p_brand"])


A22_SQL = """WITH st AS (SELECT DISTINCT p_type AS stage FROM part), pt AS (SELECT r_regionkey AS pos, stage, (r_regionkey * 3 + i) % 10 AS rule FROM region, st, range(3) t(i)), sr AS (SELECT DISTINCT p_brand, p_type AS stage, p_size % 10 AS rule FROM part),
h AS (SELECT p_brand, pos, count(*) AS score, count(DISTINCT stage) AS have FROM sr JOIN (SELECT DISTINCT * FROM pt) p USING (stage, rule) GROUP BY 1, 2)
SELECT p_brand, 'pat' || pos AS pattern_id, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, pos) AS rn FROM h WHERE have = (SELECT count(*) FROM st)) WHERE rn = 1"""


def a23(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.expr("IF(l_linenumber % 3 = 0, NULL, l_discount + 0.8)").alias("confidence"))
    return A.chain_confidence(li, ["l_orderkey"], 0.82).select("l_orderkey", "confidence")


A23_SQL = "SELECT l_orderkey, round(CAST(least(0.82, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0.7 ELSE CAST(l_discount + 0.8 AS DECIMAL(10, 6)) END) / count(*)) AS DECIMAL(18, 8)), 2)::DOUBLE AS confidence FROM lineitem GROUP BY 1"


def a24(spark, d):
    e = evidence(spark, d)
    # A timeline row is one second of a host.
    tl = e.groupBy(F.concat_ws("/", "host", F.floor(F.col("us") / 1_000_000).cast("string")).alias("step")).agg(F.collect_set(F.when(F.col("k") % 11 == 0, F.col("event_id"))).alias("evidence_refs"))
    return A.timeline_sources(tl, e.select(F.col("event_id").alias("evidence_id"), F.col("event_type").alias("asset_type")), "step", ["view", "error", "signup"]).drop("evidence_refs")


A24_SQL = f'WITH {EV} SELECT host || \'/\' || (us // 1000000) AS step, bool_or(k % 11 = 0 AND event_type = \'view\') AS "view", bool_or(k % 11 = 0 AND event_type = \'error\') AS error, bool_or(k % 11 = 0 AND event_type = \'signup\') AS signup FROM ev GROUP BY 1'


def a25(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.expr("CASE l_returnflag WHEN 'A' THEN 'args' WHEN 'R' THEN 'paths' ELSE 'sys' END").alias("kind"), F.col("l_linenumber").alias("i"), S("l_partkey").alias("v"))
    a = A.assemble_records(li, "l_orderkey", "kind", "i", "v", ["args", "paths"])
    return a.select("l_orderkey", F.array_join("args", " ").alias("args"), F.array_join("paths", " ").alias("paths"), F.col("n_lines").cast("bigint").alias("n_lines"), "complete")


A25_SQL = """SELECT l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey::VARCHAR) FILTER (l_returnflag = 'A'), '') AS args, coalesce(string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey::VARCHAR) FILTER (l_returnflag = 'R'), '') AS paths, count(*) AS n_lines,
 bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS complete FROM lineitem GROUP BY 1"""


def fragments(spark, d):
    c = table(spark, d, "conversations")
    t = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("total"))
    f = c.join(t, "conv_id").where("NOT (conv_id % 4 = 1 AND turn = 0)").select("conv_id", (F.col("turn") + F.expr("IF(conv_id % 5 = 2 AND turn = 1, 0, 1)")).alias("number"), (F.col("total") + F.expr("IF(conv_id % 7 = 3 AND turn = 0, 1, 0)")).alias("total"), "text")
    return f


def a26(spark, d):
    return A.assemble_fragments(fragments(spark, d), ["conv_id"], "number", "total", "text")


A26_SQL = """WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) + 1 AS mt FROM conversations), f AS (SELECT conv_id, turn + CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN 0 ELSE 1 END AS nr, mt + CASE WHEN conv_id % 7 = 3 AND turn = 0 THEN 1 ELSE 0 END AS total, text FROM t WHERE NOT (conv_id % 4 = 1 AND turn = 0)),
g AS (SELECT conv_id, count(*) AS n, count(DISTINCT nr) AS d, min(total) AS a, max(total) AS b, min(nr) AS lo, max(nr) AS hi, string_agg(text, '' ORDER BY nr) AS txt FROM f GROUP BY 1), s AS (SELECT *, CASE WHEN n <> d OR a <> b OR lo < 1 OR hi > a THEN 'conflict' WHEN n = a THEN 'complete' ELSE 'incomplete' END AS status FROM g)
SELECT conv_id, status, n AS fragments, CASE WHEN status = 'complete' THEN txt END AS text FROM s"""


def a27(spark, d):
    e = evidence(spark, d).select("user_id", "event_type", "us")
    return A.promote_baseline(e, ["user_id", "event_type"], "us", T0, learning_sec=20 * 86400, bucket_sec=5 * 86400, min_occurrences=5, min_hours=3, min_span_sec=6 * 3600)


A27_SQL = f"""WITH {EV}, i AS (SELECT user_id, event_type, us - {T0} AS t FROM ev WHERE us < {T0 + 20 * DAY}), b AS (SELECT user_id, event_type, x, (SELECT count(*) FROM i j WHERE j.user_id = g.user_id AND j.event_type = g.event_type AND j.t // {5 * DAY}::BIGINT = x) AS n FROM (SELECT DISTINCT user_id, event_type FROM i) g, range(4) r(x)),
p AS (SELECT user_id, event_type, max(n) AS p95 FROM b GROUP BY 1, 2), a AS (SELECT user_id, event_type, count(*) AS occurrences, count(DISTINCT t // {HOUR}::BIGINT) AS hours, max(t) - min(t) AS span FROM i GROUP BY 1, 2)
SELECT user_id, event_type, occurrences, hours, greatest(10, 3 * p95)::BIGINT AS rate_limit FROM a JOIN p USING (user_id, event_type) WHERE occurrences >= 5 AND hours >= 3 AND span >= {6 * HOUR}::BIGINT"""


def a28(spark, d):
    return A.behavior_summary(evidence(spark, d), ["event_type"], "us", F.col("k") % 3 == 0, 3 * 3600)


A28_SQL = f"WITH {EV} SELECT event_type, us // {3 * HOUR}::BIGINT * {3 * HOUR}::BIGINT AS interval_us, count(*) AS observed, count(*) FILTER (k % 3 = 0) AS suppressed, count(*) FILTER (k % 3 <> 0) AS emitted FROM ev GROUP BY 1, 2"


def a29(spark, d):
    p, c = snapshots(spark, d)
    diff = J.process_diff(p, c, ["o_orderkey"], ["status"]).withColumn("host", F.col("o_orderkey") % 9).withColumn("name", F.concat(F.lit("kworker/"), S("o_orderkey")))
    return A.churn_summary(diff, ["host"], F.col("o_orderkey") % 2 == 0, "name", 5).withColumn("names", F.array_join("names", ","))


A29_SQL = f"""WITH {SNAP}, x AS (SELECT o_orderkey % 9 AS host, CASE WHEN os IS NULL THEN 'started' WHEN ns IS NULL THEN 'exited' ELSE 'changed' END AS action, 'kworker/' || o_orderkey AS name FROM j WHERE (os IS NULL OR ns IS NULL OR os <> ns) AND o_orderkey % 2 = 0)
SELECT host, count(*) FILTER (action = 'started') AS started, count(*) FILTER (action = 'exited') AS exited, count(*) FILTER (action = 'changed') AS changed, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 5), ',') AS names FROM x GROUP BY 1"""


def l02(spark, d):
    e = evidence(spark, d).select("event_type", "us", "event_id", F.expr("IF(k % 10 = 0, '', concat(user_id, '/', k % 3))").alias("native"))
    return U.cap_per_asset(e, "event_type", ["event_type", "native"], ["us", "event_id"], 25).select("event_type", "us", "event_id")


L02_SQL = f"""WITH {EV}, f AS (SELECT event_type, us, event_id, row_number() OVER (PARTITION BY event_type, CASE WHEN k % 10 = 0 THEN '' ELSE user_id || '/' || (k % 3) END ORDER BY us, event_id) AS rn FROM ev)
SELECT event_type, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS pos FROM f WHERE rn = 1) WHERE pos <= 25"""


def l03(spark, d):
    t, s, c = _chain(spark, d)
    return J.run_chain(t, s, c, anchor_us=T0 + 5 * DAY, limit=50).select(*EDGE)


L03_SQL = f"WITH {CHAIN} SELECT join_id, left_ref, right_ref, confidence FROM (SELECT *, row_number() OVER (PARTITION BY join_id ORDER BY lus NULLS LAST, left_ref, rus NULLS LAST, right_ref) AS rn FROM ed) WHERE rn <= 50"


def l04(spark, d):
    m = table(spark, d, "supplier").select(F.concat(F.lit("label"), F.col("s_nationkey").cast("string")).alias("label"), F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string")).alias("priority"), F.col("s_suppkey").alias("seq"))
    return D.recommendations(m, "label", "priority", "seq")


L04_SQL = """WITH f AS (SELECT 'label' || s_nationkey AS label, 'P' || (s_suppkey % 3) AS priority, s_suppkey AS seq, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_suppkey) AS rn FROM supplier)
SELECT label, priority, seq, row_number() OVER (ORDER BY priority, seq) AS position FROM f WHERE rn = 1"""


def l05(spark, d):
    e = evidence(spark, d).select("event_type", "us", "event_id")
    return U.timeline_pick(e, "event_type", {"signup": 0, "purchase": 1}, ["us", "event_id"], 600)


L05_SQL = f"WITH {EV} SELECT event_type, us, event_id FROM ev ORDER BY CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 99 END, us, event_id LIMIT 600"


def x01(spark, d):
    e = evidence(spark, d).select("event_id", "us", F.concat(F.floor(F.col("us") / DAY).cast("string"), F.lit("d")).alias("timestamp"), F.col("host").alias("host_ip"), (F.col("k") % 5).cast("string").alias("pid"), F.expr("IF(event_id % 2 = 0, 'ls', 'id')").alias("cmd"))
    a, b = e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0").withColumn("extra", F.lit("x"))
    return U.merge_bundles([b, a], "host_exec", ["us", "event_id"]).select("event_id", "timestamp", "host_ip", "pid", "cmd", "extra")


X01_SQL = f"""WITH {EV}, u AS (SELECT 0 AS s, event_id, us, host, k, 'x' AS extra FROM ev WHERE event_id % 3 > 0 UNION ALL SELECT 1, event_id, us, host, k, NULL FROM ev WHERE event_id % 3 < 2)
SELECT event_id, (us // {DAY}::BIGINT) || 'd' AS timestamp, host AS host_ip, (k % 5)::VARCHAR AS pid, CASE WHEN event_id % 2 = 0 THEN 'ls' ELSE 'id' END AS cmd, extra FROM (SELECT *, row_number() OVER (PARTITION BY us // {DAY}::BIGINT, host, k % 5, event_id % 2 ORDER BY s, us, event_id) AS rn FROM u) WHERE rn = 1"""


def x01_content(spark, d):
    e = evidence(spark, d).select("event_type", "k")
    return U.merge_bundles([e, e], "other_type", ["event_type"])


X01C_SQL = f"WITH {EV} SELECT DISTINCT event_type, k FROM ev"


def x02(spark, d):
    w = table(spark, d, "nation").select((F.col("n_nationkey") % 4).alias("asset_type"), F.concat(F.lit("k"), (F.col("n_nationkey") % 9).cast("string")).alias("key"), F.col("n_nationkey").alias("position"))
    w = w.groupBy("asset_type", "key").agg(F.min("position").alias("position"))
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), (F.col("s_suppkey") % 4).alias("asset_type"), F.explode(F.array(F.concat(F.lit("k"), (F.col("s_nationkey") % 9).cast("string")), F.concat(F.lit("k"), ((F.col("s_nationkey") + 3) % 9).cast("string")))).alias("key"))
    return D.correlation_keys(w, a).withColumn("correlation_keys", F.array_join("correlation_keys", ","))


X02_SQL = """WITH w AS (SELECT n_nationkey % 4 AS t, n_nationkey % 9 AS k, min(n_nationkey) AS p FROM nation GROUP BY 1, 2), a AS (SELECT s_suppkey, s_suppkey % 4 AS t, unnest([s_nationkey % 9, (s_nationkey + 3) % 9]) AS k FROM supplier)
SELECT s_suppkey AS asset_id, coalesce(string_agg('k' || k, ',' ORDER BY p) FILTER (p IS NOT NULL), '') AS correlation_keys FROM a LEFT JOIN w USING (t, k) GROUP BY 1"""


def x03(spark, d):
    dec = table(spark, d, "part").select(F.col("p_partkey").alias("asset"))
    return D.missing_sources(dec, table(spark, d, "lineitem").where("l_quantity > 45 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("asset")), "asset")


X03_SQL = "SELECT p_partkey AS asset FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'"


def _graph(spark, d):
    lg = logins(spark, d)
    a = lg.where("result = 'accepted'").select("src", "dst", "us", "evidence_id", F.lit("lateral").alias("stage"))
    b = lg.where("flag = 'N'").select("src", "dst", "us", "evidence_id", F.expr("IF(evidence_id % 2 = 0, 'lateral', 'access')").alias("stage"))
    return U.graph_edges([a, b], ["us", "evidence_id"])


def x04(spark, d):
    return _graph(spark, d)[0]


EDGES = f"""{LOGINS}, u AS (SELECT src, dst, us, evidence_id, 'lateral' AS stage FROM lg WHERE result = 'accepted' UNION ALL SELECT src, dst, us, evidence_id, CASE WHEN evidence_id % 2 = 0 THEN 'lateral' ELSE 'access' END FROM lg WHERE flag = 'N')"""
X04_SQL = f"WITH {EDGES} SELECT src, dst, stage, us, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, stage ORDER BY us, evidence_id) AS rn FROM u) WHERE rn = 1"


def x04_nodes(spark, d):
    return _graph(spark, d)[1]


X04N_SQL = f"WITH {EDGES} SELECT src AS node FROM u UNION SELECT dst FROM u"


def x05(spark, d):
    e = evidence(spark, d).select((F.floor(F.col("us") / HOUR) * HOUR).cast("bigint").alias("us"), F.col("event_type").alias("stage"), "host", (F.col("k") % 4).alias("ref"))
    pick = lambda t: e.where(F.col("stage") == t)
    return U.timeline(pick("signup"), pick("view"), pick("click"), pick("error"), F.col("ref") == 1)


X05_SQL = f"WITH {EV} SELECT DISTINCT us // {HOUR}::BIGINT * {HOUR}::BIGINT AS us, event_type AS stage, host, k % 4 AS ref FROM ev WHERE event_type IN ('signup', 'click', 'error') OR (event_type = 'view' AND k % 4 = 1)"

CHECKS = {
    "A01_incident_rollup": (a01, A01_SQL), "A02_merge_items": (a02, A02_SQL), "A03_nxdomain_rollup": (a03, A03_SQL), "A04_repeat_count": (a04, A04_SQL), "A05_batch_summary": (a05, A05_SQL), "A06_geo_mode": (a06, A06_SQL), "A07_activity_range": (a07, A07_SQL),
    "A08_rank_attackers": (a08, A08_SQL), "A09_infer_victims": (a09, A09_SQL), "A10_fetch_stats": (a10, A10_SQL), "A11_query_integrity": (a11, A11_SQL), "A11_integrity_status": (a11_status, A11S_SQL), "A12_discover_format": (a12, A12_SQL), "A13_profile_keys": (a13, A13_SQL),
    "A14_suggest_aliases": (a14, A14_SQL), "A15_field_gaps": (a15, A15_SQL), "A15_field_coverage": (a15_coverage, A15C_SQL), "A16_draft_parser": (a16, None), "A17_evaluate_requirements": (a17, A17_SQL), "A18_completeness_score": (a18, A18_SQL), "A18_correlation_key_score": (a18_keys, A18K_SQL), "A18_breach_confirmable": (a18_breach, A18B_SQL),
    "A19_source_coverage": (a19, A19_SQL), "A19_coverage_level": (a19_level, A19L_SQL), "A20_assessment_summary": (a20, A20_SQL), "A20_top_tags": (a20_top, A20T_SQL), "A21_host_highlights": (a21, A21_SQL), "A22_chain_pattern": (a22, A22_SQL), "A23_chain_confidence": (a23, A23_SQL),
    "A24_timeline_sources": (a24, A24_SQL), "A25_assemble_records": (a25, A25_SQL), "A26_assemble_fragments": (a26, A26_SQL), "A27_promote_baseline": (a27, A27_SQL), "A28_behavior_summary": (a28, A28_SQL), "A29_churn_summary": (a29, A29_SQL),
    "L01_top_incidents": (l01, L01_SQL), "L02_cap_per_asset": (l02, L02_SQL), "L03_cap_per_join": (l03, L03_SQL), "L04_rank_recommendations": (l04, L04_SQL), "L05_timeline_pick": (l05, L05_SQL),
    "X01_merge_bundles": (x01, X01_SQL), "X01_merge_by_content": (x01_content, X01C_SQL), "X02_correlation_keys": (x02, X02_SQL), "X03_missing_sources": (x03, X03_SQL), "X04_graph_edges": (x04, X04_SQL), "X04_graph_nodes": (x04_nodes, X04N_SQL), "X05_timeline": (x05, X05_SQL),
}
