"""Normalisation and parsing on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, text as X, web
from ..functions.timefn import normalize_timestamp
from ..operators import normalize as N, parsing as P
from .base import EV, evidence, table

S = lambda c: F.col(c).cast("string")

# A raw address column with the usual dirt, in both languages.
RAW_IP = """CASE k % 5 WHEN 0 THEN concat('10.0.', user_id % 256, '.', k) WHEN 1 THEN concat('203.0.113.', user_id % 256, ':8080')
  WHEN 2 THEN concat('"198.51.100.', k, '"') WHEN 3 THEN concat(' 192.168.7.', k, ' ') ELSE concat('999.1.1.', k) END"""
RAW_IP_SQL = """CASE k % 5 WHEN 0 THEN '10.0.' || (user_id % 256) || '.' || k WHEN 1 THEN '203.0.113.' || (user_id % 256) || ':8080'
  WHEN 2 THEN '"198.51.100.' || k || '"' WHEN 3 THEN ' 192.168.7.' || k || ' ' ELSE '999.1.1.' || k END"""
GOOD_IP_SQL = """CASE k % 5 WHEN 0 THEN '10.0.' || (user_id % 256) || '.' || k WHEN 1 THEN '203.0.113.' || (user_id % 256)
  WHEN 2 THEN '198.51.100.' || k WHEN 3 THEN '192.168.7.' || k END"""


def p01(spark, d):
    e = evidence(spark, d).select("event_id", F.when(F.col("k") % 2 == 0, S("host")).alias("hostname"), F.when(F.col("k") % 3 == 0, F.lit("")).when(F.col("k") % 3 == 1, F.concat(F.lit("own-"), S("k"))).alias("host"), F.col("event_type").alias("evt"))
    return N.apply_aliases(e, {"hostname": "host", "evt": "event_type"}).select("event_id", "host", "event_type")


P01_SQL = f"""WITH {EV} SELECT event_id, CASE WHEN k % 3 = 1 THEN 'own-' || k WHEN k % 2 = 0 THEN host END AS host, event_type FROM ev"""


def p02(spark, d):
    e = evidence(spark, d).withColumn("ip", F.expr(RAW_IP))
    return e.select("event_id", net.normalize_ip(F.col("ip")).alias("ip"), net.ipv4_to_long(net.normalize_ip(F.col("ip"))).alias("ip_num"))


P02_SQL = f"""WITH {EV}, g AS (SELECT event_id, {GOOD_IP_SQL} AS ip FROM ev)
SELECT event_id, ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS ip_num FROM g"""


def p03(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    raw = F.expr("""CASE event_id % 6 WHEN 0 THEN cast(unix_seconds(t) AS string) WHEN 1 THEN cast(unix_millis(t) AS string)
      WHEN 2 THEN date_format(t, 'MMM d HH:mm:ss') WHEN 3 THEN date_format(t, "dd/MMM/yyyy:HH:mm:ss '+0000'")
      WHEN 4 THEN date_format(t + INTERVAL 8 HOURS, "yyyy-MM-dd'T'HH:mm:ss'+0800'") ELSE date_format(t + INTERVAL 8 HOURS, 'yyyy-MM-dd HH:mm:ss') END""")
    ok = normalize_timestamp(F.col("raw"), tz="+08:00", syslog_year=2024, offset_minutes=5)
    return e.withColumn("raw", raw).select("event_id", F.unix_seconds(ok).alias("epoch"))


P03_SQL = """SELECT event_id, CAST(epoch_us(ts) // 1000000 + 300 - CASE WHEN event_id % 6 = 2 THEN 28800 ELSE 0 END AS BIGINT) AS epoch FROM events"""


def p04(spark, d):
    t = table(spark, d, "documents").withColumn("phone", F.concat(F.lit("tel "), (F.lit(13800000000) + F.col("doc_id")).cast("string"), F.lit(".")))
    return t.select("doc_id", X.mask(F.col("text"), "truncate_40").alias("cut"), X.mask(F.col("source"), "redact").alias("gone"),
                    X.mask(F.col("text"), {"method": "partial", "keep_start": 3, "keep_end": 4}).alias("part"),
                    X.mask(F.col("text"), {"method": "regex_replace", "pattern": "[0-9]+", "replacement": "#"}).alias("digits"),
                    X.mask(F.col("phone"), "phone").alias("phone"))


P04_SQL = """SELECT doc_id, CASE WHEN length(text) > 40 THEN substring(text, 1, 40) || '…' ELSE text END AS cut, '[REDACTED]' AS gone,
  CASE WHEN length(text) <= 7 THEN text ELSE substring(text, 1, 3) || repeat('*', length(text) - 7) || right(text, 4) END AS part,
  regexp_replace(text, '[0-9]+', '#', 'g') AS digits,
  regexp_replace('tel ' || (13800000000 + doc_id) || '.', '(1[3-9][0-9])[0-9]{4}([0-9]{4})', '\\1****\\2') AS phone FROM documents"""


def p05(spark, d):
    e = evidence(spark, d).select(F.when(F.col("k") % 4 == 0, F.concat(F.lit("own-"), S("event_id"))).alias("evidence_id"), F.when(F.col("k") % 4 < 2, S("event_id")).alias("audit_id"),
                                  "host", F.col("us").cast("string").alias("time"), S("k").alias("port"), F.col("event_id").alias("n"))
    asset = N.Asset("asset-1", "host_exec", "conn-1")
    return e.withColumn("id", N.evidence_id(e, asset)).select("n", "id")


P05_SQL = f"""WITH {EV}, j AS (SELECT event_id, k, '{{' || CASE WHEN k % 4 < 2 THEN '"audit_id":"' || event_id || '",' ELSE '' END
  || '"host":"' || host || '","n":' || event_id || ',"port":"' || k || '","time":"' || us || '"}}' AS body FROM ev)
SELECT event_id AS n, CASE WHEN k % 4 = 0 THEN 'own-' || event_id ELSE 'host-exec-' || CASE WHEN k % 4 = 1 THEN 'v3' ELSE 'v2' END
  || '-' || substring(sha256('asset-1|conn-1|host_exec|' || body), 1, 32) END AS id FROM j"""


def p06(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.expr("CASE c_custkey % 5 WHEN 0 THEN 'localhost' WHEN 1 THEN '' WHEN 2 THEN 'LOCALHOST.localdomain' ELSE c_name END").alias("host"),
                                           F.expr("CASE WHEN c_custkey % 3 > 0 THEN concat('10.1.', c_nationkey, '.', c_custkey % 250, IF(c_custkey % 2 = 0, ':443', '')) END").alias("host_ip"),
                                           F.expr("concat('10.9.0.', c_nationkey)").alias("target_ip"))
    a = N.canonicalize_host(c, "host_exec").select("c_custkey", F.lit("exec").alias("kind"), "host", "host_ip")
    return a.unionByName(N.canonicalize_host(c, "waf_alert").select("c_custkey", F.lit("waf").alias("kind"), "host", "host_ip"))


P06_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 IN (3, 4) THEN c_name END AS good,
  CASE c_custkey % 5 WHEN 0 THEN 'localhost' WHEN 2 THEN 'LOCALHOST.localdomain' WHEN 1 THEN NULL ELSE c_name END AS given,
  CASE WHEN c_custkey % 3 > 0 THEN '10.1.' || c_nationkey || '.' || (c_custkey % 250) END AS ip, '10.9.0.' || c_nationkey AS t FROM customer)
SELECT c_custkey, 'exec' AS kind, coalesce(good, ip, given) AS host, coalesce(ip, given) AS host_ip FROM c
UNION ALL SELECT c_custkey, 'waf', coalesce(good, t), ip FROM c"""


def p07(spark, d):
    raw = evidence(spark, d).withColumn("ip_raw", F.expr(RAW_IP)).select(
        S("event_id").alias("audit_id"), F.concat(F.lit("{\"usr\":\"u"), S("user_id"), F.lit("\"}")).alias("message"), F.lit("localhost").alias("hostname"),
        F.concat(F.lit("10.2.0."), (F.col("user_id") % 250).cast("string"), F.lit(":22")).alias("log_source"), F.col("ip_raw").alias("remote"),
        (F.col("us") / 1000).cast("bigint").cast("string").alias("when"), F.concat(F.lit("run --token "), S("k")).alias("cmd"))
    asset = N.Asset("a1", "host_exec", "c1", aliases={"remote": "src_ip", "cmd": "command_line"}, time_field="when",
                    repairs=({"type": "unwrap", "column": "message", "fields": {"user": "usr"}},), masking={"command_line": {"method": "partial", "keep_start": 4}})
    return N.normalize_events(raw, asset).select("audit_id", "host", "host_ip", "src_ip", "user", "command_line", F.unix_millis("ts").alias("ms"), "evidence_id")


P07_SQL = f"""WITH {EV} SELECT event_id::VARCHAR AS audit_id, '10.2.0.' || (user_id % 250) AS host, '10.2.0.' || (user_id % 250) AS host_ip,
  coalesce({GOOD_IP_SQL}, {RAW_IP_SQL}) AS src_ip, 'u' || user_id AS "user", 'run ' || repeat('*', 8 + length(k::VARCHAR)) AS command_line,
  us // 1000 AS ms, 'host-exec-v2-' || substring(sha256('a1|c1|host_exec|{{"audit_id":"' || event_id || '","cmd":"run --token ' || k || '","command_line":"run --token ' || k || '","host":"10.2.0.' || (user_id % 250) || '","host_ip":"10.2.0.'
  || (user_id % 250) || '","hostname":"localhost","log_source":"10.2.0.' || (user_id % 250) || ':22","message":"{{\\"usr\\":\\"u' || user_id || '\\"}}","remote":' || to_json({RAW_IP_SQL}) || ',"src_ip":' || to_json(coalesce({GOOD_IP_SQL}, {RAW_IP_SQL}))
  || ',"user":"u' || user_id || '","when":"' || (us // 1000) || '"}}'), 1, 32) AS evidence_id FROM ev"""


def p08(spark, d):
    e = evidence(spark, d).select("event_id", "props")
    flat = N.flatten_json(e, "props", "k BIGINT")
    return flat.select("event_id", F.col("`props.k`").alias("k"))


P08_SQL = f"WITH {EV} SELECT event_id, k FROM ev"


def p08_long(spark, d):
    e = evidence(spark, d).select("event_id", F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"t":"'), F.col("event_type"), F.lit('"}')).alias("doc"))
    return N.flatten_json_long(e, "event_id", "doc").where("path <> 'doc.a'")


P08L_SQL = f"WITH {EV} SELECT event_id, 'doc.a.k' AS path, k::VARCHAR AS value FROM ev UNION ALL SELECT event_id, 'doc.t', event_type FROM ev"


def _auth_lines(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("""concat(date_format(cast(ts AS timestamp), 'MMM dd HH:mm:ss'), ' web', user_id % 9, CASE event_type
      WHEN 'error' THEN concat(' sshd[', event_id, ']: Failed password for invalid user u', user_id, ' from 10.3.0.', user_id % 250, ' port 22')
      WHEN 'click' THEN concat(' sshd: Accepted publickey for root from 10.4.0.', user_id % 250, ' port 22 ssh2')
      WHEN 'signup' THEN concat(' sudo: u', user_id, ' : TTY=pts/0 ; PWD=/srv ; USER=root ; COMMAND=/bin/cat /etc/sudoers')
      WHEN 'view' THEN ' kernel: app[7] segfault at 0 ip 1' ELSE concat(' app[1]: nothing new ', event_id) END)""").alias("line"), "event_type", "user_id", "ts")


def p09(spark, d):
    out = P.parse_lines(_auth_lines(spark, d), "line", "auth", F.lit("fallback"))
    g = lambda n: F.col("fields")[n].alias(n)
    return out.select("event_id", g("host"), g("src_ip"), g("user"), g("result"), "parsed")


P09_SQL = """SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'web' || (user_id % 9) ELSE 'fallback' END AS host,
  CASE event_type WHEN 'error' THEN '10.3.0.' || (user_id % 250) WHEN 'click' THEN '10.4.0.' || (user_id % 250) END AS src_ip,
  CASE event_type WHEN 'error' THEN 'u' || user_id WHEN 'click' THEN 'root' END AS "user",
  CASE event_type WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Accepted' END AS result, event_type IN ('error', 'click') AS parsed FROM events"""


def p09_json(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.to_json(F.struct("lang", "source"))).alias("line"))
    out = P.parse_lines(lines, "line", "json_lines", F.lit("h0"))
    return out.select("doc_id", F.col("fields")["lang"].alias("lang"), F.col("fields")["source"].alias("source"), F.col("fields")["host"].alias("host"), "parsed", "raw_line")


P09J_SQL = """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang, CASE WHEN doc_id % 3 > 0 THEN source END AS source, 'h0' AS host, doc_id % 3 > 0 AS parsed,
  CASE WHEN doc_id % 3 = 0 THEN source ELSE '{"lang":"' || lang || '","source":"' || source || '"}' END AS raw_line FROM documents"""


def p10(spark, d):
    out = P.syslog_to_risk_events(_auth_lines(spark, d), "line", F.when(F.col("event_id") % 2 == 0, "secure").otherwise("messages"))
    return out.select("event_id", "event_type", "severity", "rule_id", "host", "user", "src_ip", F.array_join("tags", "|").alias("tags"))


P10_SQL = """WITH e AS (SELECT *, 'web' || (user_id % 9) AS host FROM events) SELECT event_id, 'ssh_login_failed' AS event_type, 'medium' AS severity, 'secure_ssh_failed_password' AS rule_id, host,
  'u' || user_id AS "user", '10.3.0.' || (user_id % 250) AS src_ip, 'auth|ssh|bruteforce' AS tags FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'ssh_login_success', 'high', 'secure_ssh_root_login_success', host, 'root', '10.4.0.' || (user_id % 250), 'auth|ssh|login_success' FROM e WHERE event_type = 'click'
UNION ALL SELECT event_id, 'sudo_command', 'high', 'secure_sudo_command', host, 'u' || user_id, NULL, 'sudo|privilege' FROM e WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'process_crash', 'medium', 'messages_process_crash', host, NULL, NULL, 'stability|exploit_signal' FROM e WHERE event_type = 'view'"""

CODES = "element_at(array(4624, 4625, 4648, 4672, 4720, 4726, 4728, 1102, 7045, 4104, 4688, 1, 3, 11, 23, 9999), cast(event_id % 16 AS int) + 1)"
CODES_SQL = "[4624, 4625, 4648, 4672, 4720, 4726, 4728, 1102, 7045, 4104, 4688, 1, 3, 11, 23, 9999][event_id % 16 + 1]"


def p11(spark, d):
    e = evidence(spark, d).withColumn("xml", F.expr(f"""concat('<Event><System><EventID>', {CODES}, '</EventID><Computer>', host, '</Computer><EventRecordID>', event_id,
      '</EventRecordID></System><EventData><Data Name="CommandLine">', IF(k % 2 = 0, 'certutil -urlcache x', 'notepad'), '</Data><Data Name="Image">C:\\\\a\\\\b.exe</Data></EventData></Event>')"""))
    p = P.parse_windows_xml(e.select("event_id", "xml"), "xml").withColumns({"command": F.col("data")["CommandLine"], "process": F.col("data")["Image"]})
    return P.windows_risk_events(p).select("event_id", F.col("event_code").cast("bigint").alias("event_code"), "computer", "event_type", "severity", "rule_id")


P11_SQL = f"""WITH {EV}, c AS (SELECT *, {CODES_SQL} AS code FROM ev),
r(code, event_type, severity, rule_id) AS (VALUES (4624, 'windows_logon_success', 'high', 'WIN-AUTH-4624'), (4625, 'windows_logon_failed', 'medium', 'WIN-AUTH-4625'),
 (4648, 'windows_explicit_credentials', 'medium', 'WIN-AUTH-4648'), (4672, 'windows_special_privileges', 'high', 'WIN-AUTH-4672'), (4720, 'windows_user_created', 'high', 'WIN-ACCOUNT-4720'),
 (4726, 'windows_user_deleted', 'medium', 'WIN-ACCOUNT-4726'), (4728, 'windows_group_member_added', 'high', 'WIN-ACCOUNT-GROUP-ADD'), (1102, 'windows_audit_log_cleared', 'critical', 'WIN-AUDIT-1102'),
 (7045, 'windows_service_installed', 'high', 'WIN-SYSTEM-7045'), (4104, 'powershell_script_block', 'medium', 'WIN-PS-4104'), (4688, 'windows_process_high_risk', 'high', 'WIN-PROC-4688'))
SELECT event_id, code::BIGINT AS event_code, host AS computer, r.event_type, CASE WHEN code = 4104 AND k % 2 = 0 THEN 'high' ELSE severity END AS severity, rule_id
FROM c JOIN r USING (code) WHERE code <> 4688 OR k % 2 = 0"""


def p12(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("""concat('type=', IF(l_linenumber % 2 = 0, 'EXECVE', 'SYSCALL'), ' key="a b ', l_partkey, '" supp=', l_suppkey,
      ' a0=6C73 flag=', l_returnflag, ' supp=', l_suppkey + 1)""").alias("line"))
    m = X.parse_kv(F.col("line"))
    g = lambda n: F.col("m")[n]
    return li.withColumn("m", m).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), g("type").alias("type"), g("key").alias("key"), g("supp").alias("supp"),
                                        g("a0").alias("a0"), g("flag").alias("flag"), F.size("m").cast("bigint").alias("n"))


P12_SQL = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'EXECVE' ELSE 'SYSCALL' END AS type, 'a b ' || l_partkey AS key,
  (l_suppkey + 1)::VARCHAR AS supp, CASE WHEN l_linenumber % 2 = 0 THEN 'ls' ELSE '6C73' END AS a0, l_returnflag AS flag, 5::BIGINT AS n FROM lineitem"""


def p13(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.expr("CASE doc_id % 3 WHEN 0 THEN base64(cast(text AS binary)) WHEN 1 THEN text END").alias("body"),
                                            F.lit("http://x/y").alias("url"), F.expr("CASE WHEN doc_id % 6 = 4 THEN to_json(named_struct('body', source)) END").alias("request"))
    out = N.resolve_payload(t)
    # The line wrapping of base64() is blank space and must not matter.
    same = F.expr("CASE WHEN payload = text THEN 'text' WHEN payload = url THEN 'url' WHEN payload = body THEN 'raw' ELSE payload END")
    return out.select("doc_id", same.alias("payload"), "payload_source", "payload_encoding")


P13_SQL = r"""WITH t AS (SELECT *, octet_length(encode(text)) AS nb, length(regexp_replace(text, '[^\x20-\x7e\t\n\r]', '', 'g')) AS np FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 = 4 THEN source WHEN doc_id % 3 = 2 THEN 'url' WHEN doc_id % 3 = 1 THEN 'text' WHEN np / nb >= 0.55 THEN 'text' ELSE 'raw' END AS payload,
 CASE WHEN doc_id % 6 = 4 THEN 'request.json.body' WHEN doc_id % 3 < 2 THEN 'body' END AS payload_source,
 CASE WHEN doc_id % 6 = 4 THEN 'plain' WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 3 = 0 AND np / nb >= 0.55 THEN 'base64' ELSE 'plain' END AS payload_encoding FROM t"""


def p14(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.expr("CASE WHEN page_id % 2 = 0 THEN concat('10.5.0.', page_id % 250, ':8443') END").alias("upstream_addr"),
                                        F.expr("CASE WHEN page_id % 3 = 0 THEN concat('10.6.0.', page_id % 250) END").alias("target_ip"), F.expr("CASE WHEN page_id % 5 = 0 THEN '-' WHEN page_id % 5 = 1 THEN 'site' END").alias("http_host"))
    return N.derive_waf_victim(p).select("page_id", "target_ip", "http_host")


P14_SQL = """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.6.0.' || (page_id % 250) WHEN page_id % 2 = 0 THEN '10.5.0.' || (page_id % 250) END AS target_ip,
  CASE WHEN page_id % 5 = 1 THEN 'site' ELSE nullif(regexp_replace(lower(split_part(regexp_replace(split_part(url, '://', 2), '[?#].*$', ''), '/', 1)), ':[0-9]+$', ''), '') END AS http_host FROM pages"""


def p15(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("GET /A%2541+b/"), S("page_id"), F.lit("?q=100%&x=%5C HTTP/1.1")).alias("req"))
    return p.select("page_id", web.normalize_url_path(F.col("url")).alias("path"), web.path_query(F.col("req")).alias("req"), web.decoded_text(web.path_query(F.col("req"))).alias("decoded"))


P15_SQL = r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-zA-Z]+://[^/?]*', '') AS rest FROM pages)
SELECT page_id, lower(regexp_replace(rest, '\?$', '')) AS path, '/A%2541+b/' || page_id || '?q=100%&x=%5C' AS req, '/aA b/' || page_id || '?q=100%&x=/' AS decoded FROM r"""


def p16(spark, d):
    t = evidence(spark, d).select("event_id", F.concat(F.lit("seen 10.0.0."), S("k"), F.lit(" then 300.1.1.1, 172.16.3."), F.col("user_id") % 250, F.lit("; 10.0.0."), S("k")).alias("txt"))
    return t.select("event_id", F.array_join(net.extract_ipv4s(F.col("txt")), ",").alias("ips"))


P16_SQL = f"WITH {EV} SELECT event_id, '10.0.0.' || k || ',172.16.3.' || (user_id % 250) AS ips FROM ev"


def p17(spark, d):
    t = evidence(spark, d).select("event_id", F.expr("""CASE k % 3 WHEN 0 THEN concat('scp a root@10.7.0.', k, ':/tmp; ssh ops@10.7.1.', k) WHEN 1 THEN concat('ssh -p 22 10.8.0.', k) ELSE 'ls -l' END""").alias("cmd"))
    return t.select("event_id", F.explode(N.ssh_targets(F.col("cmd"))).alias("t")).select("event_id", "t.user", "t.ip")


P17_SQL = f"""WITH {EV} SELECT event_id, u AS "user", ip FROM (
  SELECT event_id, 'root' AS u, '10.7.0.' || k AS ip FROM ev WHERE k % 3 = 0 UNION ALL SELECT event_id, 'ops', '10.7.1.' || k FROM ev WHERE k % 3 = 0
  UNION ALL SELECT event_id, '?', '10.7.0.' || k FROM ev WHERE k % 3 = 0 UNION ALL SELECT event_id, '?', '10.7.1.' || k FROM ev WHERE k % 3 = 0
  UNION ALL SELECT event_id, '?', '10.8.0.' || k FROM ev WHERE k % 3 = 1)"""


def p18(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("sshpass -p s3cret  ssh HTTP://LOCALHOST/x "), F.col("text")).alias("cmd"))
    return t.select("doc_id", X.command_fingerprint(F.col("cmd")).alias("fp"))


P18_SQL = r"""SELECT doc_id, substring(regexp_replace('sshpass -p *  ssh http://127.0.0.1//x ' || regexp_replace(regexp_replace(trim(text), '(?i)https?://127\.0\.0\.1|https?://localhost\b', 'http://127.0.0.1/', 'g'), 'sshpass -p [^ \t\n\r\f\v]+', 'sshpass -p *', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), 1, 160) AS fp FROM documents"""


def p19(spark, d):
    h = table(spark, d, "pages").select("page_id", F.expr("concat(substr(sha2(cast(page_id AS string), 256), 1, cast(page_id % 60 AS int) + 4), '.', regexp_extract(url, '://([^/?#:]+)', 1), IF(page_id % 4 = 0, '.xyz', ''))").alias("q"),
                                        F.expr("IF(page_id % 2 = 0, 'TXT', 'A')").alias("qt"))
    f = X.dns_features(F.col("q"), F.col("qt"))
    return h.withColumn("f", f).select("page_id", F.col("f.tld").alias("tld"), F.col("f.longest_label").cast("bigint").alias("longest"), F.round("f.entropy", 6).alias("entropy"), F.round("f.digit_ratio", 6).alias("digits"),
                                       F.col("f.dga_like").alias("dga_like"), F.col("f.tunnel_like").alias("tunnel_like"), F.col("f.uncommon_tld").alias("uncommon_tld"))


P19_SQL = r"""WITH h AS (SELECT page_id, lower(substring(sha256(page_id::VARCHAR), 1, (page_id % 60 + 4)::INT) || '.' || regexp_extract(url, '://([^/?#:]+)', 1) || CASE WHEN page_id % 4 = 0 THEN '.xyz' ELSE '' END) AS q,
   CASE WHEN page_id % 2 = 0 THEN 'TXT' ELSE 'A' END AS qt FROM pages),
lab AS (SELECT page_id, q, qt, string_split(q, '.') AS ls FROM h),
pos AS (SELECT page_id, l, i, n FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM lab)),
cand AS (SELECT page_id, l AS cand FROM (SELECT page_id, l, row_number() OVER (PARTITION BY page_id ORDER BY length(l) DESC, i) AS rn FROM pos WHERE i < n OR n = 1) WHERE rn = 1),
mx AS (SELECT page_id, max(length(l)) AS longest, max(CASE WHEN i = n THEN l END) AS tld FROM pos GROUP BY page_id),
ch AS (SELECT page_id, c, count(*) AS m FROM (SELECT page_id, unnest(string_split(cand, '')) AS c FROM cand) GROUP BY ALL),
en AS (SELECT page_id, -sum(m / t * log2(m / t)) AS e FROM (SELECT *, sum(m) OVER (PARTITION BY page_id) AS t FROM ch) GROUP BY page_id),
f AS (SELECT l.page_id, l.q, l.qt, mx.tld, mx.longest, en.e, length(regexp_replace(cand, '[^0-9]', '', 'g')) / length(cand) AS dr, length(cand) AS cl FROM lab l JOIN cand USING (page_id) JOIN mx USING (page_id) JOIN en USING (page_id)),
g AS (SELECT *, regexp_matches(q, '(^|\.)(local|lan|corp|internal|intranet)$') AS inner_name FROM f)
SELECT page_id, tld, longest, round(e, 6) AS entropy, round(dr, 6) AS digits, NOT inner_name AND cl >= 16 AND (e >= 3.6 OR dr >= 0.25) AS dga_like,
 length(q) >= 90 OR (longest >= 48 AND qt = 'TXT') AS tunnel_like, NOT inner_name AND tld IN ('top','xyz','club','work','click','monster','mom','rest','fit','gq','tk','ml','cf') AS uncommon_tld FROM g"""


def p20(spark, d):
    e = evidence(spark, d)
    base = e.where("event_type = 'signup' OR (event_type = 'error' AND k % 2 = 0)").select("event_id", F.lit("seen").alias("result"), F.col("host").alias("user"), F.lit("s").alias("src_ip"))
    sys = e.where("event_type IN ('error', 'click', 'view')").select("event_id", F.expr("CASE event_type WHEN 'error' THEN 'ssh_login_failed' WHEN 'click' THEN 'ssh_login_success' ELSE 'oom_kill' END").alias("event_type"),
                                                                     F.concat(F.lit("for u"), S("user_id"), F.lit(" from 10.9.9."), (F.col("user_id") % 200).cast("string")).alias("message"))
    return N.add_missing(base, N.syslog_to_ssh_auth(sys), "event_id").select("event_id", "result", "user", "src_ip")


P20_SQL = f"""WITH {EV} SELECT event_id, 'seen' AS result, host AS "user", 's' AS src_ip FROM ev WHERE event_type = 'signup' OR (event_type = 'error' AND k % 2 = 0)
UNION ALL SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'accepted' END, 'u' || user_id, '10.9.9.' || (user_id % 200) FROM ev WHERE event_type = 'click' OR (event_type = 'error' AND k % 2 = 1)"""


def p20_failed(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("IF(k % 17 = 0, NULL, us)").alias("us"), F.expr("CASE k % 4 WHEN 0 THEN 'localhost' WHEN 1 THEN '' ELSE host END").alias("host"), F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'success' ELSE '' END").alias("result"),
                                  F.expr("CASE event_type WHEN 'signup' THEN 'AUTH_failure' WHEN 'purchase' THEN 'ssh_invalid_user' WHEN 'view' THEN 'other' END").alias("event_type"), F.concat(F.lit("for u"), S("user_id"), F.lit(" from 10.9.9."), (F.col("user_id") % 200).cast("string")).alias("message"), F.expr("IF(k % 2 = 0, 'null', '1.2.3.4')").alias("src_ip"))
    return N.failed_logins(e).select("event_id", "host", "src_ip", "user", "result")


P20F_SQL = f"""WITH {EV}, s AS (SELECT *, CASE WHEN k % 2 = 0 THEN '10.9.9.' || (user_id % 200) ELSE '1.2.3.4' END AS src FROM ev WHERE event_type IN ('error', 'signup') AND k % 17 <> 0)
SELECT event_id, CASE WHEN k % 4 < 2 THEN src ELSE host END AS host, src AS src_ip, 'u' || user_id AS "user", 'failed' AS result FROM s"""


def p21(spark, d):
    e = evidence(spark, d).select("event_id", "props", F.when(F.col("k") % 2 == 0, S("us")).alias("time"), F.lit("1").alias("ingest_time"), F.when(F.col("k") % 3 == 0, "own").alias("port"),
                                  F.when(F.col("k") % 3 == 1, F.col("host")).otherwise("localhost").alias("host"), F.concat(F.lit("src-"), S("user_id")).alias("source"))
    out = N.repair_events(e, ({"type": "unwrap", "column": "props", "fields": {"port": "k"}}, {"type": "fallback_time", "target": "time", "from": ["ingest_time"]}, {"type": "source_to_host", "from": ["source"]}))
    return out.select("event_id", "port", "time", "host")


P21_SQL = f"""WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'own' ELSE k::VARCHAR END AS port, CASE WHEN k % 2 = 0 THEN us::VARCHAR ELSE '1' END AS time,
  CASE WHEN k % 3 = 1 THEN host ELSE 'src-' || user_id END AS host FROM ev"""


def p22(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("CASE k % 4 WHEN 0 THEN 'nginx' WHEN 1 THEN 'sshd' WHEN 2 THEN 'java' END").alias("listener_process"), F.expr("IF(k % 8 = 2, '443', '5000')").alias("listener_port"),
                                  F.expr("CASE event_type WHEN 'view' THEN 'sh -c id' WHEN 'click' THEN 'curl http://x/uploads/s.phtml' ELSE 'ls' END").alias("command_line"),
                                  F.expr("CASE k % 3 WHEN 0 THEN 'pts/1' WHEN 1 THEN '?' END").alias("tty"), F.expr("IF(event_type = 'view', 'BASH', 'ls')").alias("comm"))
    return N.exec_context_flags(e).select("event_id", "web_listener_exec", "non_interactive", "shell_exe")


P22_SQL = f"""WITH {EV} SELECT event_id, CASE WHEN k % 4 = 1 THEN event_type = 'click' AND k % 3 <> 0
   WHEN (k % 4 = 0 OR k % 8 = 2) AND event_type IN ('view', 'click') THEN true ELSE event_type = 'click' AND k % 3 <> 0 END AS web_listener_exec,
  CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS non_interactive, event_type = 'view' AS shell_exe FROM ev"""


def p23(spark, d):
    e = evidence(spark, d).withColumn("ip", net.normalize_ip(F.expr(RAW_IP)))
    return e.select("event_id", net.network_tag(F.col("ip")).alias("tag"), F.array_join(net.network_attributes(F.col("ip"), F.expr("IF(k % 3 = 0, '', 'DE')"), F.lit(""), F.col("event_type")), ";").alias("labels"))


P23_SQL = f"""WITH {EV}, t AS (SELECT *, CASE k % 5 WHEN 0 THEN 'private' WHEN 3 THEN 'private' WHEN 4 THEN 'invalid' ELSE 'global' END AS tag FROM ev)
SELECT event_id, tag, tag || CASE WHEN k % 3 > 0 THEN ';geo: DE / ' || event_type ELSE '' END AS labels FROM t"""


def p24(spark, d):
    p = table(spark, d, "pages").select("page_id", F.expr("concat(url, CASE page_id % 5 WHEN 0 THEN '?q=1 union select 2' WHEN 1 THEN '?cmd=id' WHEN 2 THEN '/shell.php' ELSE '' END)").alias("url"),
                                        F.expr("CASE page_id % 4 WHEN 0 THEN 'Block' WHEN 1 THEN '' END").alias("action"), (F.lit(100) + (F.col("page_id") % 5) * 100).cast("string").alias("status"))
    return p.select("page_id", X.web_vector(F.col("url"), ["shell.php"]).alias("vector"), X.request_outcome(F.col("action"), F.col("status")).alias("outcome"))


P24_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'web_exploit:sqli' WHEN 1 THEN 'web_exploit:rce' WHEN 2 THEN 'webshell' ELSE 'web_exploit' END AS vector,
  CASE WHEN page_id % 4 = 0 THEN 'blocked' WHEN page_id % 5 = 0 THEN 'unknown' WHEN page_id % 5 IN (1, 2) THEN 'success' ELSE 'failed' END AS outcome FROM pages"""


def p25(spark, d):
    e = evidence(spark, d).select("event_id", F.expr("CASE event_type WHEN 'view' THEN 'web_access_log' WHEN 'click' THEN 'host_exec' WHEN 'error' THEN 'dns_log' WHEN 'purchase' THEN 'host_connect' ELSE 'host_file_op' END").alias("asset_type"), "event_type",
                                  F.expr("IF(event_type = 'view', concat('/p/', user_id), NULL)").alias("url"), F.expr("IF(event_type = 'view', 'get', NULL)").alias("method"), F.expr("IF(event_type = 'view', k + 200, NULL)").alias("status"),
                                  F.expr("IF(event_type = 'click', concat('ls  -l ', k), NULL)").alias("command"), F.expr("IF(event_type = 'error', concat('d', k, '.x'), NULL)").alias("query"),
                                  F.expr("IF(event_type = 'purchase', '10.0.0.1', NULL)").alias("dst_ip"), F.expr("IF(event_type = 'purchase', k, NULL)").alias("dst_port"), F.expr("IF(event_type = 'signup', '/etc/x', NULL)").alias("path"))
    return e.select("event_id", N.raw_behavior(e).alias("behavior"))


P25_SQL = f"""WITH {EV} SELECT event_id, CASE event_type WHEN 'view' THEN 'GET /p/' || user_id || ' status=' || (k + 200) WHEN 'click' THEN 'ls -l ' || k WHEN 'error' THEN 'dns d' || k || '.x'
  WHEN 'purchase' THEN 'connect 10.0.0.1:' || k ELSE 'signup /etc/x' END AS behavior FROM ev"""


def p26(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.expr("concat('run --password=', source, ' --api-key ', doc_id, ' sshpass -p pw', doc_id, ' http://u:p', doc_id, '@h/ Authorization: Bearer t', doc_id, ' ', text)").alias("cmd"))
    argv = F.array(F.lit("sshpass"), F.lit("-p"), F.col("doc_id").cast("string"), F.lit("--token"), F.col("doc_id").cast("string"), F.lit("x"))
    return t.select("doc_id", X.redact_command(F.col("cmd")).alias("clean"), F.array_join(X.redact_argv(argv), " ").alias("argv"))


P26_SQL = """SELECT doc_id, 'run --password=[REDACTED] --api-key [REDACTED] sshpass -p [REDACTED] http://u:[REDACTED]@h/ Authorization: Bearer [REDACTED] ' || text AS clean,
  'sshpass -p [REDACTED] --token [REDACTED] x' AS argv FROM documents"""
#: No document of the tables holds a secret of its own; a fixture covers those.


def p27(spark, d):
    e = evidence(spark, d).withColumn("cmd", F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("run "), S("k"))))
    return e.select("event_id", X.behavior_fingerprint(b"secret-key", ["exec", "device-1"], F.col("host"), F.col("event_type"), F.col("cmd")).alias("fp"))


def _pad(b):
    return "".join(f"\\x{x ^ b:02X}" for x in b"secret-key".ljust(64, b"\0"))


P27_SQL = f"""WITH {EV} SELECT event_id, CASE WHEN k % 5 > 0 THEN sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode('exec') || '\\x00'::BLOB || encode('device-1') || '\\x00'::BLOB
  || encode('["' || host || '","' || event_type || '","run ' || k || '"]')))) END AS fp FROM ev"""


def p28(spark, d):
    e = evidence(spark, d).select("event_id", F.expr(CODES).alias("event_code"), (F.col("k") % 2 == 0).alias("is_sysmon"),
                                  F.expr("map('NewProcessName', 'C:\\\\w\\\\cmd.exe', 'NewProcessId', concat('0x', lower(hex(k))), 'Image', concat('D:\\\\t\\\\p', k, '.exe'), 'ProcessId', '77', 'TargetFilename', 'x.txt', 'DestinationIp', '10.0.0.9', 'User', host)").alias("data"))
    return P.windows_evidence(e, ["p4.exe"]).select("event_id", "asset_type", "event_type", "comm", "pid", "command_line", "dst_ip", "path", "action", "user")


P28_SQL = f"""WITH {EV}, c AS (SELECT *, {CODES_SQL} AS code FROM ev)
SELECT event_id, CASE WHEN code IN (4688, 1) THEN 'host_exec' WHEN code = 3 THEN 'host_connect' ELSE 'host_file_op' END AS asset_type,
  CASE WHEN code IN (4688, 1) THEN 'exec' WHEN code = 3 THEN 'active_connect' ELSE 'file_op' END AS event_type,
  CASE WHEN code = 4688 THEN 'cmd.exe' ELSE 'p' || k || '.exe' END AS comm, CASE WHEN code = 4688 THEN k::VARCHAR ELSE '77' END AS pid,
  CASE WHEN code = 4688 THEN 'C:\\w\\cmd.exe' WHEN code = 1 THEN 'D:\\t\\p' || k || '.exe' END AS command_line, CASE WHEN code = 3 THEN '10.0.0.9' END AS dst_ip,
  CASE WHEN code IN (11, 23) THEN 'x.txt' END AS path, CASE WHEN code = 11 THEN 'create' WHEN code = 23 THEN 'delete' END AS action, CASE WHEN code <> 4688 THEN host END AS "user"
FROM c WHERE code = 4688 OR (code IN (1, 3, 11, 23) AND k % 2 = 0 AND k <> 4)"""

CHECKS = {
    "P01_apply_aliases": (p01, P01_SQL), "P02_normalize_ip": (p02, P02_SQL), "P03_normalize_timestamp": (p03, P03_SQL),
    "P04_mask_columns": (p04, P04_SQL), "P05_evidence_id": (p05, P05_SQL), "P06_canonicalize_host": (p06, P06_SQL),
    "P07_normalize_events": (p07, P07_SQL), "P08_flatten_json_fields": (p08, P08_SQL), "P08_flatten_json_long": (p08_long, P08L_SQL),
    "P09_parse_log_table": (p09, P09_SQL), "P09_parse_json_lines": (p09_json, P09J_SQL), "P10_syslog_to_risk_events": (p10, P10_SQL),
    "P11_winevent_to_risk_events": (p11, P11_SQL), "P12_parse_kv_records": (p12, P12_SQL), "P13_decode_payload": (p13, P13_SQL),
    "P14_derive_waf_victim": (p14, P14_SQL), "P15_normalize_url": (p15, P15_SQL), "P16_extract_ips": (p16, P16_SQL),
    "P17_extract_ssh_targets": (p17, P17_SQL), "P18_command_fingerprint": (p18, P18_SQL), "P19_dns_features": (p19, P19_SQL),
    "P20_syslog_to_ssh_auth": (p20, P20_SQL), "P20_failed_logins": (p20_failed, P20F_SQL), "P21_repair_events": (p21, P21_SQL), "P22_exec_context_flags": (p22, P22_SQL),
    "P23_ip_class_tags": (p23, P23_SQL), "P24_web_vector": (p24, P24_SQL), "P25_raw_behavior": (p25, P25_SQL),
    "P26_redact_secrets": (p26, P26_SQL), "P27_behavior_fingerprint": (p27, P27_SQL), "P28_classify_windows_evidence": (p28, P28_SQL),
}
