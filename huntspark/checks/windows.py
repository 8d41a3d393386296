"""Ordered operators on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bursts, entries as E, windows as W
from .base import DAY, EV, HOUR, evidence


def _failures(spark, d):
    return evidence(spark, d).where("event_type = 'error'").select(
        "host", F.concat(F.lit("src-"), (F.col("user_id") % 5).cast("string")).alias("src_ip"), "us",
        F.col("event_id").alias("id"), F.concat(F.lit("u"), (F.col("k") % 4).cast("string")).alias("user"))


def w01(spark, d):
    w = bursts.burst_waves(_failures(spark, d), window_sec=86_400, threshold=3)
    return w.select("victim_host", "src_ip", F.col("wave_index").cast("bigint").alias("wave_index"), "fail_count",
                    F.array_join("users", ",").alias("users"), "first_us", "last_us",
                    F.array_join(F.transform("evidence_refs", lambda x: x.cast("string")), ",").alias("refs"),
                    bursts.tier_for_count(F.col("fail_count"), ((5, "P0"), (4, "P1"), (3, "P2"))).alias("severity"))


W01_SQL = f"""WITH RECURSIVE {EV}, f AS (
  SELECT host AS victim_host, 'src-' || (user_id % 5) AS src_ip, us, event_id AS id, 'u' || (k % 4) AS usr
  FROM ev WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY victim_host, src_ip ORDER BY us, id) AS rn,
  count(*) OVER (PARTITION BY victim_host, src_ip ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY}::BIGINT FOLLOWING) AS reach FROM f),
walk AS (
  SELECT victim_host, src_ip, rn, reach, us, CASE WHEN reach - rn + 1 >= 3 THEN 1 ELSE 0 END AS hit FROM r WHERE rn = 1
  UNION ALL
  SELECT n.victim_host, n.src_ip, n.rn, n.reach, n.us, CASE WHEN n.reach - n.rn + 1 >= 3 THEN 1 ELSE 0 END
  FROM walk w JOIN r n ON n.victim_host = w.victim_host AND n.src_ip = w.src_ip
   AND n.rn = CASE WHEN w.hit = 1 THEN w.reach + 1 ELSE w.rn + 1 END),
s AS (SELECT *, row_number() OVER (PARTITION BY victim_host, src_ip ORDER BY rn) AS wave_index FROM walk WHERE hit = 1)
SELECT s.victim_host, s.src_ip, s.wave_index, count(*) AS fail_count,
  string_agg(DISTINCT r.usr, ',' ORDER BY r.usr) AS users, min(r.us) AS first_us, max(r.us) AS last_us,
  string_agg(r.id::VARCHAR, ',' ORDER BY r.rn) FILTER (WHERE r.rn < s.rn + 20) AS refs,
  CASE WHEN count(*) >= 5 THEN 'P0' WHEN count(*) >= 4 THEN 'P1' ELSE 'P2' END AS severity
FROM s JOIN r ON r.victim_host = s.victim_host AND r.src_ip = s.src_ip AND r.rn BETWEEN s.rn AND s.reach
GROUP BY s.victim_host, s.src_ip, s.wave_index"""


def _replayed(spark, d):
    e = evidence(spark, d)
    key = F.when(F.col("k") % 10 == 0, "").otherwise(F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"), (F.col("k") % 3).cast("string")))
    return e.select("event_id", "us", key.alias("native_key"), "value")


REPLAYED = f"""{EV}, rep AS (SELECT event_id, us, CASE WHEN k % 10 = 0 THEN ''
  ELSE user_id || '/' || event_type || '/' || (k % 3) END AS native_key, value FROM ev)"""


def w02(spark, d):
    return W.dedupe_first(_replayed(spark, d), ["native_key"], [F.col("us"), F.col("event_id")])


W02_SQL = f"""WITH {REPLAYED} SELECT event_id, us, native_key, value FROM (SELECT *,
  row_number() OVER (PARTITION BY native_key ORDER BY us, event_id) AS rn FROM rep) WHERE rn = 1 OR native_key = ''"""


def w02_audit(spark, d):
    return W.duplicate_audit(_replayed(spark, d), ["native_key"], [F.col("us"), F.col("event_id")], "event_id")


W02A_SQL = f"""WITH {REPLAYED}, x AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY native_key ORDER BY us, event_id) AS retained_id
  FROM rep WHERE native_key <> '')
SELECT retained_id, event_id AS duplicate_id FROM x WHERE event_id <> retained_id"""


def w03(spark, d):
    e = evidence(spark, d)
    s = e.select(F.when(F.col("event_type") == "view", "web_access").otherwise("lateral_movement").alias("stage"),
                 F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source_host"),
                 F.concat(F.lit("h"), (F.col("k") % 15).cast("string")).alias("host"),
                 F.concat(F.lit("u"), (F.col("k") % 2).cast("string")).alias("user"),
                 F.when(F.col("event_type") == "purchase", "confirmed_lateral").when(F.col("event_type") == "click", "likely_lateral")
                 .otherwise("suspected_lateral").alias("lateral_class"), "us", "event_id")
    return W.dedupe_lateral(s, [F.col("us"), F.col("event_id")])


W03_SQL = f"""WITH {EV}, s AS (SELECT CASE WHEN event_type = 'view' THEN 'web_access' ELSE 'lateral_movement' END AS stage,
  's' || (user_id % 20) AS source_host, 'h' || (k % 15) AS host, 'u' || (k % 2) AS "user",
  CASE event_type WHEN 'purchase' THEN 'confirmed_lateral' WHEN 'click' THEN 'likely_lateral' ELSE 'suspected_lateral' END AS lateral_class,
  us, event_id FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY stage, source_host, host, lateral_class,
   CASE WHEN lateral_class = 'suspected_lateral' THEN "user" END ORDER BY us, event_id) AS rn FROM s)
SELECT stage, source_host, host, "user", lateral_class, us, event_id FROM n WHERE rn = 1 OR stage = 'web_access'"""


def w03_timeline(spark, d):
    e = evidence(spark, d).select(F.floor(F.col("us") / (6 * HOUR)).cast("bigint").alias("sec"), F.col("event_type").alias("stage"), "host", "event_id", "us")
    return W.dedupe_first(e, ["sec", "stage", "host"], [F.col("us"), F.col("event_id")])


W03T_SQL = f"""WITH {EV}, s AS (SELECT us // {6 * HOUR}::BIGINT AS sec, event_type AS stage, host, event_id, us FROM ev)
SELECT sec, stage, host, event_id, us FROM (SELECT *, row_number() OVER (PARTITION BY sec, stage, host ORDER BY us, event_id) AS rn FROM s) WHERE rn = 1"""


def w03_execution(spark, d):
    e = evidence(spark, d).select(F.col("event_type").alias("stage"), "host", (F.floor(F.col("us") / DAY) * 1_000_000 + F.col("k")).cast("bigint").alias("us"), F.array((F.col("k") % 2).cast("string"), F.lit("0")).alias("evidence_refs"), "event_id")
    return W.dedupe_execution(e, [F.col("us"), F.col("event_id")]).select("stage", "host", "us", "event_id")


W03E_SQL = f"""WITH {EV}, s AS (SELECT event_type AS stage, host, us // {DAY}::BIGINT * 1000000 + k AS us, us // {DAY}::BIGINT AS sec, k % 2 AS refs, event_id FROM ev)
SELECT stage, host, us, event_id FROM (SELECT *, row_number() OVER (PARTITION BY stage, host, sec, refs ORDER BY us, event_id) AS rn FROM s) WHERE rn = 1"""


def w03_logins(spark, d):
    e = evidence(spark, d).select("host", F.lit("s").alias("src_ip"), (F.floor(F.col("us") / DAY)).cast("bigint").alias("us"), F.expr("IF(k % 2 = 0, NULL, 'u')").alias("user"), F.expr("IF(k % 3 = 0, cast(event_id AS string), '')").alias("native_id"), "event_id")
    return W.dedupe_logins(e, [F.col("us"), F.col("event_id")]).select("host", "us", "event_id")


W03L_SQL = f"""WITH {EV} SELECT host, day AS us, event_id FROM (SELECT *, us // {DAY}::BIGINT AS day, row_number() OVER (PARTITION BY host, us // {DAY}::BIGINT, k % 2, CASE WHEN k % 3 = 0 THEN event_id END ORDER BY event_id) AS rn FROM ev) WHERE rn = 1"""


def w04(spark, d):
    e = evidence(spark, d).select("event_id", "us", "user_id", "event_type")
    return W.sliding_rate(e, ["user_id", "event_type"], "us", "event_id", F.lit(3), slot_sec=3600, slots=61, hold_sec=36_000)


W04_SQL = f"""WITH {EV}, r AS (SELECT a.event_id, a.us, a.user_id, a.event_type, count(*) AS rate
  FROM ev a JOIN ev b ON a.user_id = b.user_id AND a.event_type = b.event_type
   AND b.us // {HOUR}::BIGINT >= a.us // {HOUR}::BIGINT - 60 AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id))
  GROUP BY ALL),
p AS (SELECT *, max(CASE WHEN rate > 3 THEN us END) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r)
SELECT event_id, us, user_id, event_type, rate, rate > 3 AS anomaly,
  rate > 3 AND (prev IS NULL OR us > prev + {10 * HOUR}::BIGINT) AS anomaly_start,
  rate > 3 OR coalesce(us <= prev + {10 * HOUR}::BIGINT, false) AS held FROM p"""


def w05(spark, d):
    e = evidence(spark, d).select("event_id", "us", "user_id", "event_type")
    return W.rolling_admission(e, ["user_id", "event_type"], "us", "event_id", 5, 72 * 3600)


W05_SQL = f"""WITH {EV}, r AS (SELECT event_id, us, user_id, event_type, row_number() OVER w AS rn, lag(us, 4) OVER w AS b FROM ev
  WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)),
a AS (SELECT user_id, event_type, min(rn) AS arn, min(us) AS aus FROM r WHERE us - b <= {72 * HOUR}::BIGINT GROUP BY ALL)
SELECT r.event_id, r.us, r.user_id, r.event_type, aus AS admitted_us,
  CASE WHEN rn >= arn THEN 'suppress' ELSE 'emit' END AS decision
FROM r LEFT JOIN a ON r.user_id = a.user_id AND r.event_type = a.event_type"""

T0 = 1_704_067_200_000_000  # 2024-01-01


def w06(spark, d):
    e = evidence(spark, d).where("event_type IN ('view', 'click', 'error')")
    outcome = F.when(F.col("value") >= 20, 0).when(F.col("value") >= 10, 1).otherwise(2)
    vector = F.when(F.col("k") % 4 == 0, 0).when(F.col("k") % 4 == 1, 1).otherwise(2)
    return (W.best_entry(e.withColumn("outcome_rank", outcome).withColumn("vector_rank", vector), ["host"],
                         [F.col("outcome_rank"), F.col("vector_rank")], "us", "event_id")
            .select("host", "us", "event_id", F.col("outcome_rank").cast("bigint").alias("outcome_rank"),
                    F.col("vector_rank").cast("bigint").alias("vector_rank")))


W06_SQL = f"""WITH {EV}, c AS (SELECT host, us, event_id, CASE WHEN value >= 20 THEN 0 WHEN value >= 10 THEN 1 ELSE 2 END::BIGINT AS outcome_rank,
  CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS vector_rank FROM ev WHERE event_type IN ('view', 'click', 'error'))
SELECT host, us, event_id, outcome_rank, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY host
  ORDER BY outcome_rank, vector_rank, us, event_id) AS rn FROM c) WHERE rn = 1"""


def w07(spark, d):
    e = evidence(spark, d)
    out = W.narrow_window(e, (F.col("user_id") == 3) & (F.col("event_type") == "error"), "us", T0, T0 + 25 * DAY, DAY)
    return out.select("event_id", "us", F.col("from_us").cast("bigint").alias("from_us"), F.col("to_us").cast("bigint").alias("to_us"))


W07_SQL = f"""WITH {EV}, i AS (SELECT * FROM ev WHERE us BETWEEN {T0} AND {T0 + 25 * DAY}),
b AS (SELECT greatest({T0}, coalesce(min(us) - {DAY}, {T0})) AS from_us, least({T0 + 25 * DAY}, coalesce(max(us) + {DAY}, {T0 + 25 * DAY})) AS to_us
  FROM i WHERE user_id = 3 AND event_type = 'error')
SELECT event_id, us, from_us, to_us FROM i, b WHERE us BETWEEN from_us AND to_us"""


def w08(spark, d):
    e = evidence(spark, d).withColumn("given", F.when(F.col("k") % 3 == 0, F.concat(F.lit("id-"), F.col("event_id").cast("string"))))
    return W.sequence_refs(e, "event_type", "us", "event_id", F.col("given")).select("event_id", "event_type", "ref")


W08_SQL = f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS rn FROM ev)
SELECT event_id, event_type, CASE WHEN k % 3 = 0 THEN 'id-' || event_id
  ELSE event_type || '-' || CASE WHEN rn < 10000 THEN lpad(rn::VARCHAR, 4, '0') ELSE rn::VARCHAR END END AS ref FROM n"""


def w09(spark, d):
    e = evidence(spark, d).select("event_id", "us", "user_id", "k")
    return W.counter_delta(e, ["user_id"], "us", "event_id", F.col("k")).select("event_id", "user_id", "delta")


W09_SQL = f"""WITH {EV}, l AS (SELECT event_id, user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM ev)
SELECT event_id, user_id, CASE WHEN p IS NULL THEN NULL WHEN k >= p THEN k - p ELSE k END AS delta FROM l"""

URLS = ("/s.php?cmd=id", "/a?id=1 union select 2", "/up/shell.php", "/x")


def w06_access(spark, d):
    """Entry of every host: the best request by outcome, vector and time, else the first command of its web process."""
    e = evidence(spark, d)
    url = F.element_at(F.array(*[F.lit(u) for u in URLS]), (F.col("k") % 4 + 1).cast("int"))
    web = e.where("event_type = 'view' AND user_id % 3 > 0").select(F.col("event_id").alias("evidence_id"), "us", "host", url.alias("url"), F.expr("IF(k % 7 = 0, 'blocked', '')").alias("action"),
                                                                   F.expr("CASE WHEN k % 5 > 2 THEN 404 WHEN k % 5 = 2 THEN 200 END").alias("status"))
    ex = e.where("event_type = 'click'").select(F.col("event_id").alias("evidence_id"), "us", "host", F.expr("IF(k % 5 = 0, 'cat uploads/x', 'id')").alias("command"), (F.col("k") % 2 == 0).alias("web"))
    return E.initial_access(web, ex, ["host"], ["shell.php", "php"], F.col("web"), start_us=T0 + 5 * DAY, end_us=T0 + 15 * DAY)


W06A_SQL = f"""WITH {EV}, w AS (SELECT * FROM ev WHERE us BETWEEN {T0 + 5 * DAY} AND {T0 + 15 * DAY}),
q AS (SELECT host, us, event_id, CASE WHEN k % 7 = 0 THEN 'blocked' WHEN k % 5 > 2 THEN 'failed' WHEN k % 5 = 2 THEN 'success' ELSE 'unknown' END AS outcome, k % 4 AS c FROM w WHERE event_type = 'view' AND user_id % 3 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE outcome WHEN 'success' THEN 0 WHEN 'unknown' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END, c, us, event_id) AS rn FROM q),
x AS (SELECT host, us, event_id, CASE WHEN k % 5 = 0 THEN 'webshell' ELSE 'web_exploit:rce' END AS vector, row_number() OVER (PARTITION BY host ORDER BY us, event_id) AS rn FROM w WHERE event_type = 'click' AND k % 2 = 0)
SELECT host, us, event_id AS evidence_id, ['web_exploit:rce', 'web_exploit:sqli', 'webshell', 'web_exploit'][c + 1] AS vector, outcome, ['compromise_trigger', 'compromise_trigger', 'observed_control_point', 'suspicious_request'][c + 1] AS role, 'web' AS source FROM r WHERE rn = 1
UNION ALL SELECT host, us, event_id, vector, NULL, 'compromise_trigger', 'exec' FROM x WHERE rn = 1 AND host NOT IN (SELECT host FROM r)"""

CHECKS = {
    "W01_burst_waves": (w01, W01_SQL),
    "W02_dedupe_first": (w02, W02_SQL),
    "W02_duplicate_audit": (w02_audit, W02A_SQL),
    "W03_stage_dedupe": (w03, W03_SQL),
    "W03_timeline_dedupe": (w03_timeline, W03T_SQL),
    "W03_execution_dedupe": (w03_execution, W03E_SQL), "W03_login_dedupe": (w03_logins, W03L_SQL),
    "W04_sliding_rate": (w04, W04_SQL),
    "W05_rolling_admission": (w05, W05_SQL),
    "W06_initial_access": (w06, W06_SQL), "W06_entry_points": (w06_access, W06A_SQL),
    "W07_narrow_window": (w07, W07_SQL),
    "W08_evidence_refs": (w08, W08_SQL),
    "W09_counter_delta": (w09, W09_SQL),
}
