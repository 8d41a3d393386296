"""Is this alert an attack, and did it work?

All alerts go through as one table; host and gateway evidence joins on equal
keys and time blocks, so a batch of a million alerts is one plan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import gateway as G, predicates as Q, rollups as A, rules as R
from ..session import cut_lineage


def review_alerts(alerts: DataFrame, requests: DataFrame, host_rows: DataFrame, profiles: DataFrame, types: dict, false_positives: dict, start_us: int, end_us: int,
                  ceiling: float = 0.95, generic_rules=(), hint_minutes: int = 10, tight_sec: int = 60, context_min: int = 10, before_min: int = 5, after_min: int = 30, miss: dict | None = None, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, misses). ``alerts`` adds payload, text, rule_name, rule_id and url to the gateway columns.

    Order: attack type and layer 1, host success, upgrade, outcome, gateway
    coverage and hint, confidence, action, address guard. Misses are sought in
    requests from ``start_us`` to ``end_us``. ``scope`` names a column of alerts
    and requests that tells investigations apart: a critical miss lifts open
    alerts of its own scope only; without it the call is one investigation.
    """
    d = alerts.withColumn("__t", R.attack_type(F.col("text"), F.col("rule_name"), types)).select("*", "__t.attack_type", "__t.matched").drop("__t")
    d = R.layer1_verdict(d, Q.false_positive_reason(d, false_positives), generic_rules)
    inside = requests.where(F.col("us").between(start_us, end_us))
    misses = cut_lineage(G.gateway_misses(inside, alerts, **(miss or {"patterns": [p for t in types.values() for p in t["patterns"]]})))
    critical = misses.where("severity = 'critical'")
    d = d.join(G.success_evidence(alerts, requests, host_rows, context_min, before_min, after_min), "alert_id", "left")
    if scope is None:
        d = d.withColumn("__crit", critical.agg(F.count(F.lit(1)).alias("__crit")).scalar())
    else:
        per = critical.join(inside.select("evidence_id", F.col(scope).alias("__scope")), "evidence_id").groupBy("__scope").agg(F.count(F.lit(1)).alias("__crit"))
        d = d.join(per, F.col(scope) == F.col("__scope"), "left").drop("__scope").withColumn("__crit", F.coalesce("__crit", F.lit(0)))
    has_host = F.lit(not host_rows.isEmpty())
    first = R.layer2_outcome(d, F.coalesce("success", F.lit(False)), has_host)
    up = R.upgrade_verdict(first, F.coalesce("success", F.lit(False)), F.col("__crit")).drop("attack_outcome")
    d = R.layer2_outcome(up, F.coalesce("success", F.lit(False)), has_host)
    cov = G.gateway_coverage(alerts, requests, start_us, end_us, tight_sec).select("alert_id", "coverage")
    d = cut_lineage(d)
    asked = alerts.drop("attack_success").join(d.select("alert_id", (F.col("attack_outcome") == "success_confirmed").alias("attack_success")), "alert_id")
    hint = G.success_hint(asked, requests, hint_minutes, patterns=[p for t in types.values() for p in t["patterns"]]).select("alert_id", F.col("level").alias("hint_level"), F.col("evidence_ref").alias("hint_ref"))
    d = cut_lineage(d.join(cov, "alert_id", "left").join(hint, "alert_id", "left").join(A.repeat_count(alerts), ["src_ip", "rule_id"], "left"))
    d = R.alert_action(R.alert_confidence(d, F.lit(ceiling)), F.coalesce("repeats", F.lit(1)), F.col("hint_level"))
    return R.ip_block_guard(d, profiles).drop("__crit", "repeats"), misses
