"""Which hosts behave dangerously?

Evidence tables to risk items, items to incidents and a verdict. Each module
yields the same item columns; the union then goes through merge, policy,
whitelist, technique map and rollup as one lazy plan.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.common import digest, severity_rank
from ..operators import rollups as A, rules as R
from ..operators.bursts import burst_waves, tier_for_count
from ..operators.joins import related_in_window
from ..operators.normalize import Asset, normalize_events
from ..operators.predicates import split_rejects, strict_window
from ..operators.windows import dedupe_first
from ..session import cut_lineage
from ..sources.readers import scan_asset

ITEM = {"risk_id": "string", "risk_module": "string", "severity": "string", "confidence": "double", "verdict": "string", "recommended_action": "string", "host": "string", "us": "bigint",
        "listener_process": "string", "listener_pid": "string", "listener_port": "int", "command": "string", "src_ip": "string", "matched_rules": "array<string>", "risk_tags": "array<string>", "evidence_ref": "string", "summary": "string"}


def as_items(df: DataFrame, module: str) -> DataFrame:
    """The item columns of one module; missing ones are NULL, the id is a digest of module and evidence."""
    d = df.withColumn("risk_module", F.lit(module))
    if "risk_id" not in d.columns:
        d = d.withColumn("risk_id", digest(f"risk-{module}-", F.col("host"), F.col("evidence_ref")))
    return d.select(*[(F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()])


def _at_least(df: DataFrame, floor: str) -> DataFrame:
    return df.where(severity_rank(F.col("severity")) <= R.SEVERITY_RANK[floor])


def exec_items(execs: DataFrame, connects: DataFrame, files: DataFrame, persistence: DataFrame, pack: dict = R.EXEC_PACK, ceiling: float = 0.95, floor: str = "P2",
               window_sec: int = 300, persistence_sec: int = 600) -> DataFrame:
    """Risky commands. Tables: evidence_id, us, host, hosts (array), listener."""
    ok, _ = split_rejects(execs, ["host", "us", "command"], [("listener_port", "listener_process")])
    for name, table, sec in (("__conn", connects, window_sec), ("__file", files, window_sec), ("__pers", persistence, persistence_sec)):
        ok = related_in_window(ok, table, "evidence_id", "hosts", "listener", "us", sec, name)
    d = R.exec_rules(ok, pack, F.col("__conn"), F.col("__file") | F.col("__pers"))
    d = R.detection_output(_at_least(d, floor), pack, ceiling, F.col("__conn") | F.col("__file") | F.col("__pers"))
    return as_items(d.withColumns({"evidence_ref": F.col("evidence_id").cast("string"), "summary": F.left("command", F.lit(120))}), "exec")


def connect_items(connects: DataFrame, execs: DataFrame, pack: dict = R.CONNECT_PACK, ceiling: float = 0.95, floor: str = "P2", window_sec: int = 300) -> DataFrame:
    """Risky outgoing connections; a download command nearby counts."""
    ok, _ = split_rejects(connects, ["host", "us", "dst_ip", "dst_port"], [("listener_port", "listener_process")])
    d = related_in_window(ok, execs.where(F.col("command").rlike(R.DOWNLOAD_WORDS)), "evidence_id", "hosts", "listener", "us", window_sec, "__dl")
    d = related_in_window(d, execs, "evidence_id", "hosts", "listener", "us", window_sec, "__any")
    d = R.detection_output(_at_least(R.connect_rules(d, pack, F.col("__dl")), floor), pack, ceiling, F.col("__any"))
    return as_items(d.withColumns({"evidence_ref": F.col("evidence_id").cast("string"), "summary": F.concat_ws(":", "dst_ip", "dst_port")}), "connect")


def burst_items(waves: DataFrame, tiers=((10, "P0"), (5, "P2")), ceiling: float = 0.95, floor: str = "P2") -> DataFrame:
    """Login bursts, one item per wave."""
    d = waves.withColumn("severity", tier_for_count(F.col("fail_count"), tiers)).withColumn("matched_rules", F.array(F.lit("ssh_bruteforce")))
    d = _at_least(d, floor)
    conf = F.least(F.lit(ceiling), F.when(F.col("severity") == "P0", 0.9).otherwise(0.7))
    return as_items(d.select(F.col("victim_host").alias("host"), "src_ip", "severity", "matched_rules", conf.alias("confidence"), F.col("first_us").alias("us"),
                             F.when(F.col("severity") == "P0", "confirmed_attack").otherwise("suspicious").alias("verdict"), F.lit("block_ip").alias("recommended_action"), F.array(F.lit("bruteforce")).alias("risk_tags"),
                             F.concat_ws("-", F.lit("risk-ssh-brute"), "victim_host", "src_ip", F.concat(F.lit("w"), F.col("wave_index").cast("string"))).alias("risk_id"),
                             F.get("evidence_refs", F.lit(0)).cast("string").alias("evidence_ref"), F.concat_ws(" ", F.col("fail_count").cast("string"), F.lit("failures from"), "src_ip").alias("summary")), "ssh")


def rule_items(rows: DataFrame, module: str, pack: dict, ceiling: float = 0.95, floor: str = "P2") -> DataFrame:
    """Items of rows that a persistence, syslog or DNS pack has judged."""
    d = R.detection_output(_at_least(rows, floor), pack, ceiling)
    return as_items(d.withColumn("evidence_ref", F.col("evidence_id").cast("string")), module)


def persistence_items(rows: DataFrame, pack: dict = R.PERSISTENCE_PACK, ceiling: float = 0.95, floor: str = "P2") -> DataFrame:
    """Changes of what starts by itself. Tables: evidence_id, us, host, path, event_type, …"""
    return rule_items(R.condition_rules(rows, pack).withColumn("summary", F.col("path")), "persistence", pack, ceiling, floor)


def syslog_items(rows: DataFrame, pack: dict = R.SYSLOG_PACK, ceiling: float = 0.95, floor: str = "P2") -> DataFrame:
    """Messages of the system log that tell of misuse."""
    return rule_items(R.condition_rules(rows, pack, text_fields=("message",)).withColumn("summary", F.left("message", F.lit(120))), "syslog", pack, ceiling, floor)


def dns_items(rows: DataFrame, connects: DataFrame | None = None, ceiling: float = 0.95, floor: str = "P2") -> DataFrame:
    """Queries that look like tunnels or generated names, and connections that leave for an encrypted resolver."""
    pack = {"output": R.CONNECT_PACK["output"]}
    found = rule_items(R.dns_row_rules(rows).withColumn("summary", F.col("query")), "dns", pack, ceiling, floor)
    if connects is None:
        return found
    return found.unionByName(rule_items(R.dns_privacy_rules(connects).withColumn("summary", F.concat_ws(":", "dst_ip", "dst_port")), "dns", pack, ceiling, floor))


def host_risk(tables: dict[str, DataFrame], ceiling: float = 0.95, floor: str = "P2", exec_sec: int = 300, persistence_sec: int = 600, connect_sec: int = 300, **judging) -> DataFrame:
    """All modules over the evidence there is, as judged items.

    ``tables`` by evidence type; those that miss are skipped: host_exec,
    host_connect, host_file_op, host_persistence, syslog_risk_alert, dns_log,
    and the waves of ``burst_waves`` as ssh_waves.
    """
    have = lambda n: tables.get(n)
    first = next(iter(tables.values()))
    near = first.sparkSession.createDataFrame([], "evidence_id string, us bigint, host string, hosts array<string>, listener string")
    modules = []
    if have("host_exec") is not None:
        other = [tables.get(n, near) for n in ("host_connect", "host_file_op", "host_persistence")]
        modules.append(exec_items(tables["host_exec"], *other, ceiling=ceiling, floor=floor, window_sec=exec_sec, persistence_sec=persistence_sec))
    if have("host_connect") is not None:
        modules.append(connect_items(tables["host_connect"], tables.get("host_exec", near.withColumn("command", F.lit(None).cast("string"))), ceiling=ceiling, floor=floor, window_sec=connect_sec))
    for name, build in (("host_persistence", persistence_items), ("syslog_risk_alert", syslog_items)):
        if have(name) is not None:
            modules.append(build(tables[name], ceiling=ceiling, floor=floor))
    if have("dns_log") is not None:
        modules.append(dns_items(tables["dns_log"], tables.get("host_connect"), ceiling, floor))
    if have("ssh_waves") is not None:
        modules.append(burst_items(tables["ssh_waves"], ceiling=ceiling, floor=floor))
    return assess(modules, **judging)


def assess(modules: list[DataFrame], policy: dict | None = None, whitelist: list[dict] | None = None, rule_map: dict | None = None, tactics: dict | None = None) -> DataFrame:
    """Union of module items, merged, judged by policy before whitelist, mapped to techniques."""
    # The items are few against the evidence; written once, the merge can read them twice.
    items = cut_lineage(reduce(DataFrame.unionByName, modules))
    # The listener is told by its process id; its port stands in where there is none.
    pid, port = (F.when(~F.col(c).cast("string").isin("", "0"), F.col(c).cast("string")) for c in ("listener_pid", "listener_port"))
    merged = A.merge_items(items.withColumn("__ref", F.coalesce("evidence_ref", F.col("us").cast("string"), F.lit(""))).withColumn("__lp", F.coalesce(pid, port, F.lit(""))),
                           ["risk_module", "host", "__ref", "__lp"], "risk_id").drop("__ref", "__lp", "merged")
    d = R.whitelist(R.behavior_policy(merged, policy or {}), whitelist or [])
    return R.attack_techniques(d, rule_map or {}, {}, tactics or {"": ""})


def brute_force_incidents(spark: SparkSession, sf_dir: str, window_sec: int = 86_400, threshold: int = 3, start: str | None = None, end: str | None = None, top: int = 20) -> DataFrame:
    """The flagship question on the events table: who was brute-forced, ranked as incidents.

    Error events stand for failed logins: the user is the victim, the listener
    group of the event its source. ``start`` and ``end`` limit the time; None does not.
    """
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("huntspark_events")
    raw = scan_asset(spark, "SELECT event_id, ts, user_id, props FROM huntspark_events WHERE event_type = :kind", {"kind": "error"}, {})
    raw = raw.select("event_id", F.col("event_id").cast("string").alias("evidence_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("when"),
                     F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("hostname"), F.concat(F.lit("\"10.0.0."), (F.col("user_id") % 5).cast("string"), F.lit("\"")).alias("remote_addr"),
                     F.get_json_object("props", "$.k").alias("account"))
    raw = raw.withColumn("when", F.concat(F.substring("when", 1, 10), F.lit("."), F.substring("when", 11, 6)))
    asset = Asset("auth", "ssh_auth", "files", aliases={"remote_addr": "src_ip", "account": "user"}, time_field="when")
    ev = strict_window(normalize_events(raw, asset), "ts", start, end)
    ev = dedupe_first(ev.select("event_id", "evidence_id", F.unix_micros("ts").alias("us"), "host", "src_ip", "user"), ["evidence_id"], [F.col("us"), F.col("event_id")])
    # Normalised evidence is written once; the wave search reads it several times.
    ev = cut_lineage(ev)
    waves = burst_waves(ev, id_col="event_id", window_sec=window_sec, threshold=threshold)
    items = burst_items(waves, ((threshold + 2, "P0"), (threshold + 1, "P1"), (threshold, "P2")))
    judged = assess([items])
    found = A.incidents(judged, ["us", "risk_id"])
    return A.top_incidents(found, top).select("incident_id", "host", "risk_module", "src_ip", "severity", "alert_required", "event_count", "alert_count", "first_us", "last_us")
