"""What a source holds and what an investigation needs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import any_of, first_match
from .blocks import numbered
from .parsing import BUILTIN_PARSERS
from .rollups import first_rows
from .windows import dedupe_first

SAMPLE = 50


def _starts(pattern: str) -> str:
    import re

    return "^(?:" + re.sub(r"\(\?P<[A-Za-z0-9_]+>", "(?:", pattern) + ")"


def discover_format(lines: DataFrame, source: str, order: list[str], line: str) -> DataFrame:
    """Format per source by the votes of its first 50 lines.

    json_lines needs half of the lines, syslog_auth and nginx_combined a third
    (at least one each); the number of all lines is what counts, as a fixed rule.
    """
    total = lines.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    s = F.trim(F.col(line))
    is_json = F.coalesce(s.startswith("{") & s.endswith("}") & F.json_object_keys(s).isNotNull(), F.lit(False))
    head = first_rows(lines, [source], order, SAMPLE)
    v = head.groupBy(source).agg(F.count_if(is_json).alias("json"), F.count_if(~is_json & s.rlike(_starts(BUILTIN_PARSERS["auth"]["line_regex"]))).alias("auth"),
                                 F.count_if(~is_json & s.rlike(_starts(BUILTIN_PARSERS["nginx_combined"]["line_regex"]))).alias("nginx"))
    need = lambda k: F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return total.join(v, source).select(source, "n", first_match((F.col("json") >= need(2), "json_lines"), (F.col("auth") >= need(3), "syslog_auth"), (F.col("nginx") >= need(3), "nginx_combined"), default="text_unknown").alias("format"))


def profile_keys(lines: DataFrame, group: list[str], line: str) -> DataFrame:
    """How often each top-level JSON key occurs; other lines do not count."""
    s = F.when(F.trim(F.col(line)).startswith("{"), F.col(line))
    return lines.select(*group, F.explode(F.json_object_keys(s)).alias("key")).groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n"))


# Fixed values (A14): canonical field and the names it often has at the source.
SYNONYMS = {
    "src_ip": ("client_ip", "remote_addr", "remoteHost", "remote_ip", "ip", "source_ip", "c-ip"), "timestamp": ("@timestamp", "__time__", "time", "ts", "event_time", "log_time"),
    "url": ("request_uri", "uri", "path", "request_url", "http_url"), "host": ("hostname", "server", "dst_host", "machine"), "user": ("username", "account", "login_user"),
    "result": ("status", "auth_result", "login_result"), "action": ("rule_action", "waf_action", "disposition"), "command": ("cmd", "argv", "process_cmd", "exec_command"),
    "dst_ip": ("dest_ip", "destination_ip", "target_ip"),
}


def suggest_aliases(keys: DataFrame, canonical: list[str], existing: dict[str, str] | None = None, synonyms: dict | None = None) -> DataFrame:
    """(key, alias_of) proposals: the synonym table first, then names that contain one another."""
    existing, table = existing or {}, synonyms or SYNONYMS
    pairs = [(s, c) for c in canonical for s in table.get(c, ()) if s not in existing]
    spark = keys.sparkSession
    syn = spark.createDataFrame(pairs or [("", "")], "key string, __c string").groupBy("key").agg(F.max("__c").alias("__c"))
    low = F.lower("key")
    near = F.get(F.filter(F.array(*[F.lit(c) for c in canonical]), lambda c: low.contains(c) | c.contains(low)), F.lit(0))
    skip = F.col("key").isin(*canonical, *existing.values(), "")
    d = keys.select("key").distinct().join(syn, "key", "left")
    return d.select("key", F.coalesce("__c", F.when(~skip, near)).alias("alias_of")).where("alias_of IS NOT NULL")


def field_gaps(present: DataFrame, requirements: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Required fields that a type lacks after aliasing: (asset_type, level, field).

    ``present``: asset_type, field. ``requirements``: asset_type, level, field.
    The evidence id is made by us and never missing.
    """
    names = F.create_map(*[v for s, t in (aliases or {"": ""}).items() for v in (F.lit(s), F.lit(t))])
    have = present.select("asset_type", F.explode(F.array_compact(F.array(F.col("field"), names[F.col("field")]))).alias("field")).distinct()
    return requirements.where("field <> 'evidence_id'").join(have, ["asset_type", "field"], "left_anti").select("asset_type", "level", "field")


def field_coverage(present: DataFrame, requirements: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Per type: is everything required there, and what is missing (sorted)."""
    gaps = field_gaps(present, requirements.where("level = 'required'"), aliases)
    return requirements.select("asset_type").distinct().join(gaps.groupBy("asset_type").agg(F.array_sort(F.collect_set("field")).alias("missing")), "asset_type", "left").select(
        "asset_type", F.col("missing").isNull().alias("ok"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def draft_parser(lines: DataFrame, source: str, order: list[str], line: str, sample: int = 20) -> DataFrame:
    """Named-group regex draft per source from the keys of its first ``key=value`` lines, in order of first sight."""
    head = first_rows(lines, [source], order, sample)
    keys = head.select(source, "__rn", F.posexplode(F.regexp_extract_all(F.col(line), F.lit(r"(?:^|\s)([A-Za-z_][A-Za-z0-9_]*)="), F.lit(1))).alias("i", "key"))
    first = keys.groupBy(source, "key").agg(F.min(F.struct("__rn", "i")).alias("o"))
    g = first.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("o", "key"))).alias("ks"))
    part = lambda k: F.concat(k["key"], F.lit("=(?P<"), k["key"], F.lit(">\"[^\"]*\"|\\S+)"))
    return g.select(source, F.concat(F.lit("^.*?"), F.array_join(F.transform("ks", part), ".*?"), F.lit(".*$")).alias("line_regex"), F.transform("ks", lambda k: k["key"]).alias("keys"))


# Fixed values (A17): zones that cover a hint fully or partly.
HINT_FULL = {"full": ("full",), "web_zone": ("web_zone", "web_hosts", "dmz"), "web_hosts": ("web_hosts", "web_zone"), "internal_ssh": ("internal_ssh", "internal"), "internal": ("internal", "internal_ssh"),
             "dmz_to_internal": ("dmz_to_internal",), "jump_hosts": ("jump_hosts", "internal", "internal_ssh"), "target_hosts": ("target_hosts", "internal", "internal_ssh")}
HINT_PARTIAL = {"web_zone": ("dmz_to_internal",), "web_hosts": ("web_zone", "partial_web"), "internal_ssh": ("partial_internal", "partial"), "internal": ("partial_internal", "partial"),
                "dmz_to_internal": ("dmz",), "jump_hosts": ("partial_internal", "partial", "web_zone"), "target_hosts": ("partial_internal", "partial")}


def coverage_hint(hint: Column, zones: Column, hosts: Column, investigated: list[str], apps: Column | None = None) -> Column:
    """full / partial / none: does the declared coverage fit the hint?

    Without investigated hosts any declared host covers and overlaps; with them
    the declared hosts must contain (or meet) them.
    """
    has = lambda z: F.array_contains(zones, z)
    hosts_any, zones_any = F.size(hosts) > 0, F.size(zones) > 0
    inv = F.array(*[F.lit(h) for h in investigated]) if investigated else None
    covers = hosts_any & (F.size(F.array_except(inv, hosts)) == 0) if investigated else hosts_any
    overlap = F.arrays_overlap(hosts, inv) if investigated else hosts_any
    table = lambda t: F.create_map(*[v for k, zs in t.items() for v in (F.lit(k), F.array(*[F.lit(z) for z in zs]))])
    zone_hit = lambda t: F.coalesce(F.arrays_overlap(zones, F.try_element_at(table(t), hint)), F.lit(False))
    web_zones = any_of(*[has(z) for z in HINT_FULL["web_zone"]])
    inside = has("internal") | has("internal_ssh")
    nothing = ~zones_any & ~hosts_any & (F.size(apps) == 0 if apps is not None else F.lit(True))
    web = first_match((has("web_hosts"), "full"), (covers & (has("web_zone") | ~zones_any), "full"), (hosts_any | web_zones, "partial"), default="none")
    # A listed target set is the boundary of the question, so broad zones do not widen it.
    listed = F.when(covers, "full").when(overlap, "partial").otherwise("none")
    target = first_match((hosts_any & F.lit(bool(investigated)), listed), (F.array_contains(zones, hint), "full"), (inside & overlap, "full"),
                         (zone_hit(HINT_PARTIAL) | inside, "partial"), default="none")
    return first_match((nothing, "none"), (hint == "any", "full"), (hint == "full", F.when(has("full"), "full").otherwise("none")), (hint == "web_hosts", web),
                       ((hint == "web_zone") & hosts_any & ~web_zones, "partial"), (hint.isin("jump_hosts", "target_hosts"), target),
                       (hint.isin("internal_ssh", "internal") & hosts_any, F.when(covers, "full").otherwise("partial")), (zone_hit(HINT_FULL), "full"), (zone_hit(HINT_PARTIAL), "partial"), default="none")


def evaluate_requirements(requirements: DataFrame, assets: DataFrame, span_days: int | None, investigated: list[str]) -> DataFrame:
    """Best registered asset per requirement: ready / partial / missing, with the gaps.

    ``requirements``: requirement_id, priority, asset_type, fields, hint (one row
    per accepted type). ``assets``: asset_id, asset_type, fields, zones, hosts,
    retention_days and, if there is one, apps. Ready needs all fields, full coverage and enough retention;
    the best status wins, then the smaller asset id. Where a ``match`` column says
    ``all``, the first asset of the (one) type decides, whatever its status.
    """
    j = requirements.withColumnRenamed("fields", "need").join(assets, "asset_type", "left")
    lack = F.array_sort(F.array_except("need", F.coalesce("fields", F.array().cast("array<string>"))))
    none = F.array().cast("array<string>")
    apps = F.coalesce("apps", none) if "apps" in assets.columns else None
    cov = coverage_hint(F.coalesce(F.trim("hint"), F.lit("any")), F.coalesce("zones", none), F.coalesce("hosts", none), investigated, apps)
    kept = F.lit(True) if span_days is None else F.coalesce(F.col("retention_days") >= span_days, F.lit(True))
    ready = (F.size(lack) == 0) & (cov == "full") & kept
    status = F.when(F.col("asset_id").isNull(), 2).when(ready, 0).otherwise(1)
    gaps = F.when(F.col("asset_id").isNull(), F.array(F.lit("not_registered"))).otherwise(F.concat(lack, F.array_compact(F.array(
        F.when(cov == "none", "coverage_none"), F.when(cov == "partial", "coverage_partial"), F.when(~kept, "retention_insufficient")))))
    row = F.struct("asset_id", gaps.alias("gaps"), status.alias("s"))
    g = j.groupBy("requirement_id", "priority").agg(F.min_by(row, F.struct(F.when(F.col("match") == "all", 0).otherwise(status) if "match" in requirements.columns else status, "asset_id")).alias("r"))
    return g.select("requirement_id", "priority", F.element_at(F.array(F.lit("ready"), F.lit("partial"), F.lit("missing")), F.col("r.s") + 1).alias("status"), "r.asset_id", "r.gaps")


def completeness_score(evaluated: DataFrame, group: list[str], key_score: float, time_score: float) -> DataFrame:
    """0.40 P0 ready + 0.35 (P1 ready + half of P1 partial) + 0.15 key + 0.10 time, within [0, 1], and the verdict."""
    n = lambda p, *s: F.count_if((F.col("priority") == p) & (F.col("status").isin(*s) if s else F.lit(True)))
    a = evaluated.groupBy(*group).agg(n("P0").alias("p0"), n("P0", "ready").alias("p0r"), n("P0", "missing").alias("p0m"), n("P1").alias("p1"), n("P1", "ready").alias("p1r"), n("P1", "partial").alias("p1p"))
    part0 = F.col("p0r") / F.greatest("p0", F.lit(1))
    part1 = (F.col("p1r") + 0.5 * F.col("p1p")) / F.greatest("p1", F.lit(1))
    score = F.round(F.least(F.greatest(0.40 * part0 + 0.35 * part1 + F.lit(0.15 * key_score + 0.10 * time_score), F.lit(0.0)), F.lit(1.0)), 2)
    verdict = first_match((F.col("p0m") > 0, "not_traceable"), ((F.col("p1") > 0) & (part1 >= 0.8), "full_traceable"), default="partial_traceable")
    return a.select(*group, score.alias("score"), verdict.alias("verdict"))


WEB_TYPES = ("waf_alert", "web_access_log")
HOST_TYPES = ("host_exec", "host_connect", "host_file_op", "host_persistence", "edr_event")


def breach_confirmable(scored: DataFrame, assets: DataFrame, scenarios: list[str]) -> DataFrame:
    """Final verdict and ``can_confirm_breach`` from the registered asset types.

    Alert scenario without any host data: only triage is possible. A breach can
    be confirmed in a breach scenario with web and host data and a traceable verdict.
    """
    have = lambda types: assets.agg(F.coalesce(F.bool_or(F.col("asset_type").isin(*types)), F.lit(False))).scalar()
    d = scored.withColumns({"__web": have(WEB_TYPES), "__host": have(HOST_TYPES)})
    triage = F.lit("S4" in scenarios) & ~F.col("__host") & F.col("__web") & (F.col("verdict") != "not_traceable")
    d = d.withColumn("verdict", F.when(triage, "alert_triage_only").otherwise(F.col("verdict")))
    ok = F.lit(bool({"S1", "S2", "S4"} & set(scenarios))) & F.col("__web") & F.col("__host") & F.col("verdict").isin("full_traceable", "partial_traceable")
    return d.withColumn("can_confirm_breach", ok).drop("__web", "__host")


def correlation_key_score(assets: DataFrame, allowed: DataFrame) -> DataFrame:
    """1.0 / 0.7 / 0.4 by the number of correlation keys some asset offers (4, 3, fewer).

    ``assets``: asset_type, correlation_key. ``allowed``: asset_type, correlation_key.
    """
    n = assets.join(allowed, ["asset_type", "correlation_key"], "left_semi").agg(F.count_distinct("correlation_key").alias("n"))
    return n.select("n", F.when(F.col("n") >= 4, 1.0).when(F.col("n") >= 3, 0.7).otherwise(0.4).alias("key_score"))


def source_coverage(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """available / degraded / unavailable per rule, by the sources that have rows.

    ``counts``: source, n. ``rules``: rule_id, source, role (primary / auxiliary).
    """
    d = rules.join(counts, "source", "left").withColumn("__ok", F.coalesce("n", F.lit(0)) > 0)
    g = d.groupBy("rule_id").agg(F.bool_and(F.when(F.col("role") == "primary", F.col("__ok")).otherwise(True)).alias("p"), F.bool_and(F.when(F.col("role") == "auxiliary", F.col("__ok")).otherwise(True)).alias("a"),
                                 F.array_sort(F.collect_set(F.when(~F.col("__ok"), F.col("source")))).alias("missing_sources"))
    return g.select("rule_id", F.when(~F.col("p"), "unavailable").when(~F.col("a"), "degraded").otherwise("available").alias("status"), "missing_sources")


def coverage_level(counts: DataFrame, scenario: DataFrame) -> DataFrame:
    """full / partial / insufficient per scenario; ``scenario``: scenario, source, role (required / recommended)."""
    d = scenario.join(counts, "source", "left").withColumn("__ok", F.coalesce("n", F.lit(0)) > 0)
    g = d.groupBy("scenario").agg(F.bool_and((F.col("role") != "required") | F.col("__ok")).alias("q"), F.bool_and((F.col("role") != "recommended") | F.col("__ok")).alias("r"))
    return g.select("scenario", F.when(~F.col("q"), "insufficient").when(F.col("r"), "full").otherwise("partial").alias("level"))


def recommendations(missing: DataFrame, label: str, priority: str, seq: str) -> DataFrame:
    """First entry per label by (priority, ``seq``), with its overall ``position``.

    The position is the count of the better priorities plus the number within
    the own one, which is taken block by block over ``seq``.
    """
    d = dedupe_first(missing, [label], [F.col(priority), F.col(seq)])
    # One entry per priority level, read as a short array.
    sizes = d.groupBy(priority).agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct(F.col(priority).alias("p"), "n"))).scalar()
    before = F.aggregate(F.filter("__sizes", lambda x: x["p"] < F.col(priority)), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return (numbered(d, [priority], seq, [F.col(seq)], "__rn", 10_000).withColumn("__sizes", sizes)
            .withColumn("position", before + F.col("__rn")).drop("__sizes", "__rn"))


def correlation_keys(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Keys of the join catalogue that an asset's fields offer: ordered list per asset.

    ``wanted``: asset_type, key, position. ``available``: asset_id, asset_type, key.
    """
    j = available.join(wanted, ["asset_type", "key"]).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "key"))), lambda s: s["key"]).alias("correlation_keys"))
    return available.select("asset_id").distinct().join(j, "asset_id", "left").withColumn("correlation_keys", F.coalesce("correlation_keys", F.array().cast("array<string>")))


def missing_sources(declared: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Declared but never attempted or registered."""
    return declared.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")
