"""Aggregations and report heads."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.common import first_match, severity_name, severity_rank
from ..functions.net import network_tag, normalize_ip


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per key. The limit runs before the shuffle too, so a
    hot key sends at most ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)


def first_ids(df: DataFrame, keys: list[str], order: list, id_col: str, n: int, out: str = "evidence_refs") -> DataFrame:
    """Keys and the array of the first ``n`` ids by ``order``."""
    top = first_rows(df, keys, order, n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.col(id_col).alias("__id")))), lambda s: s["__id"]).alias(out))


def with_first_ids(agg: DataFrame, df: DataFrame, keys: list[str], order: list, id_col: str, n: int, out: str = "evidence_refs") -> DataFrame:
    """``agg`` (one row per key) plus the first ids; keys may be NULL."""
    ids = first_ids(df, keys, order, id_col, n, out).select(*[F.col(k).alias(f"__k_{k}") for k in keys], out)
    cond = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = test if cond is None else cond & test
    return agg.join(ids, cond, "left").drop(*[f"__k_{k}" for k in keys])


def nxdomain_rollup(events: DataFrame, client: str = "client_ip", query: str = "query", us: str = "us", id_col: str = "event_id",
                    tiers=((30, "P1"), (10, "P2")), max_refs: int = 20, approximate: bool = False) -> DataFrame:
    """Failed lookups per client over the whole scope: counts, tier, first time, first refs.

    Order for the references: time, id. ``approximate`` counts distinct
    queries with a sketch.
    """
    d = events.withColumn(client, F.coalesce(F.col(client), F.lit("unknown")))
    distinct = F.approx_count_distinct(query) if approximate else F.count_distinct(F.col(query))
    agg = d.groupBy(client).agg(F.count(F.lit(1)).alias("query_count"), distinct.alias("unique_queries"), F.min(us).alias("first_us"))
    agg = agg.withColumn("severity", first_match(*[(F.col("query_count") >= m, s) for m, s in sorted(tiers, reverse=True)], default="P3"))
    return with_first_ids(agg, d, [client], [us, id_col], id_col, max_refs)


def _alerting(df: DataFrame) -> Column:
    have = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in df.columns else F.lit(d)
    return have("alert_required", True) & ~have("alert_suppressed", False)


SIGNATURE = ("host", "risk_module", "rule_hint", "listener_process", "listener_port", "command", "src_ip")


def incidents(items: DataFrame, order: list[str], id_col: str = "risk_id", alerting_only: bool = False) -> DataFrame:
    """Risk items to incidents by the seven-part signature.

    Signature: host, module, policy rule (else first matched rule), listener,
    port, command fingerprint, source. The representative is the first alerting
    item by ``order``, else the first item; the severity is the worst of the
    alerting items, else of all. Five sample ids, in order.
    """
    have = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in items.columns else F.lit("")
    first_rule = F.coalesce(F.get("matched_rules", F.lit(0)), F.lit("")) if "matched_rules" in items.columns else F.lit("")
    hint = F.when(have("policy_rule_id") != "", have("policy_rule_id")).otherwise(first_rule)
    parts = {"host": have("host"), "risk_module": have("risk_module"), "rule_hint": hint, "listener_process": have("listener_process"), "listener_port": have("listener_port"),
             "command": X.command_fingerprint(have("command")), "src_ip": have("src_ip")}
    d = items.select(*[c for c in items.columns if c not in parts], *[c.alias(n) for n, c in parts.items()])
    d = d.withColumn("__a", _alerting(items)).withColumn("__rank", severity_rank(F.col("severity")))
    keys = list(SIGNATURE)
    pos = F.struct(~F.col("__a"), *order)
    rep = F.struct(*[F.col(c) for c in ("summary", "policy_rule_id", id_col) if c in d.columns])
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.count_if("__a").alias("alert_count"), F.min(F.when(F.col("__a"), F.col("__rank"))).alias("__ra"),
                               F.min("__rank").alias("__r"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by(rep, pos).alias("representative"))
    agg = agg.withColumn("severity", severity_name(F.least(F.coalesce("__ra", "__r"), F.lit(3)))).withColumn("alert_required", F.col("alert_count") > 0).drop("__ra", "__r")
    if alerting_only:
        agg = agg.where("alert_required")
    out = with_first_ids(agg, d, keys, order, id_col, 5, "sample_ids")
    return out.withColumn("incident_id", F.concat(F.lit("incident-"), F.left(F.sha2(F.concat_ws("|", *keys), 256), F.lit(10))))


def top_incidents(found: DataFrame, n: int = 20) -> DataFrame:
    """The report head: alerting first, then severity, alerts, events, id; at least one row."""
    return found.orderBy((~F.col("alert_required")).cast("int"), severity_rank(F.col("severity")), F.col("alert_count").desc(), F.col("event_count").desc(), "incident_id").limit(max(1, n))


def merge_items(items: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One item per key: the worst severity (the earliest on ties), with all rules.

    Rules of an item that took over the lead stand before the older ones, those
    of other items follow in order; each once. Whether an item took the lead is
    read off the first position per severity, so no group is collected.
    """
    d = items.withColumn("__rank", F.least(severity_rank(F.col("severity")), F.lit(4)))
    firsts = d.groupBy(*keys).agg(*[F.min(F.when(F.col("__rank") == r, F.col(seq))).alias(f"__m{r}") for r in range(5)],
                                  F.min_by(F.struct(*[c for c in items.columns if c not in keys]), F.struct("__rank", seq)).alias("__best"), F.count(F.lit(1)).alias("merged"))
    lead = F.lit(False)
    for r in range(5):
        worse = [F.coalesce(F.col(f"__m{q}") > F.col(seq), F.lit(True)) for q in range(r)]
        test = (F.col("__rank") == r) & (F.col(seq) == F.col(f"__m{r}"))
        for w in worse:
            test = test & w
        lead = lead | test
    rules = (d.join(firsts.select(*keys, *[f"__m{r}" for r in range(5)]), keys)
             .select(*keys, F.struct(F.when(lead, 0).otherwise(1).alias("c"), F.when(lead, F.col("__rank")).alias("r"), F.when(~lead, F.col(seq)).alias("s")).alias("o"), F.posexplode("matched_rules").alias("i", "rule"))
             .groupBy(*keys, "rule").agg(F.min(F.struct("o", "i")).alias("o"))
             .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "rule"))), lambda s: s["rule"]).alias("__rules")))
    out = firsts.select(*keys, "__best.*", "merged").join(rules, keys, "left")
    return out.withColumn("matched_rules", F.coalesce("__rules", F.array().cast("array<string>"))).drop("__rules")


def repeat_count(alerts: DataFrame, keys=("src_ip", "rule_id")) -> DataFrame:
    return alerts.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeats"))


def _top_list(df: DataFrame, col: str, n: int, out: str) -> DataFrame:
    top = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.col("__n").desc(), col).limit(n)
    return top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(col).alias("v")))), lambda s: s["v"]).alias(out))


def batch_summary(results: DataFrame, misses: DataFrame | None = None, top: int = 5) -> DataFrame:
    """One row for a batch of alert results: counts by verdict, outcome, hint and coverage, and the top lists."""
    verdicts = ("false_positive", "scanning_or_probe", "suspicious", "confirmed_attack")
    n = lambda c, v: F.count_if(F.col(c) == v)
    one = results.agg(F.count(F.lit(1)).alias("total"), *[n("alert_verdict", v).alias(v) for v in verdicts], n("attack_outcome", "success_confirmed").alias("success_confirmed"),
                      n("recommended_action", "escalate_investigate").alias("escalate_count"), n("recommended_action", "block_ip").alias("direct_block_count"),
                      n("hint_level", "likely").alias("hint_likely"), n("hint_level", "possible").alias("hint_possible"),
                      F.count_if(F.col("coverage").isin("log_missing", "no_investigation_window")).alias("gateway_log_missing"), n("coverage", "no_matching_request").alias("gateway_log_unmatched"))
    ips = results.select("src_ip") if misses is None else results.select("src_ip").unionByName(misses.select("src_ip"))
    out = one.withColumns({"top_attack_types": _top_list(results.where("attack_type <> 'unknown'"), "attack_type", top, "t").scalar(), "top_ips": _top_list(ips, "src_ip", top, "t").scalar()})
    if misses is not None:
        out = out.withColumn("gateway_miss_count", misses.agg(F.count(F.lit(1))).scalar())
    return out


def geo_mode(events: DataFrame, key: str, fields: list[str], source: str, us: str, id_col: str, max_refs: int = 10) -> DataFrame:
    """Most common value of each field per attacker; the value seen first (time, id) wins a tie."""
    base = events.groupBy(key).agg(F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_set(source)).alias("sources"))
    long = events.select(key, us, id_col, F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.trim(F.col(f).cast("string")).alias("v")) for f in fields])).alias("x")).where("x.v <> ''")
    per = long.groupBy(key, F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(us, id_col)).alias("first"))
    mode = per.groupBy(key).agg(*[F.min_by(F.when(F.col("f") == f, F.col("v")), F.when(F.col("f") == f, F.struct(-F.col("n"), "first"))).alias(f) for f in fields])
    return with_first_ids(base.join(mode, key, "left"), events, [key], [us, id_col], id_col, max_refs)


def activity_range(events: DataFrame, key: str, source: str, us: str, id_col: str) -> DataFrame:
    """First and last time with their source, counts, distinct sources; rows without time only count."""
    pos = F.when(F.col(us).isNotNull(), F.struct(us, id_col))
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("event_count"), F.count(us).alias("timestamped_count"), F.min(us).alias("first_us"), F.max(us).alias("last_us"),
                                   F.min_by(source, pos).alias("first_source"), F.max_by(source, pos).alias("last_source"), F.array_sort(F.collect_set(source)).alias("sources"))


def rank_attackers(events: DataFrame, fields: list[str], top: int, include_private: bool = False) -> DataFrame:
    """External addresses by number of sightings over all source fields; ties by address."""
    ips = events.select(F.explode(F.array(*[normalize_ip(F.col(f).cast("string")) for f in fields])).alias("ip")).where("ip IS NOT NULL")
    if not include_private:
        ips = ips.where(network_tag(F.col("ip")) == "global")
    return ips.groupBy("ip").agg(F.count(F.lit(1)).alias("sightings")).orderBy(F.col("sightings").desc(), "ip").limit(top)


def infer_victims(execs: DataFrame, web_exec: Column, categories: dict[str, Column], top: int = 3, host: str = "host", id_col: str = "evidence_id") -> DataFrame:
    """Hosts with both web-listener execs and risky commands, most risky first."""
    risky = F.lit(False)
    for c in categories.values():
        risky = risky | F.coalesce(c, F.lit(False))
    cats = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(categories.items())]))
    d = execs.withColumn("__w", web_exec).withColumn("__r", risky).withColumn("__c", F.explode_outer(cats)).where(F.col(host).isNotNull())
    g = d.groupBy(host).agg(F.count_distinct(F.when(F.col("__w"), F.col(id_col))).alias("web_exec_count"), F.count_distinct(F.when(F.col("__r"), F.col(id_col))).alias("high_risk_count"),
                            F.array_sort(F.collect_set("__c")).alias("categories"), F.min("us").alias("first_us"))
    return g.where("web_exec_count > 0 AND high_risk_count > 0").orderBy(F.col("high_risk_count").desc(), F.col("web_exec_count").desc(), "first_us", host).limit(top)


def fetch_stats(attempts: DataFrame, retained: DataFrame, dropped: DataFrame) -> DataFrame:
    """Requests by status and rows fetched, kept, deduplicated and window-filtered per asset.

    ``attempts``: asset_id, status, truncated, returned. ``retained`` and
    ``dropped`` (by the window): asset_id, n. Unknown retained counts stay NULL.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    g = attempts.where(F.coalesce("asset_id", F.lit("")) != "").groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if(F.col("status").isin("success", "failed")).alias("query_count"), n("success").alias("successful"), n("failed").alias("failed"),
        n("cache_hit").alias("cache_hits"), F.count_if("truncated").alias("truncated"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("returned"))), F.lit(0)).cast("bigint").alias("fetched"))
    d = g.join(retained.select("asset_id", F.col("n").alias("retained")), "asset_id", "left").join(dropped.select("asset_id", F.col("n").alias("__d")), "asset_id", "left")
    removed = F.greatest(F.lit(0), F.col("fetched") - F.col("retained"))
    window = F.least(removed, F.greatest(F.lit(0), F.coalesce("__d", F.lit(0))))
    known = F.col("retained").isNotNull()
    return d.withColumns({"window_filtered": F.when(known, window), "deduplicated": F.when(known, removed - window)}).drop("__d")


def query_integrity(attempts: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Gap rows (asset_id, connector_id, reasons): failed, truncated, partial, own reasons, and declared assets never queried."""
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("incomplete_reasons", F.array().cast("array<string>")), F.array_compact(F.array(
        F.when(F.col("status") == "failed", "query_failed"), F.when(F.col("truncated"), "truncated"), F.when(F.col("partial"), "partial_response"))))))
    gaps = attempts.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("asset_id", "connector_id", "reasons")
    if declared is not None:
        never = declared.select("asset_id").distinct().join(attempts.select("asset_id").distinct(), "asset_id", "left_anti")
        gaps = gaps.unionByName(never.select("asset_id", F.lit(None).cast("string").alias("connector_id"), F.array(F.lit("not_queried")).alias("reasons")))
    return gaps


def integrity_status(attempts: DataFrame, gaps: DataFrame) -> DataFrame:
    """incomplete / no_known_gaps / unknown for the whole fetch."""
    seen = attempts.agg(F.count_if(F.col("status").isin("success", "cache_hit", "failed")).alias("__o"))
    return seen.withColumn("gap_count", gaps.agg(F.count(F.lit(1))).scalar()).select(
        F.when(F.col("gap_count") > 0, "incomplete").when(F.col("__o") > 0, "no_known_gaps").otherwise("unknown").alias("status"), "gap_count")


def assessment_summary(items: DataFrame, tags: str, techniques: str) -> DataFrame:
    """Counts by severity, tag and technique in one pass over the items: (kind, name, n)."""
    labels = F.concat(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("name"))),
                      F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))),
                      F.transform(F.coalesce(techniques, F.array().cast("array<string>")), lambda t: F.struct(F.lit("technique").alias("kind"), t.alias("name"))))
    return items.select(F.explode(labels).alias("l")).groupBy("l.kind", "l.name").agg(F.count(F.lit(1)).alias("n"))


def top_tags(summary: DataFrame, n: int = 5) -> DataFrame:
    return summary.where("kind = 'tag'").orderBy(F.col("n").desc(), "name").limit(n)


def host_highlights(snippets: DataFrame, host: str, snippet: str, priority: Column, n: int = 4) -> DataFrame:
    """The ``n`` best distinct snippets per host, by priority, then text."""
    d = snippets.where(F.coalesce(snippet, F.lit("")) != "").groupBy(host, snippet).agg(F.min(priority).alias("priority"))
    return first_rows(d, [host], ["priority", snippet], n).withColumnRenamed("__rn", "position")


def chain_pattern(stage_rules: DataFrame, patterns: DataFrame, group: list[str]) -> DataFrame:
    """Best attack pattern per group: every stage must hit a required rule; score is the number of hits.

    ``patterns``: pattern_id, position, stage, rule. The first pattern wins a tie.
    """
    need = patterns.groupBy("pattern_id").agg(F.count_distinct("stage").alias("__need"), F.min("position").alias("__pos"))
    hits = stage_rules.select(*group, "stage", "rule").distinct().join(patterns.select("pattern_id", "stage", "rule").distinct(), ["stage", "rule"])
    g = hits.groupBy(*group, "pattern_id").agg(F.count_distinct("stage").alias("__have"), F.count(F.lit(1)).alias("score")).join(need, "pattern_id").where("__have = __need")
    return g.groupBy(*group).agg(F.min_by(F.struct("pattern_id", "score"), F.struct(-F.col("score"), "__pos")).alias("b")).select(*group, "b.pattern_id", "b.score")


def chain_confidence(stages: DataFrame, group: list[str], ceiling: float, empty: float = 0.4) -> DataFrame:
    """Mean stage confidence (0.7 if NULL) under the ceiling. Groups without stages: see ``empty``.

    Summed as decimals, so the result does not depend on the order of the rows.
    """
    conf = F.coalesce(F.col("confidence").cast("decimal(10,6)"), F.lit(0.7).cast("decimal(10,6)"))
    return stages.groupBy(*group).agg(F.round(F.least(F.lit(ceiling).cast("decimal(10,6)"), F.avg(conf)), 2).cast("double").alias("confidence"), F.lit(empty).alias("if_empty"))


def timeline_sources(timeline: DataFrame, evidence: DataFrame, id_col: str, types: list[str]) -> DataFrame:
    """One boolean column per evidence type: does a timeline row rest on it?"""
    refs = timeline.select(id_col, F.explode("evidence_refs").alias("__ref"))
    hit = refs.join(evidence.select(F.col("evidence_id").alias("__ref"), "asset_type"), "__ref")
    flags = hit.groupBy(id_col).agg(*[F.bool_or(F.col("asset_type") == t).alias(t) for t in types])
    out = timeline.join(flags, id_col, "left")
    return out.withColumns({t: F.coalesce(F.col(t), F.lit(False)) for t in types})


def assemble_records(lines: DataFrame, id_col: str, kind: str, idx: str, value: str, required: list[str]) -> DataFrame:
    """Lines of one id to one event: values of each kind ordered by index, and whether all required kinds came.

    One id is one native record, so its list is as long as the record. Lines
    without id belong to nothing: each is a record of its own.
    """
    alone = lines.where(F.col(id_col).isNull())
    lines = lines.where(F.col(id_col).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), F.col(idx).alias("i"), F.col(value).alias("v"))))
    g = lines.groupBy(id_col).agg(parts.alias("__p"))
    pick = lambda k: F.transform(F.filter("__p", lambda p: p["k"] == k), lambda p: p["v"])
    complete = F.lit(True)
    for k in required:
        complete = complete & (F.size(pick(k)) > 0)
    whole = g.select(id_col, *[pick(k).alias(k) for k in required], F.size("__p").alias("n_lines"), complete.alias("complete"))
    own = lambda k: F.filter(F.array(F.col(value)), lambda v: F.col(kind) == k)
    only = F.lit(True)
    for k in required:
        only = only & F.coalesce(F.col(kind) == k, F.lit(False))
    return whole.unionByName(alone.select(id_col, *[own(k).alias(k) for k in required], F.lit(1).alias("n_lines"), only.alias("complete")))


def assemble_fragments(parts: DataFrame, keys: list[str], number: str, total: str, text: str) -> DataFrame:
    """Ordered concatenation when all ``total`` fragments came once and agree; ``status`` says why not.

    conflict: a number twice, several totals, or a number out of range.
    """
    g = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(number).alias("__d"), F.min(total).alias("__t"), F.max(total).alias("__tx"), F.min(number).alias("__lo"), F.max(number).alias("__hi"),
                                 F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), F.col(text).alias("v")))).alias("__p"))
    bad = (F.col("__n") != F.col("__d")) | (F.col("__t") != F.col("__tx")) | (F.col("__lo") < 1) | (F.col("__hi") > F.col("__t"))
    status = F.when(bad, "conflict").when(F.col("__n") == F.col("__t"), "complete").otherwise("incomplete")
    return g.select(*keys, status.alias("status"), F.col("__n").alias("fragments"), F.when(status == "complete", F.array_join(F.transform("__p", lambda p: p["v"]), "")).alias("text"))


def promote_baseline(events: DataFrame, keys: list[str], us: str, start_us: int, learning_sec: int = 86_400, bucket_sec: int = 300, min_occurrences: int = 5,
                     min_hours: int = 3, min_span_sec: int = 21_600) -> DataFrame:
    """Behaviours seen often enough, with a rate limit of max(10, 3 × P95 of all buckets).

    Empty buckets count in the percentile: with ``z`` empty ones of ``n``, the
    ceil(0.95 n)-th smallest is 0, or the (rank - z)-th smallest filled one. Only
    the filled buckets are ranked, at most ``n`` per key.
    """
    inside = events.where(F.col(us).between(start_us, start_us + learning_sec * 1_000_000 - 1))
    t = (F.col(us) - start_us)
    buckets = inside.groupBy(*keys, F.floor(t / (bucket_sec * 1_000_000)).alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"), F.collect_set(F.floor(t / 3_600_000_000)).alias("h"))
    n_bins = -(-learning_sec // bucket_sec)
    rank = -(-n_bins * 95 // 100)
    g = buckets.groupBy(*keys).agg(F.sum("n").alias("occurrences"), F.size(F.array_distinct(F.flatten(F.collect_set("h")))).cast("bigint").alias("hours"), (F.max("hi") - F.min("lo")).alias("__span"), F.array_sort(F.collect_list("n")).alias("__c"))
    at = F.lit(rank) - (F.lit(n_bins) - F.size("__c"))
    p95 = F.when(at >= 1, F.get("__c", at - 1)).otherwise(0)
    return (g.where((F.col("occurrences") >= min_occurrences) & (F.col("hours") >= min_hours) & (F.col("__span") >= min_span_sec * 1_000_000))
            .select(*keys, "occurrences", "hours", F.greatest(F.lit(10), p95 * 3).cast("bigint").alias("rate_limit")))


def behavior_summary(events: DataFrame, keys: list[str], us: str, suppressed: Column, interval_sec: int = 300) -> DataFrame:
    """Observed, suppressed and emitted per behaviour and interval; intervals without rows give none."""
    w = interval_sec * 1_000_000
    return events.groupBy(*keys, (F.floor(F.col(us) / w) * w).cast("bigint").alias("interval_us")).agg(
        F.count(F.lit(1)).alias("observed"), F.count_if(suppressed).alias("suppressed"), F.count_if(~suppressed).alias("emitted"))


def churn_summary(changes: DataFrame, group: list[str], routine: Column, name: str, n: int = 32) -> DataFrame:
    """Routine starts, exits and changes folded to one row per group with the first names."""
    d = changes.where(routine)
    g = d.groupBy(*group).agg(F.count_if(F.col("action") == "started").alias("started"), F.count_if(F.col("action") == "exited").alias("exited"), F.count_if(F.col("action") == "changed").alias("changed"))
    names = first_rows(d.select(*group, name).distinct(), group, [name], n).groupBy(*group).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return g.join(names, group, "left")
