"""Gateway requests against alerts and host evidence.

Alerts: alert_id, us, src_ip, method, path_key, action. Requests: evidence_id,
us, src_ip, method, path_key, status. ``path_key`` is the decoded path; two
URLs correlate when their paths are equal, so it is an equi key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import web
from ..functions.common import any_of, first_match
from .blocks import block_of, interval_pairs, with_window_agg, window_agg
from .joins import probe, publish
from .predicates import url_pattern_hits
from .rules import BLOCKED_ACTIONS

MINUTE = 60_000_000


def path_key(url: Column) -> Column:
    """Decoded path without query; NULL when empty, so it never joins."""
    p = F.regexp_extract(web.decoded_text(web.path_query(url)), r"(?s)^([^?]*)", 1)
    return F.when(p != "", p)


def _asks(df: DataFrame, alert_side: bool) -> DataFrame:
    """Probe keys of the asking side: address and method, unknown ones as joker."""
    m = F.when(F.col("method").isNull(), F.array(F.lit("~"))).otherwise(F.array("method")) if alert_side else F.array(F.coalesce("method", F.lit("")), F.lit("*"))
    return df.withColumn("__ip", F.explode(probe(F.col("src_ip")))).withColumn("__m", F.explode(m))


def _offers(df: DataFrame, alert_side: bool) -> DataFrame:
    m = F.array(F.coalesce("method", F.lit("*"))) if alert_side else F.array(F.coalesce("method", F.lit("")), F.lit("~"))
    return df.withColumn("__ip", F.explode(publish(F.col("src_ip")))).withColumn("__m", F.explode(m))


def request_pairs(alerts: DataFrame, requests: DataFrame, tight_sec: int) -> DataFrame:
    """(alert_id, evidence_id) of requests an alert refers to: same path, same source when
    both are known, same method when the alert has one, at most ``tight_sec`` apart."""
    a = _asks(alerts.select("alert_id", F.col("us").alias("a_us"), "src_ip", "method", F.col("path_key").alias("a_path")), True).withColumnRenamed("__ip", "__aip").withColumnRenamed("__m", "__am")
    r = _offers(requests.select("evidence_id", F.col("us").alias("r_us"), "src_ip", "method", F.col("path_key").alias("r_path")), False)
    w = tight_sec * 1_000_000
    got = interval_pairs(a.drop("src_ip", "method"), r.drop("src_ip", "method"), [("a_path", "r_path"), ("__aip", "__ip"), ("__am", "__m")], "a_us", "r_us", w, w)
    return got.select("alert_id", "evidence_id", "a_us", "r_us")


def _flag(left: DataFrame, left_id: str, right: DataFrame, alert_is_left: bool, seconds: int, use_method: bool, out: str) -> DataFrame:
    """Does a correlated row of the other side exist within ``seconds``: one flag per left row."""
    if use_method:
        l, r, keys = _asks(left, alert_is_left), _offers(right, not alert_is_left), ["path_key", "__ip", "__m"]
    else:
        l, r, keys = left.withColumn("__ip", F.explode(probe(F.col("src_ip")))), right.withColumn("__ip", F.explode(publish(F.col("src_ip")))), ["path_key", "__ip"]
    w = seconds * 1_000_000
    got = window_agg(l.where("path_key IS NOT NULL"), r.withColumn("__one", F.lit(1)), keys, left_id, "us", "us", w, w, {out: ("__one", "max")})
    return left.join(got, left_id, "left").withColumn(out, F.coalesce(F.col(out) == 1, F.lit(False)))


def gateway_misses(requests: DataFrame, alerts: DataFrame, patterns, exclude=(), status_ok=(200, 201, 204, 302), block_success=(403,), minutes: int = 15,
                   tight_sec: int = 5, critical=(), high=(), probes=(), probe_severity: str = "medium") -> DataFrame:
    """Suspicious successful requests without an adequate alert, with reason and severity.

    A passing alert on the same source and path within ``minutes`` covers a
    request; a blocking alert covers only the blocked attempt itself (status in
    ``block_success``, same method, ``tight_sec``). Reasons: ``waf_block_bypass``
    (a block matches this request and the path never showed a working block),
    ``waf_partial_block_same_path``, ``gateway_exploit_no_waf_alert``. All misses
    are returned; cut the list only in a report.
    """
    text = web.decoded_text(F.col("url"))
    d = requests.withColumn("hits", url_pattern_hits(F.col("url"), patterns))
    suspects = d.where((F.size("hits") > 0) & F.col("status").isin(*status_ok) & ~any_of(*[text.contains(p.lower()) for p in exclude]))
    blocked = F.lower(F.coalesce("action", F.lit(""))).isin(*BLOCKED_ACTIONS)
    blocks, passes = alerts.where(blocked), alerts.where(~blocked)
    s = _flag(suspects, "evidence_id", passes, False, minutes * 60, False, "__pass")
    s = s.where(~F.col("__pass")).drop("__pass")
    s = _flag(s, "evidence_id", blocks, False, minutes * 60, False, "__near")
    s = _flag(s, "evidence_id", blocks, False, tight_sec, True, "__tight")
    s = s.where(~(F.col("__tight") & F.col("status").isin(*block_success)))
    worked = _flag(d.where(F.col("status").isin(*block_success)), "evidence_id", blocks, False, tight_sec, True, "__b").where("__b")
    worked = worked.select(F.coalesce("src_ip", F.lit("")).alias("__ip"), "path_key", F.coalesce("method", F.lit("")).alias("__m")).distinct().withColumn("__worked", F.lit(True))
    s = s.withColumn("__ip", F.coalesce("src_ip", F.lit(""))).withColumn("__m", F.coalesce("method", F.lit(""))).join(worked, ["__ip", "path_key", "__m"], "left")
    reason = F.when(F.col("__tight") & F.col("__worked").isNull(), "waf_block_bypass").when(F.col("__near"), "waf_partial_block_same_path").otherwise("gateway_exploit_no_waf_alert")
    body = F.concat_ws(" ", text, F.array_join("hits", " "))
    severity = first_match((F.col("status").between(400, 499), "low"), (any_of(*[body.contains(p) for p in probes]), probe_severity), (any_of(*[body.contains(p) for p in critical]), "critical"),
                           (any_of(*[body.contains(p) for p in high]), "high"), (F.col("status").isin(200, 201, 204, 302), "high"), default="medium")
    return s.select("evidence_id", "us", "src_ip", "url", "status", F.col("hits").alias("pattern_hits"), reason.alias("reason"), severity.alias("severity"))


def miss_summary(misses: DataFrame, top: int = 5) -> DataFrame:
    """Counts by reason and severity, and the top sources: (kind, name, n)."""
    count = lambda c, kind: misses.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return (count("reason", "reason").unionByName(count("severity", "severity"))
            .unionByName(count("src_ip", "source").orderBy(F.col("n").desc(), "name").limit(top)))


def gateway_coverage(alerts: DataFrame, requests: DataFrame, start_us: int, end_us: int, tight_sec: int = 60, loose_sec: int | None = None) -> DataFrame:
    """Is there gateway data for an alert: adds ``coverage``.

    matched / outside_tight_window / no_matching_request, and for the whole
    batch no_investigation_window (no request in scope) or log_missing.
    Alerts without time only need source and path.
    """
    scoped = requests.where(F.col("us").between(start_us, end_us))
    a = _flag(alerts, "alert_id", scoped, True, tight_sec, True, "__tight")
    # Any time in scope: the keys alone decide.
    offers = _offers(scoped, False).select("path_key", "__ip", "__m").distinct()
    loose = _asks(alerts, True).join(offers, ["path_key", "__ip", "__m"], "left_semi").select("alert_id").distinct().withColumn("__loose", F.lit(True))
    a = a.join(loose, "alert_id", "left").withColumns({"__all": requests.agg(F.count(F.lit(1))).scalar(), "__in": scoped.agg(F.count(F.lit(1))).scalar()})
    hit = F.col("__tight") | (F.col("us").isNull() & F.col("__loose"))
    return a.withColumn("coverage", first_match((F.col("__all") == 0, "log_missing"), (F.col("__in") == 0, "no_investigation_window"), (hit, "matched"),
                                                (F.col("__loose"), "outside_tight_window"), default="no_matching_request")).drop("__tight", "__loose", "__all", "__in")


def success_hint(alerts: DataFrame, requests: DataFrame, minutes: int = 10, status_ok=(200, 201, 204), upstream_ok=(200, 201, 204), min_bytes: int = 64,
                 large_bytes: int = 500, patterns=()) -> DataFrame:
    """Best gateway sign that an unconfirmed attack worked: ``level``, ``reason``, bytes, reference.

    likely: the alert passed, or was blocked yet answered, or the answer is
    large and the URL hits a pattern; else possible. Best = level, then bytes,
    then the earlier request. Alerts already proven drop out.
    """
    cand = requests.where(F.col("status").isin(*status_ok) & (F.col("upstream_status").isNull() | F.col("upstream_status").isin(*upstream_ok)) & (F.coalesce("bytes_sent", F.lit(0)) >= min_bytes))
    hits = url_pattern_hits(F.col("url"), patterns)
    if patterns:
        cand = cand.where(F.size(hits) > 0)
    big = (F.col("bytes_sent") >= large_bytes) & (F.size(hits) > 0)
    cand = cand.withColumn("__best", F.struct(big.cast("int").alias("big"), F.col("bytes_sent").alias("bytes"), (-F.col("us")).alias("early"), F.col("evidence_id").alias("ref")))
    by_bytes = F.struct(F.col("bytes_sent").alias("bytes"), (-F.col("us")).alias("early"), F.col("evidence_id").alias("ref"))
    offers = cand.withColumn("__by", by_bytes).withColumn("__ip", F.explode(F.array(F.coalesce("src_ip", F.lit("*")), F.lit("~"))))
    a = alerts.where("NOT attack_success").withColumn("__ip", F.coalesce("src_ip", F.lit("~")))
    d = with_window_agg(a, offers, ["path_key", "__ip"], "alert_id", "us", "us", minutes * MINUTE, minutes * MINUTE, {"__b": ("__best", "max"), "__m": ("__by", "max")}).where("__m IS NOT NULL")
    act = F.lower(F.coalesce("action", F.lit("")))
    passed, blocked = act == "pass", act.isin(*BLOCKED_ACTIONS)
    fixed = passed | blocked
    level = F.when(fixed | (F.col("__b.big") == 1), "likely").otherwise("possible")
    reason = F.when(passed, "waf_pass_backend_200").when(blocked, "waf_block_bypass_backend_200").otherwise("exploit_url_backend_200_large_body")
    return d.select("alert_id", level.alias("level"), reason.alias("reason"), F.when(fixed, F.col("__m.bytes")).otherwise(F.col("__b.bytes")).alias("bytes_sent"),
                    F.when(fixed, F.col("__m.ref")).otherwise(F.col("__b.ref")).alias("evidence_ref"))


def enrich_targets(alerts: DataFrame, access: DataFrame, window_sec: int = 120) -> DataFrame:
    """Fill a missing ``target_ip`` from the first access row (time, id) of the same source,
    at most ``window_sec`` away, with a related path; a target already there stays.

    Paths relate when equal, when one contains the other, or when either is
    missing. Containment is settled once per distinct pair of paths seen close
    together, then the search runs on equal keys. Adds ``target_ip_source``:
    own, access or NULL.
    """
    w = window_sec * 1_000_000
    need = alerts.where("target_ip IS NULL AND src_ip IS NOT NULL").withColumn("__path", F.coalesce("path_key", F.lit("")))
    rows = access.where("target_ip IS NOT NULL AND src_ip IS NOT NULL").withColumn("__path", F.coalesce("path_key", F.lit("")))
    rows = rows.withColumn("__first", F.struct(F.col("us").alias("us"), F.col("evidence_id").alias("id"), F.col("target_ip").alias("ip")))
    blk = lambda shift: block_of(F.col("us"), 2 * w) + shift
    ap = need.where("__path <> ''").select("src_ip", F.col("__path").alias("ap"), blk(0).alias("b")).distinct()
    rp = rows.where("__path <> ''").select("src_ip", F.col("__path").alias("rp"), F.explode(F.array(blk(-1), blk(0), blk(1))).alias("b")).distinct()
    related = ap.join(rp, ["src_ip", "b"]).where(F.col("ap").contains(F.col("rp")) | F.col("rp").contains(F.col("ap"))).select("src_ip", "ap", "rp").distinct()
    # Search keys: the related paths, the empty path, or "any" for an alert without path.
    by_path = need.where("__path <> ''").join(related.withColumnRenamed("ap", "__path"), ["src_ip", "__path"]).select("alert_id", "us", "src_ip", F.col("rp").alias("__k"))
    ask = (by_path.unionByName(need.where("__path <> ''").select("alert_id", "us", "src_ip", F.lit("").alias("__k")))
           .unionByName(need.where("__path = ''").select("alert_id", "us", "src_ip", F.lit("\u0000any").alias("__k"))))
    offer = rows.withColumn("__k", F.explode(F.array(F.col("__path"), F.lit("\u0000any"))))
    got = window_agg(ask, offer, ["src_ip", "__k"], "alert_id", "us", "us", w, w, {"__f": ("__first", "min")}).where("__f IS NOT NULL")
    return (alerts.join(got, "alert_id", "left")
            .withColumn("target_ip_source", F.when(F.col("target_ip").isNotNull(), "own").when(F.col("__f").isNotNull(), "access"))
            .withColumn("target_ip", F.coalesce("target_ip", "__f.ip")).drop("__f"))


def success_evidence(alerts: DataFrame, requests: DataFrame, host_rows: DataFrame, context_min: int = 10, before_min: int = 5, after_min: int = 30) -> DataFrame:
    """Host signs of success per alert: ``success``, ``indicator``, first sign.

    A context is a request of the same source and path within ``context_min``
    that reached the upstream (``target_ip`` set, success status). Host rows on
    the context's target, ``before_min``/``after_min`` around it, that carry an
    ``indicator`` prove success; the indicator of the earliest (time, id) counts.
    Each step folds before the next, so no (alert, host row) pairs are formed.
    """
    signs = host_rows.where("indicator IS NOT NULL").withColumn("__s", F.struct(F.col("us").alias("us"), F.col("evidence_id").alias("id"), F.col("indicator").alias("indicator")))
    ctx = requests.where("target_ip IS NOT NULL AND path_key IS NOT NULL AND status BETWEEN 200 AND 399").withColumn("host", F.col("target_ip"))
    found = window_agg(ctx, signs, ["host"], "evidence_id", "us", "us", before_min * MINUTE, after_min * MINUTE, {"__f": ("__s", "min")}).where("__f IS NOT NULL")
    ctx = ctx.join(found, "evidence_id").withColumn("__ip", F.explode(publish(F.col("src_ip"))))
    a = alerts.withColumn("__ip", F.explode(probe(F.col("src_ip"))))
    best = window_agg(a, ctx, ["path_key", "__ip"], "alert_id", "us", "us", context_min * MINUTE, context_min * MINUTE, {"__f": ("__f", "min")}).where("__f IS NOT NULL")
    return alerts.join(best, "alert_id", "left").select("alert_id", F.col("__f").isNotNull().alias("success"), F.col("__f.indicator").alias("indicator"), F.col("__f.id").alias("first_ref"))


def success_refs(alerts: DataFrame, requests: DataFrame, host_rows: DataFrame, context_min: int = 10, before_min: int = 5, after_min: int = 30) -> DataFrame:
    """The (alert_id, ref) list behind ``success_evidence``: every sign, long form.

    The contexts of an alert on one host cover a few stretches of time: within a
    block no wider than one context's reach they cover everything from the first
    to the last. So the contexts fold to their ends per block, the stretches of
    an (alert, host) are made disjoint, and every sign in one is a row of the
    result. No (alert, context) pairs are formed, and only ids of several signs
    are told apart afterwards.
    """
    w, before, after = context_min * MINUTE, before_min * MINUTE, after_min * MINUTE
    signs = host_rows.where("indicator IS NOT NULL").select(F.col("evidence_id").alias("ref"), F.col("us").cast("bigint").alias("s_us"), F.col("host").alias("s_host")).where("s_us IS NOT NULL AND s_host IS NOT NULL").distinct()
    width = max(before + after, 1)
    keys = ["path_key", "__ip", "host", "__cell"]
    ctx = (requests.where("target_ip IS NOT NULL AND path_key IS NOT NULL AND us IS NOT NULL AND status BETWEEN 200 AND 399")
           .select(F.col("us").cast("bigint").alias("us"), "path_key", F.col("target_ip").alias("host"), F.explode(publish(F.col("src_ip"))).alias("__ip")).withColumn("__cell", block_of(F.col("us"), width)))
    ctx = ctx.select(*keys, "us", F.col("us").alias("c_us"))
    if before + after == 0:  # a context reaches its own moment only
        hits = ctx.join(signs, (F.col("host") == F.col("s_host")) & (F.col("us") == F.col("s_us"))).select(F.col("path_key").alias("c_path"), F.col("__ip").alias("c_ip"), "c_us", "ref").distinct()
        asked = alerts.select("alert_id", F.col("us").alias("a_us"), "path_key", F.explode(probe(F.col("src_ip"))).alias("a_ip"))
        return interval_pairs(asked, hits, [("path_key", "c_path"), ("a_ip", "c_ip")], "a_us", "c_us", w, w).select("alert_id", "ref").distinct()
    a = alerts.where("us IS NOT NULL AND path_key IS NOT NULL").select("alert_id", F.col("us").cast("bigint").alias("us"), "path_key", F.explode(probe(F.col("src_ip"))).alias("__ip")).distinct()
    near = a.withColumn("__cell", F.explode(F.sequence(block_of(F.col("us") - w, width), block_of(F.col("us") + w, width)))).join(ctx.select(*keys).distinct(), ["path_key", "__ip", "__cell"])
    near = near.withColumn("__who", F.struct("alert_id", "us", *keys))
    ends = window_agg(near, ctx, keys, "__who", "us", "us", w, max(w, 1), {"lo": ("c_us", "min"), "hi": ("c_us", "max")})
    ends = ends.select("__who.*", "lo", F.least("hi", F.col("__who.us") + w).alias("hi")).where(F.col("lo") <= F.col("us") + w)
    ends = ends.select("alert_id", "host", (F.col("lo") - before).alias("lo"), (F.col("hi") + after).alias("hi"))
    so_far = Window.partitionBy("alert_id", "host").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    free = ends.withColumn("lo", F.greatest("lo", F.max("hi").over(so_far) + 1)).where("lo <= hi")
    span = max(2 * (before + after), 1)
    cells = free.withColumn("__cell", F.explode(F.sequence(block_of(F.col("lo"), span), block_of(F.col("hi"), span))))
    several = signs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("ref").alias("__ref"))
    same = F.col("ref").eqNullSafe(F.col("__ref"))

    def inside(s: DataFrame) -> DataFrame:
        s = s.withColumn("__s_cell", block_of(F.col("s_us"), span))
        return cells.join(s, (F.col("host") == F.col("s_host")) & (F.col("__cell") == F.col("__s_cell")) & F.col("s_us").between(F.col("lo"), F.col("hi"))).select("alert_id", "ref")

    return inside(signs.join(several, same, "left_anti")).unionByName(inside(signs.join(several, same, "left_semi")).distinct())


def campaign_success(requests: DataFrame, host_rows: DataFrame, start_us: int, end_us: int, param_targets=()) -> DataFrame:
    """One row for the whole activity: attributed signs, indicators, uncorrelated rows.

    Host rows count when their host is a given target or an upstream target of a
    request in scope; without any target all rows in scope are uncorrelated.
    """
    inside = F.col("us").between(start_us, end_us)
    web_targets = requests.where(inside & F.col("target_ip").isNotNull()).select(F.col("target_ip").alias("host"))
    given = host_rows.sparkSession.createDataFrame([(str(t),) for t in param_targets], "host string")
    targets = web_targets.unionByName(given).distinct().withColumn("__v", F.lit(True))
    rows = host_rows.where(inside).join(targets, "host", "left")
    hit = F.col("__v").isNotNull()
    agg = rows.agg(F.count_if(hit & F.col("indicator").isNotNull()).alias("success_count"), F.count_if(hit).alias("supporting_count"), F.count_if(~hit).alias("unmatched_count"),
                   F.array_sort(F.collect_set(F.when(hit, F.col("indicator")))).alias("indicators"))
    return agg.withColumn("target_count", targets.agg(F.count(F.lit(1))).scalar()).select(
        (F.col("success_count") > 0).alias("attack_success"), "success_count", "supporting_count", F.when(F.col("target_count") == 0, F.col("unmatched_count")).otherwise(F.lit(0)).cast("bigint").alias("uncorrelated_count"),
        "target_count", "indicators", F.when(F.col("target_count") > 0, "field_correlated").otherwise("uncorrelated").alias("attribution"),
        F.when(F.col("success_count") > 0, "escalate_investigate").otherwise("log_and_monitor").alias("recommended_action"))
