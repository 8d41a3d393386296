"""Movement between hosts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import any_of
from ..functions.net import PRIVATE_CIDRS, extract_ipv4s, in_cidrs
from ..session import cut_lineage
from .blocks import interval_pairs, with_window_agg, window_agg
from .normalize import ssh_targets
from .rollups import first_rows

SEC = 1_000_000


def execution_chain(execs: DataFrame, connects: DataFrame, files: DataFrame, persistence: DataFrame, connect_sec: int = 120, file_sec: int = 300,
                    persistence_sec: int = 600, base: float = 0.85, boost: float = 0.08, cap: float = 0.95, anchor_us: int | None = None, lookback_sec: int = 300, end_us: int | None = None) -> DataFrame:
    """Each exec with the number of connections, file changes and persistence changes near it.

    Every nearby connection adds ``boost`` up to ``cap``. All tables: evidence_id,
    host, us. The counts come from running sums; ``execution_refs`` lists the rows.
    Execs from ``lookback_sec`` before the anchor to the end of the investigation
    count; what is near them may lie outside.
    """
    d = execs.where(F.col("us").isNotNull())
    if anchor_us is not None:
        d = d.where(F.col("us") >= anchor_us - lookback_sec * SEC)
    if end_us is not None:
        d = d.where(F.col("us") <= end_us)
    for name, table, sec in (("connects", connects, connect_sec), ("file_ops", files, file_sec), ("persistence", persistence, persistence_sec)):
        d = with_window_agg(d, table.withColumn("__one", F.lit(1).cast("bigint")), ["host"], "evidence_id", "us", "us", sec * SEC, sec * SEC, {name: ("__one", "sum")})
    return d.withColumn("confidence", F.round(F.least(F.lit(cap), F.lit(base) + F.lit(boost) * F.col("connects")), 2))


def execution_refs(execs: DataFrame, related: list[tuple[DataFrame, int]]) -> DataFrame:
    """(evidence_id, ref) of all rows near an exec, long form; ``related`` pairs a table with its seconds."""
    l = execs.select("evidence_id", F.col("host").alias("l_host"), F.col("us").alias("l_us"))
    out = None
    for table, sec in related:
        r = table.select(F.col("evidence_id").alias("ref"), F.col("host").alias("r_host"), F.col("us").alias("r_us"))
        part = interval_pairs(l, r, [("l_host", "r_host")], "l_us", "r_us", sec * SEC, sec * SEC).select("evidence_id", "ref")
        out = part if out is None else out.unionByName(part)
    return out


def persistence_chain(rows: DataFrame, anchor_us: int | None = None, lookback_sec: int = 300, end_us: int | None = None, confidence: float = 0.84) -> DataFrame:
    """Persistence stages from ``lookback_sec`` before the anchor to the end."""
    d = rows.where(F.col("us").isNotNull())
    if anchor_us is not None:
        d = d.where(F.col("us") >= anchor_us - lookback_sec * SEC)
    if end_us is not None:
        d = d.where(F.col("us") <= end_us)
    return d.withColumns({"stage": F.lit("persistence"), "confidence": F.lit(confidence)})


def lateral_hops(seeds: DataFrame, logins: DataFrame, firewall: DataFrame | None = None, max_hops: int = 10, near_sec: int = 600, anchor_us: int | None = None, end_us: int | None = None,
                 with_firewall: float = 0.88, without: float = 0.82, fail_threshold: int = 5, suspect: float = 0.55) -> DataFrame:
    """Breadth-first spread over accepted logins, with the failed-burst suspicion.

    ``seeds``: host. ``logins``: src, dst, us, evidence_id, result (accepted /
    failed). ``firewall``: src, dst, us, evidence_id (SSH port rows). Each hop
    asks every host of the frontier once; the earliest accepted login (time, id)
    of a pair is its edge, one without time only where no other is there, and a host joins the frontier only once. A frontier
    host without accepted login but with ``fail_threshold`` failures is suspected
    (dst NULL). Edges fold to one per pair first, so a hop joins pairs, not
    logins, and every hop writes its frontier to the shared folder. Logins
    before ``anchor_us`` or after ``end_us`` do not count; those without time
    do. ``firewall_ref`` is the first firewall row near the login.
    """
    ok = logins.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    if anchor_us is not None:
        ok = ok.where(F.col("us").isNull() | (F.col("us") >= anchor_us))
    if end_us is not None:
        ok = ok.where(F.col("us").isNull() | (F.col("us") <= end_us))
    edges = ok.where("result = 'accepted'").groupBy("src", "dst").agg(F.min(F.struct(F.col("us").isNull(), "us", "evidence_id")).alias("e")).select("src", "dst", F.col("e.us").alias("us"), F.col("e.evidence_id").alias("evidence_id"))
    if firewall is not None:
        near = window_agg(edges.where("us IS NOT NULL").withColumn("pair", F.concat_ws("\u0001", "src", "dst")), firewall, ["src", "dst"], "pair", "us", "us", near_sec * SEC, near_sec * SEC, {"fw": ("evidence_id", "min")})
        edges = edges.withColumn("pair", F.concat_ws("\u0001", "src", "dst")).join(near, "pair", "left").drop("pair")
    else:
        edges = edges.withColumn("fw", F.lit(None).cast(logins.schema["evidence_id"].dataType))
    edges = cut_lineage(edges)
    failed = ok.where("result = 'failed'").groupBy("src").agg(F.count(F.lit(1)).alias("failed"))
    visited = cut_lineage(seeds.select("host").where("host IS NOT NULL").distinct().withColumn("hop", F.lit(0)))
    frontier = visited
    for hop in range(1, max_hops + 1):
        reached = edges.join(frontier.select(F.col("host").alias("src")), "src", "left_semi").select(F.col("dst").alias("host")).distinct()
        frontier = cut_lineage(reached.join(visited, "host", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    asked = visited.where(F.col("hop") < max_hops).select(F.col("host").alias("src"), F.col("hop").alias("src_hop"))
    confirmed = edges.join(asked, "src").select("src", "dst", "us", "evidence_id", (F.col("src_hop") + 1).alias("hop"), F.lit("confirmed_lateral").alias("lateral_class"),
                                               F.when(F.col("fw").isNotNull(), with_firewall).otherwise(without).alias("confidence"), F.col("fw").alias("firewall_ref"))
    suspects = (asked.join(edges.select("src").distinct(), "src", "left_anti").join(failed, "src").where(F.col("failed") >= fail_threshold)
                .select("src", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("bigint").alias("us"), F.lit(None).cast(edges.schema["evidence_id"].dataType).alias("evidence_id"),
                        (F.col("src_hop") + 1).alias("hop"), F.lit("suspected_lateral").alias("lateral_class"), F.lit(suspect).alias("confidence"), F.lit(None).cast(edges.schema["fw"].dataType).alias("firewall_ref")))
    return confirmed.unionByName(suspects)


def lateral_from_exec(execs: DataFrame, sources: DataFrame, command: str = "command", confidence: float = 0.78) -> DataFrame:
    """Targets that commands on source hosts log in to: first row (time, id) per (src, dst, user)."""
    low = F.lower(F.coalesce(F.col(command), F.lit("")))
    d = execs.where(low.contains("ssh")).join(sources.select("host").distinct(), "host", "left_semi")
    t = d.select("host", "us", "evidence_id", F.explode(ssh_targets(F.col(command))).alias("t")).where(F.col("t.ip") != F.col("host"))
    return (t.groupBy(F.col("host").alias("src"), F.col("t.ip").alias("dst"), F.col("t.user").alias("user")).agg(F.min(F.struct("us", "evidence_id")).alias("e"))
            .select("src", "dst", "user", F.col("e.us").alias("us"), F.col("e.evidence_id").alias("evidence_id"), F.lit("suspected_lateral").alias("lateral_class"), F.lit(confidence).alias("confidence")))


def confirm_lateral(stages: DataFrame, logins: DataFrame, floor: float = 0.92) -> DataFrame:
    """Suspected stages whose pair shows a login become confirmed.

    ``stages``: src, dst, us, lateral_class, confidence, evidence_refs; ``logins``:
    src, dst, us, evidence_id. The attempt time is kept, ``confirmed_us`` is the
    earliest login, references of one login per (pair, user) are united (sorted).
    """
    first = logins.groupBy("src", "dst", "user").agg(F.min(F.struct("us", "evidence_id")).alias("e"))
    c = first.groupBy("src", "dst").agg(F.min("e.us").alias("__us"), F.collect_set("e.evidence_id").alias("__refs"))
    d = stages.join(c, ["src", "dst"], "left")
    hit = F.col("__us").isNotNull() & (F.col("lateral_class") == "suspected_lateral")
    return d.withColumns({
        "attempt_us": F.when(hit, F.col("us")), "confirmed_us": F.when(hit, F.col("__us")),
        "evidence_refs": F.when(hit, F.array_sort(F.array_union("evidence_refs", "__refs"))).otherwise(F.array_sort("evidence_refs")),
        "confidence": F.when(hit, F.greatest(F.coalesce("confidence", F.lit(0.78)), F.lit(floor))).otherwise(F.col("confidence")),
        "lateral_class": F.when(hit, "confirmed_lateral").otherwise(F.col("lateral_class"))}).drop("__us", "__refs")


def target_exec_burst(stages: DataFrame, execs: DataFrame, categories: list[str], before_sec: int = 0, after_sec: int = 3600, min_events: int = 3, min_categories: int = 2,
                      floor: int = 2, base: float = 0.86, per_extra: float = 0.008, bonus_cap: float = 0.04, cap: float = 0.9) -> DataFrame:
    """Risky execs on the target after the earliest suspected stage of a pair.

    ``execs``: host, us and one boolean column per category. A signal needs
    ``floor`` hits, and ``min_events`` hits or ``min_categories`` categories.
    """
    first = (stages.where(F.col("lateral_class").isin("suspected_lateral", "likely_lateral") & F.col("us").isNotNull())
             .groupBy("src", "dst").agg(F.min("us").alias("us")).withColumn("host", F.col("dst")).withColumn("pair", F.concat_ws("\u0001", "src", "dst")))
    hot = execs.where(any_of(*[F.col(c) for c in categories])).select("host", "us", F.lit(1).cast("bigint").alias("__one"), *[F.col(c).cast("int").alias(c) for c in categories])
    d = with_window_agg(first, hot, ["host"], "pair", "us", "us", before_sec * SEC, after_sec * SEC,
                        {"event_count": ("__one", "sum"), "first_us": ("us", "min"), **{f"__c_{c}": (c, "max") for c in categories}})
    n_cat = sum((F.coalesce(F.col(f"__c_{c}"), F.lit(0)) for c in categories), F.lit(0))
    names = F.array_compact(F.array(*[F.when(F.col(f"__c_{c}") == 1, F.lit(c)) for c in sorted(categories)]))
    bonus = F.least(F.lit(bonus_cap), F.greatest(F.col("event_count") - min_events, F.lit(0)) * per_extra)
    return (d.where((F.col("event_count") >= floor) & ((F.col("event_count") >= min_events) | (n_cat >= min_categories)))
            .select("src", "dst", "first_us", "event_count", names.alias("categories"), F.round(F.least(F.lit(cap), F.lit(base) + bonus), 2).alias("confidence"), F.lit("likely_lateral").alias("lateral_class")))


def upgrade_with_burst(stages: DataFrame, signals: DataFrame, floor: float = 0.78) -> DataFrame:
    """Suspected stages of a signalled pair become likely; signals without such a stage are added."""
    s = signals.select("src", "dst", F.col("confidence").alias("__c"), F.col("first_us").alias("__f"))
    d = stages.select("src", "dst", "us", "lateral_class", "confidence").join(s, ["src", "dst"], "left")
    hit = F.col("__c").isNotNull() & (F.col("lateral_class") == "suspected_lateral")
    up = d.select("src", "dst", "us", F.when(hit, "likely_lateral").otherwise(F.col("lateral_class")).alias("lateral_class"),
                  F.when(hit, F.greatest(F.coalesce("confidence", F.lit(floor)), F.col("__c"))).otherwise(F.col("confidence")).alias("confidence"))
    done = stages.where("lateral_class = 'suspected_lateral'").select("src", "dst").distinct()
    new = signals.join(done, ["src", "dst"], "left_anti").select("src", "dst", F.col("first_us").alias("us"), F.lit("likely_lateral").alias("lateral_class"), "confidence")
    return up.unionByName(new)


def ancestor_replay(starts: DataFrame, processes: DataFrame, now_us: int | None = None, max_depth: int = 16, max_age_sec: int = 86_400) -> DataFrame:
    """Up to ``max_depth`` ancestors per start row, nearest first, until one is too old or unknown.

    ``starts``: start_id, parent, us. ``processes``: instance, parent, us,
    evidence_id, one row per instance. Age is measured from ``now_us``, else from
    the start row. Each level is one equi join, written out before the next.
    """
    level = starts.select("start_id", F.col("parent").alias("want"), F.col("us").alias("start_us") if now_us is None else F.lit(now_us).alias("start_us"))
    out = None
    for depth in range(1, max_depth + 1):
        hit = level.join(processes, F.col("want") == F.col("instance")).where(F.col("start_us") - F.col("us") <= max_age_sec * SEC)
        hit = cut_lineage(hit.select("start_id", "start_us", F.lit(depth).alias("depth"), F.col("evidence_id").alias("ancestor_ref"), "instance", F.col("parent").alias("next")))
        if hit.isEmpty():
            break
        part = hit.select("start_id", "depth", "ancestor_ref")
        out = part if out is None else out.unionByName(part)
        level = hit.where("next IS NOT NULL AND next <> ''").select("start_id", F.col("next").alias("want"), "start_us")
    return out if out is not None else hit.select("start_id", "depth", "ancestor_ref")


# Fixed values (J24): words beside which any address in a text counts as a target.
HINT_WORDS = ("ssh", "sshpass", "scp", "sftp", "rsync", "nc ", "ncat", "s.phtml", "webshell")


def second_hop_targets(commands: DataFrame, logins: DataFrame, sources: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Hosts to look at next: internal addresses named by commands on source hosts or by web
    and gateway rows to them, and hosts reached by accepted logins from them.
    Sources drop out; so does an address that is the cut-off start of another one.

    ``commands``: host, command. ``web``: host, text of a request or alert.
    ``logins``: src, dst, result.
    """
    if web is not None:
        commands = commands.select("host", "command").unionByName(web.select("host", F.col("text").alias("command")))
    src = sources.select("host").distinct()
    text = F.coalesce(F.col("command"), F.lit(""))
    hinted = any_of(*[F.lower(text).contains(w) for w in HINT_WORDS])
    ips = F.array_union(F.transform(ssh_targets(text), lambda t: t["ip"]), F.when(hinted, extract_ipv4s(text)).otherwise(F.array().cast("array<string>")))
    named = commands.join(src, "host", "left_semi").select(F.explode(ips).alias("target")).where(in_cidrs(F.col("target"), PRIVATE_CIDRS)).distinct()
    named = named.join(src, F.col("target") == F.col("host"), "left_anti")
    # An address is ambiguous when it equals a proper prefix of another one.
    prefixes = named.select(F.explode(F.transform(F.sequence(F.lit(7), F.greatest(F.length("target") - 1, F.lit(7))), lambda n: F.when(n < F.length("target"), F.left(F.col("target"), n)))).alias("target")).where("target IS NOT NULL").distinct()
    named = named.join(prefixes, "target", "left_anti")
    reached = (logins.where("result = 'accepted'").join(src.withColumnRenamed("host", "src"), "src", "left_semi").select(F.col("dst").alias("target")).distinct()
               .join(src, F.col("target") == F.col("host"), "left_anti"))
    return named.withColumn("via", F.lit("command")).unionByName(reached.withColumn("via", F.lit("login"))).groupBy("target").agg(F.array_sort(F.collect_set("via")).alias("via"))
