"""Declared evidence joins and table diffs."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import web
from ..functions.common import first_present, text_or_null
from ..functions.net import extract_ipv4s, normalize_ip
from .blocks import carried, exists_in_window, interval_pairs
from .rollups import first_rows

# Columns whose exact match is a match of addresses.
IP_FIELDS = ("src_ip", "source_ip", "attacker_ip", "client_ip", "remote_addr", "rhost", "target_ip", "host_ip", "upstream_addr")
# Fixed values: (before, after) seconds of the named windows.
WINDOWS = {"host_behavior_chain": (300, 300), "attack_success": (300, 1800), "alert_context": (600, 600), "alert_confirmation_fetch": (600, 1800),
           "lateral_movement": (1800, 7200), "trace_default": (86400, 21600)}
# Join ids and the key each one matches on.
CATALOGUE = {
    "waf_to_web": ("waf_alert", "web_access_log", [("src_ip", "src_ip", "exact")], "alert_context"),
    "web_to_exec": ("web_access_log", "host_exec", [("target_ip", "host_ip", "exact")], "attack_success"),
    "exec_to_connect": ("host_exec", "host_connect", [("host", "host", "exact"), ("listener_pid", "listener_pid", "exact")], "host_behavior_chain"),
    "exec_to_file": ("host_exec", "host_file_op", [("host", "host", "exact")], "host_behavior_chain"),
    "ssh_to_exec": ("ssh_auth", "host_exec", [("host", "host", "exact")], "lateral_movement"),
    "attacker_ip_to_ssh": ("waf_alert", "ssh_auth", [("src_ip", "src_ip", "exact")], "trace_default"),
    "host_ip_to_ssh": ("host_exec", "ssh_auth", [("host_ip", "src_ip", "exact")], "lateral_movement"),
    "connect_to_dns": ("host_connect", "dns_log", [("dst_ip", "response", "dns_answer_ip")], "host_behavior_chain"),
}


@dataclass
class Key:
    left: str
    right: str
    match: str = "exact"
    optional: bool = False


@dataclass
class JoinSpec:
    """One declared join; ``path`` makes it a chain of other joins.

    ``secondary`` keys never decide, they only add confidence. The window is
    seconds before and after the left row's time.
    """

    join_id: str
    left_type: str = ""
    right_type: str = ""
    keys: list[Key] = field(default_factory=list)
    secondary: list[Key] = field(default_factory=list)
    before_sec: int | None = None
    after_sec: int | None = None
    base: float = 0.85
    top: float = 0.95
    step: float = 0.05
    path: list[str] = field(default_factory=list)
    stage: str | None = None


def catalogue_spec(join_id: str) -> JoinSpec:
    left, right, keys, window = CATALOGUE[join_id]
    return JoinSpec(join_id, left, right, [Key(*k) for k in keys], before_sec=WINDOWS[window][0], after_sec=WINDOWS[window][1])


def key_value(c: Column, name: str, match: str) -> Column:
    """The comparable form of a key: address, path or folded text; blank is NULL."""
    if match == "path_prefix":
        return text_or_null(web.normalize_url_path(c.cast("string")))
    if match == "exact" and name.lower() in IP_FIELDS:
        return normalize_ip(c.cast("string"))
    if match in ("hostname_to_ip", "dns_answer_ip"):
        return text_or_null(F.trim(c.cast("string")))
    return F.lower(F.trim(text_or_null(c)))


def _test(key: Key, i: int) -> Column:
    l, r = F.col(f"__l{i}"), F.col(f"__r{i}")
    if key.match == "path_prefix":
        return l.startswith(r) | r.startswith(l)
    return l == r


def _prepared(df: DataFrame, side: str, spec: JoinSpec, us: str, id_col: str, host_ips: DataFrame | None) -> DataFrame:
    keys = [*spec.keys, *spec.secondary]
    out = df.select(F.col(id_col).cast("string").alias(f"{side}_ref"), F.col(us).alias(f"{side}_us"),
                    *[key_value(F.col(getattr(k, side)) if getattr(k, side) in df.columns else F.lit(None), getattr(k, side),
                                "exact" if k.match == "exact" else k.match).alias(f"__{side[0]}{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        name = f"__{side[0]}{i}"
        # Either side an address field makes an exact key an address match.
        other = getattr(k, "right" if side == "left" else "left")
        if k.match == "exact" and other.lower() in IP_FIELDS and getattr(k, side).lower() not in IP_FIELDS:
            out = out.withColumn(name, normalize_ip(F.col(name)))
        if k.match == "hostname_to_ip" and side == "left":
            m = (host_ips.select(F.col("host").alias(name), F.col("ip").alias("__ip")) if host_ips is not None
                 else out.sparkSession.createDataFrame([], f"`{name}` string, __ip string"))
            out = out.join(m, name, "left").withColumn(name, F.coalesce("__ip", normalize_ip(F.col(name)))).drop("__ip")
        if k.match == "dns_answer_ip" and side == "right":
            if k.optional or k in spec.secondary:
                raise ValueError("a DNS answer key must be required")
            out = out.withColumn(name, F.explode(extract_ipv4s(F.col(name))))
    return out


def matrix_join(left: DataFrame, right: DataFrame, spec: JoinSpec, anchor_us: int | None = None, left_us: str = "us", right_us: str = "us",
                left_id: str = "evidence_id", right_id: str = "evidence_id", host_ips: DataFrame | None = None, limit: int | None = None, counted: bool = False) -> DataFrame:
    """Edges of one declared join: ids, times, matched keys, confidence.

    All required keys must match; hits of optional and secondary keys raise the
    confidence by ``step`` up to ``top``. The window counts only with an anchor
    time; it is measured from the left row (the anchor if that has no time), and
    a right row without time passes. An edge needs one matched key at least.

    ``limit`` keeps the first edges by left (time, id), right (time, id). It
    first finds the matched left rows, which is linear, and pairs only the first
    ``limit`` of them: each yields an edge, so no other edge can be among the first.

    ``counted`` gives (join_id, left_ref, n, confidence): the number of edges of
    every left id that has one, and the best confidence. Right rows alike in all
    that a join looks at are folded to one row with their number first.
    """
    if counted and limit is not None:
        raise ValueError("edges are counted whole")
    l, r = _prepared(left, "left", spec, left_us, left_id, host_ips), _prepared(right, "right", spec, right_us, right_id, host_ips)
    keys = [*spec.keys, *spec.secondary]
    must = [i for i, k in enumerate(spec.keys) if not k.optional]
    equi = [i for i in must if spec.keys[i].match != "path_prefix"]
    if not equi:
        raise ValueError(f"{spec.join_id}: needs a required key that can be hashed; use prefix_join for paths alone")
    for i in must:
        l, r = l.where(F.col(f"__l{i}").isNotNull()), r.where(F.col(f"__r{i}").isNotNull())
    windowed = anchor_us is not None and spec.before_sec is not None
    before, after = int((spec.before_sec or 0) * 1e6), int((spec.after_sec or 0) * 1e6)
    if windowed:
        l = l.withColumn("__at", F.coalesce("left_us", F.lit(anchor_us)))
    if counted:
        r = r.groupBy(*[f"__r{i}" for i in range(len(keys))], *(["right_us"] if windowed else [])).agg(F.count(F.lit(1)).alias("__n"))
    rest = [_test(keys[i], i) for i in must if i not in equi]

    def pairs(a: DataFrame) -> DataFrame:
        on = [(f"__l{i}", f"__r{i}") for i in equi]
        cond = reduce(lambda x, y: x & y, [F.col(x) == F.col(y) for x, y in on])
        if windowed:
            got = interval_pairs(a, r, on, "__at", "right_us", before, after)
            got = got.unionByName(a.join(r.where("right_us IS NULL"), cond))
        else:
            got = a.join(r, cond)
        return reduce(lambda d, t: d.where(t), rest, got)

    if limit is None:
        edges = pairs(l)
    else:
        order = [F.col("left_us").asc_nulls_last(), F.col("left_ref")]
        if rest:
            first = pairs(l).select(*l.columns).distinct()
        else:
            rk = r.select(*[F.col(f"__r{i}").alias(f"__l{i}") for i in equi], "right_us")
            names = [f"__l{i}" for i in equi]
            if windowed:
                untimed = rk.where("right_us IS NULL").select(*names).distinct().withColumn("__u", F.lit(True))
                first = exists_in_window(l, rk, names, "__at", "right_us", before, after, "__hit").join(untimed, names, "left")
                first = first.where(F.col("__hit") | F.col("__u")).select(*l.columns)
            else:
                first = l.join(rk.select(*names).distinct(), names, "left_semi").select(*l.columns)
        edges = pairs(first.orderBy(*order).limit(limit))
        edges = edges.orderBy(*order, F.col("right_us").asc_nulls_last(), F.col("right_ref")).limit(limit)
    soft = [i for i, k in enumerate(keys) if i not in must]
    hits = sum((F.coalesce(_test(keys[i], i), F.lit(False)).cast("int") for i in soft), F.lit(0))
    confidence = F.round(F.least(F.lit(spec.top), F.lit(spec.base) + F.lit(spec.step) * hits), 2).alias("confidence")
    if counted:
        got = edges.select("left_ref", "__n", confidence).groupBy("left_ref").agg(F.sum("__n").alias("n"), F.max("confidence").alias("confidence"))
        return got.select(F.lit(spec.join_id).alias("join_id"), "left_ref", "n", "confidence")
    matched = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.lit(i in must) | F.coalesce(_test(k, i), F.lit(False)), F.struct(F.lit(k.left).alias("k"), F.col(f"__l{i}").alias("v"))) for i, k in enumerate(keys)])))
    return edges.select(F.lit(spec.join_id).alias("join_id"), "left_ref", "right_ref", "left_us", "right_us", matched.alias("match_keys"), confidence)


def matched_rights(left: DataFrame, right: DataFrame, spec: JoinSpec, anchor_us: int | None = None, left_us: str = "us", right_us: str = "us",
                   left_id: str = "evidence_id", right_id: str = "evidence_id", host_ips: DataFrame | None = None) -> DataFrame:
    """(join_id, right_ref, confidence): the right ids of ``matrix_join``'s edges with their best confidence.

    No edges are formed, except for path keys: whether a left row fits is asked
    once for every set of optional and secondary keys.
    """
    keys = [*spec.keys, *spec.secondary]
    must = [i for i, k in enumerate(spec.keys) if not k.optional]
    if any(spec.keys[i].match == "path_prefix" for i in must) or any(k.match == "path_prefix" for k in keys):
        edges = matrix_join(left, right, spec, anchor_us, left_us, right_us, left_id, right_id, host_ips)
        return edges.groupBy("join_id", "right_ref").agg(F.max("confidence").alias("confidence"))
    if not must:
        raise ValueError(f"{spec.join_id}: needs a required key that can be hashed; use prefix_join for paths alone")
    names = [f"__k{i}" for i in range(len(keys))]
    l = _prepared(left, "left", spec, left_us, left_id, host_ips).select(F.col("left_us").cast("bigint").alias("__at"), *[F.col(f"__l{i}").alias(n) for i, n in enumerate(names)])
    r = _prepared(right, "right", spec, right_us, right_id, host_ips).select("right_ref", F.col("right_us").cast("bigint").alias("right_us"), *[F.col(f"__r{i}").alias(n) for i, n in enumerate(names)])
    for i in must:
        l, r = l.where(F.col(names[i]).isNotNull()), r.where(F.col(names[i]).isNotNull())
    windowed = anchor_us is not None and spec.before_sec is not None
    before, after = int((spec.before_sec or 0) * 1e6), int((spec.after_sec or 0) * 1e6)
    l = l.withColumn("__at", F.coalesce("__at", F.lit(anchor_us).cast("bigint")))
    soft, found = [i for i in range(len(keys)) if i not in must], []
    for n in range(len(soft) + 1):
        for more in combinations(soft, n):
            on = [names[i] for i in (*must, *more)]
            level = F.round(F.least(F.lit(spec.top), F.lit(spec.base) + F.lit(spec.step) * n), 2).alias("confidence")
            near = r.select("right_ref", "right_us", *on)
            untimed = near.where("right_us IS NULL") if windowed else near
            found.append(untimed.join(l.select(*on).distinct(), on, "left_semi").select("right_ref", level))
            if windowed:
                hit = exists_in_window(near.where("right_us IS NOT NULL"), l.select(*on, "__at"), on, "right_us", "__at", after, before, "__hit")
                found.append(hit.where("__hit").select("right_ref", level))
    got = reduce(DataFrame.unionByName, found).groupBy("right_ref").agg(F.max("confidence").alias("confidence"))
    return got.select(F.lit(spec.join_id).alias("join_id"), "right_ref", "confidence")


def prefix_join(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Pairs where one path starts with the other, as equi joins.

    Every path offers its own prefixes (of lengths the other side has) as keys,
    so nothing is compared with everything.
    """
    # The distinct path lengths of the other side, one short array.
    lens = lambda df, c: df.select(F.length(c).alias("__n")).where("__n > 0").distinct().agg(F.collect_set("__n")).scalar()
    offers = lambda df, c, other, oc: (df.withColumn("__ns", lens(other, oc)).withColumn("__k", F.explode(
        F.transform(F.filter("__ns", lambda n: n <= F.length(F.col(c))), lambda n: F.left(F.col(c), n)))).drop("__ns"))
    l, r = left.where(F.col(left_path) != ""), right.where(F.col(right_path) != "")
    down = offers(l, left_path, r, right_path).join(r, F.col("__k") == F.col(right_path)).drop("__k")
    up = offers(r, right_path, l, left_path).join(l, F.col("__k") == F.col(left_path)).where(F.col(left_path) != F.col(right_path)).drop("__k")
    return down.unionByName(up)


def expand_path(join_id: str, specs: dict[str, JoinSpec]) -> list[str]:
    """Atomic join ids of a join, in order; an unknown id expands to nothing."""
    spec = specs.get(join_id)
    if spec is None:
        return []
    return [s for step in spec.path for s in expand_path(step, specs)] if spec.path else [join_id]


def run_chain(tables: dict[str, DataFrame], specs: dict[str, JoinSpec], chain: list[str], anchor_us: int | None = None,
              limit: int | None = None, left_refs: DataFrame | None = None, **kw) -> DataFrame:
    """Edges of all steps of a chain, each step once, each edge once; all of them unless ``limit`` is given.

    The loop builds one plan over the declared specs; no data comes back here.
    ``left_refs`` (ref) asks for the edges of these left ids only.
    """
    if left_refs is None:
        return _each_step(matrix_join, tables, specs, chain, anchor_us, limit=limit, **kw)
    own = F.col(kw.get("left_id", "evidence_id")).cast("string") == F.col("__ref")
    asked = left_refs.select(F.col("ref").cast("string").alias("__ref"))
    return _each_step(lambda l, *a, **k: matrix_join(l.join(asked, own, "left_semi"), *a, **k), tables, specs, chain, anchor_us, limit=limit, **kw)


def chain_rights(tables: dict[str, DataFrame], specs: dict[str, JoinSpec], chain: list[str], anchor_us: int | None = None, **kw) -> DataFrame:
    """``matched_rights`` of all steps of a chain: what ``run_chain`` finds on the right sides, without its edges."""
    return _each_step(matched_rights, tables, specs, chain, anchor_us, **kw)


def _each_step(join, tables: dict[str, DataFrame], specs: dict[str, JoinSpec], chain: list[str], anchor_us: int | None, **kw) -> DataFrame:
    steps = list(dict.fromkeys(s for j in chain for s in expand_path(j, specs)))
    parts = [join(tables[specs[s].left_type], tables[specs[s].right_type], specs[s], anchor_us, **kw)
             for s in steps if specs[s].left_type in tables and specs[s].right_type in tables]
    if not parts:
        raise ValueError("no step of the chain has both tables")
    return reduce(DataFrame.unionByName, parts)


def _ids(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(j, i) for i, j in enumerate(ids)], "join_id string, step int")


def chain_gaps(edges: DataFrame, specs: dict[str, JoinSpec], chain: list[str], present_types: list[str] | None = None) -> DataFrame:
    """``no_match`` for steps without an edge, ``not_evaluated`` when a table was missing."""
    steps = list(dict.fromkeys(s for j in chain for s in expand_path(j, specs)))
    spec_rows = _ids(edges.sparkSession, steps)
    absent = [s for s in steps if present_types is not None and not {specs[s].left_type, specs[s].right_type} <= set(present_types)]
    return (spec_rows.join(edges.select("join_id").distinct(), "join_id", "left_anti")
            .select("join_id", F.when(F.col("join_id").isin(*absent), "not_evaluated").otherwise("no_match").alias("gap")))


def join_coverage(edges: DataFrame, gaps: DataFrame, chain: list[str]) -> DataFrame:
    """Per join matched / no_match / not_evaluated, with the overall ratio."""
    m, g = edges.select("join_id").distinct().withColumn("__m", F.lit(True)), gaps.where("gap = 'no_match'").select("join_id").distinct().withColumn("__g", F.lit(True))
    per = _ids(edges.sparkSession, list(dict.fromkeys(chain))).join(m, "join_id", "left").join(g, "join_id", "left").select(
        "join_id", F.when(F.col("__m"), "matched").when(F.col("__g"), "no_match").otherwise("not_evaluated").alias("status"))
    ratio = per.agg(F.round(F.count_if(F.col("status") == "matched") / F.count(F.lit(1)), 2))
    return per.withColumn("coverage_ratio", ratio.scalar())


def scenario_edges(tables: dict[str, DataFrame], specs: dict[str, JoinSpec], patterns: dict[str, dict], priority: list[tuple[str, str]],
                   scenarios: list[str], alert_us: int | None, **kw) -> tuple[str, DataFrame]:
    """Anchor pattern of the scenarios by priority, then its chain. Returns (pattern, edges)."""
    pid = next((p for s, p in priority if s in set(scenarios) and p in patterns), None)
    if pid is None:
        raise ValueError("no anchor pattern for the scenarios")
    return pid, run_chain(tables, specs, patterns[pid]["chain"], alert_us, **kw)


def investigation_window(alert_us: int, window: str, start_us: int | None = None, end_us: int | None = None) -> tuple[int, int]:
    """Asked bounds, filled from the named window around the alert."""
    before, after = WINDOWS[window]
    return (start_us if start_us is not None else alert_us - before * 1_000_000, end_us if end_us is not None else alert_us + after * 1_000_000)


def publish(c: Column) -> Column:
    """Keys under which a value can be found: itself (``*`` if unknown) and ``~`` for anyone."""
    return F.array(F.coalesce(c.cast("string"), F.lit("*")), F.lit("~"))


def probe(c: Column) -> Column:
    """Keys a value asks for: itself and the unknown ones; an unknown value asks for anyone."""
    return F.when(c.isNull(), F.array(F.lit("~"))).otherwise(F.array(c.cast("string"), F.lit("*")))


def related_in_window(left: DataFrame, right: DataFrame, left_id: str, hosts: str, listener: str, us: str, window_sec: int, out: str) -> DataFrame:
    """Flag left rows with a related right row at most ``window_sec`` away.

    Related: a host in common (``hosts`` is an array), and the same listener
    when both have one. Rows without host or time relate to nothing. The
    null-tolerant listener is split into equal keys, and the right side is
    folded to one row per key and block before the shuffle.
    """
    ask = left.select(left_id, us, F.explode(hosts).alias("__h"), listener).withColumn("__k", F.explode(probe(F.col(listener))))
    have = right.select(us, F.explode(hosts).alias("__h"), listener).withColumn("__k", F.explode(publish(F.col(listener))))
    w = int(window_sec * 1_000_000)
    hit = exists_in_window(ask.where(F.col(us).isNotNull()), have, ["__h", "__k"], us, us, w, w, out)
    return left.join(hit.where(F.col(out)).select(left_id, out).distinct(), left_id, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def nearest_asof(left: DataFrame, right: DataFrame, keys: list[str], us: str, left_id: str, right_id: str, retention_us: int, block_sec: int = 3600) -> DataFrame:
    """Nearest right row in time, either side, per left row; NULL beyond ``retention_us``.

    The earlier row wins a tie. Adds ``near_id`` and ``near_us``.
    """
    lt, rt = left.schema[left_id].dataType, right.schema[right_id].dataType
    none = F.lit(None).cast(f"struct<us:bigint,id:{rt.simpleString()}>")
    u = (left.select(*keys, us, F.col(left_id).alias("__id"), none.alias("__r"))
         .unionByName(right.select(*keys, us, F.lit(None).cast(lt).alias("__id"), F.struct(F.col(us).cast("bigint").alias("us"), F.col(right_id).alias("id")).alias("__r")))
         .where(F.col(us).isNotNull()).withColumn("__c", F.col("__id").isNotNull().cast("int"))
         .withColumn("__o", F.struct(F.col("__id"), F.col("__r.id"))))
    # A right row at the same time counts as earlier: it sorts before the left row.
    u = carried(u, keys, us, [us, "__c", "__o"], F.col("__r"), "__p", block_sec * 1_000_000)
    u = carried(u, keys, us, [us, "__c", "__o"], F.col("__r"), "__n", block_sec * 1_000_000, forward=False).where("__id IS NOT NULL")
    gp, gn = F.col(us) - F.col("__p.us"), F.col("__n.us") - F.col(us)
    best = F.when(gp.isNotNull() & (gn.isNull() | (gp <= gn)), F.col("__p")).otherwise(F.col("__n"))
    near = u.select(F.col("__id").alias(left_id), best.alias("__b"), F.col(us).alias("__t"))
    near = near.where(F.abs(F.col("__b.us") - F.col("__t")) <= retention_us).select(left_id, F.col("__b.id").alias("near_id"), F.col("__b.us").alias("near_us"))
    return left.join(near, left_id, "left")


def process_attribution(events: DataFrame, lifetimes: DataFrame, id_col: str, us: str = "us") -> DataFrame:
    """``listener`` and ``attribution`` of an event by its process lifetime, then its parent's.

    ``events``: host, pid, ppid, time. ``lifetimes``: host, pid, ppid, start_us,
    end_us, listener; of overlapping ones the latest start counts. A lifetime
    that contains the event but names another parent is a contradiction: the
    event is ``unknown`` and no other guess is made. Without any: ``unrelated``.
    """
    def lookup(ev: DataFrame, pid: str, out: str) -> DataFrame:
        life = F.struct("end_us", F.col("ppid").alias("parent"), "listener")
        lt = "struct<end_us:bigint,parent:bigint,listener:string>"
        u = (ev.select("host", F.col(pid).cast("bigint").alias("__pid"), F.col(us).alias("__t"), F.col(id_col).alias("__id"), F.lit(None).cast(lt).alias("__l"), F.lit(1).alias("__c"))
             .unionByName(lifetimes.select("host", F.col("pid").cast("bigint").alias("__pid"), F.col("start_us").alias("__t"), F.lit(None).cast(ev.schema[id_col].dataType).alias("__id"), life.cast(lt).alias("__l"), F.lit(0).alias("__c"))))
        got = carried(u.where("__pid IS NOT NULL AND __t IS NOT NULL"), ["host", "__pid"], "__t", ["__t", "__c"], F.col("__l"), "__cur").where("__c = 1 AND __cur.end_us >= __t")
        return got.select(F.col("__id").alias(id_col), F.col("__cur").alias(out))

    d = events.join(lookup(events, "pid", "__own"), id_col, "left").join(lookup(events, "ppid", "__par"), id_col, "left")
    conflict = F.col("__own").isNotNull() & (F.col("ppid") > 0) & (F.col("__own.parent") > 0) & (F.col("ppid") != F.col("__own.parent"))
    status = F.when(F.coalesce(conflict, F.lit(False)), "unknown").when(F.col("__own").isNotNull(), "verified").when(F.col("__par").isNotNull(), "verified_parent").otherwise("unrelated")
    return d.withColumn("attribution", status).withColumn("listener", F.when(status != "unknown", F.coalesce("__own.listener", "__par.listener"))).drop("__own", "__par")


def host_ip_map(sources: list[DataFrame]) -> DataFrame:
    """host → ip from several (host, ip) tables; later tables overwrite, then the larger address."""
    parts = [s.select(F.col("host").cast("string").alias("host"), F.col("ip").cast("string").alias("ip"), F.lit(i).alias("__o")) for i, s in enumerate(sources)]
    u = reduce(DataFrame.unionByName, parts).where("host <> '' AND ip <> ''")
    return u.groupBy("host").agg(F.max_by("ip", F.struct("__o", "ip")).alias("ip"))


def enrich_from_inventory(rows: DataFrame, inventory: DataFrame, host: str = "host") -> DataFrame:
    """Left lookup of inventory columns by host; the first inventory row of a host counts."""
    inv = inventory.groupBy("host").agg(*[F.min_by(c, F.struct(*inventory.columns)).alias(c) for c in inventory.columns if c != "host"])
    return rows.join(inv.withColumnRenamed("host", "__h"), F.col(host) == F.col("__h"), "left").withColumn("registered", F.col("__h").isNotNull()).drop("__h")


def merge_stages(matrix: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Matrix stages, their confidence raised by heuristic stages that share evidence, plus the other heuristic stages.

    Needs ``stage_id``, ``evidence_refs``, ``confidence`` (0.7 if NULL). The raise
    is the per-reference maximum, taken before the join.
    """
    conf = lambda c: F.coalesce(F.col(c), F.lit(0.7))
    mref = matrix.select("stage_id", F.explode("evidence_refs").alias("ref"))
    href = heuristic.select("stage_id", conf("confidence").alias("c"), F.explode("evidence_refs").alias("ref"))
    shared = mref.select("ref").distinct()
    overlap = href.join(shared, "ref", "left_semi").select("stage_id").distinct()
    best = href.groupBy("ref").agg(F.max("c").alias("c"))
    lift = mref.join(best, "ref").groupBy("stage_id").agg(F.max("c").alias("__c"))
    kept = (matrix.join(lift, "stage_id", "left").withColumn("confidence", F.round(F.greatest(conf("confidence"), F.coalesce("__c", F.lit(0.0))), 2))
            .withColumn("source", F.lit("matrix")).drop("__c"))
    new = heuristic.join(overlap, "stage_id", "left_anti").withColumn("source", F.lit("heuristic_fallback"))
    return kept.unionByName(new)


def merge_initial_access(matrix: DataFrame, heuristic: DataFrame, group: list[str]) -> DataFrame:
    """One entry point per group out of two candidates; the other one's evidence supports it.

    Rank: request outcome, vector, matrix before heuristic, time. Needs
    ``outcome_rank``, ``vector_rank``, ``us`` and ``evidence_refs``; the first
    reference of the winner is the primary one.
    """
    u = matrix.withColumn("__h", F.lit(0)).unionByName(heuristic.withColumn("__h", F.lit(1)))
    row = F.struct(*[c for c in u.columns if c not in (*group, "__h")])
    g = u.groupBy(*group).agg(F.min_by(row, F.struct("outcome_rank", "vector_rank", "__h", "us")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_refs")))).alias("all"),
                              F.array_join(F.array_sort(F.collect_set(F.when(F.col("__h") == 0, "matrix").otherwise("heuristic"))), "+").alias("correlation_source"))
    primary = F.get("r.evidence_refs", F.lit(0))
    return g.select(*group, "r.us", "r.outcome_rank", "r.vector_rank", primary.alias("primary_ref"), F.array_remove("all", primary).alias("supporting_refs"), "correlation_source")


def attach_join_ids(stages: DataFrame, edges: DataFrame) -> DataFrame:
    """``join_ids`` of the edges that touch a stage's evidence, sorted."""
    refs = edges.select("join_id", F.explode(F.array("left_ref", "right_ref")).alias("ref")).distinct()
    got = stages.select("stage_id", F.explode("evidence_refs").alias("ref")).join(refs, "ref").groupBy("stage_id").agg(F.array_sort(F.collect_set("join_id")).alias("join_ids"))
    return stages.join(got, "stage_id", "left").withColumn("join_ids", F.coalesce("join_ids", F.array().cast("array<string>")))


def stages_from_edges(edges: DataFrame, evidence: DataFrame, stage_of: dict[str, str]) -> DataFrame:
    """Edges to stages, merged on (stage, host of the right row, second).

    References and join ids are united (sorted), confidence is the maximum.
    Joins without a stage, and enrichment joins, give none.
    """
    lookup = F.create_map(*[v for k, s in stage_of.items() for v in (F.lit(k), F.lit(s))])
    e = edges.withColumn("stage", lookup[F.col("join_id")]).where("stage IS NOT NULL AND stage <> 'enrichment'")
    r = evidence.select(F.col("evidence_id").cast("string").alias("right_ref"), "host", "us")
    j = e.drop("right_us").join(r, "right_ref")
    return (j.groupBy("stage", "host", F.floor(F.col("us") / 1_000_000).cast("bigint").alias("second"))
            .agg(F.array_sort(F.array_union(F.collect_set("left_ref"), F.collect_set("right_ref"))).alias("evidence_refs"),
                 F.array_sort(F.collect_set("join_id")).alias("join_ids"), F.round(F.max("confidence"), 2).alias("confidence")))


def route_by_id(records: DataFrame, id_col: str, key_col: str, routes: dict[str, list[str]]) -> DataFrame:
    """One row per (record, module): keyed records by their key, others by the keys seen with their id.

    Keys no module asks for, and ids without a keyed record, drop out. Each id
    folds to a small module set before the join.
    """
    pairs = [(k, m) for m, ks in routes.items() for k in ks]
    of_key = F.create_map(*[v for k in dict.fromkeys(k for k, _ in pairs) for v in (F.lit(k), F.array(*[F.lit(m) for kk, m in pairs if kk == k]))])
    keyed = text_or_null(F.col(key_col))
    d = records.withColumn("__own", F.when(keyed.isNotNull(), F.coalesce(of_key[keyed], F.array().cast("array<string>"))))
    by_id = (d.where("__own IS NOT NULL").select(id_col, F.explode("__own").alias("m")).groupBy(id_col).agg(F.array_sort(F.collect_set("m")).alias("__by_id")))
    out = d.where("__own IS NOT NULL").withColumn("__by_id", F.lit(None).cast("array<string>")).unionByName(d.where("__own IS NULL").join(by_id, id_col))
    return out.withColumn("module", F.explode(F.coalesce("__own", "__by_id"))).drop("__own", "__by_id")


def snapshot_diff(previous: DataFrame, current: DataFrame, keys: list[str], fields: list[str], full: bool = False) -> DataFrame:
    """created / modified / deleted between two snapshots; all ``observed`` when a full baseline is due.

    ``changed`` lists the differing fields in the given order, ``old`` their old
    values. NULL equals NULL. Rows with a NULL or empty key take no part; of
    rows with one key the one with the greatest fields stays.
    """
    known = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]))
    previous, current = known(previous), known(current)
    if full:
        return current.select(*keys).distinct().select(*keys, F.lit("observed").alias("action"), F.array().cast("array<string>").alias("changed"), F.create_map().cast("map<string,string>").alias("old"))
    p = previous.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__p"))
    c = current.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__c"))
    j = p.join(c, keys, "full_outer")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"__p.{f}").eqNullSafe(F.col(f"__c.{f}")), F.lit(f)) for f in fields]))
    both = F.col("__p").isNotNull() & F.col("__c").isNotNull()
    action = F.when(F.col("__p").isNull(), "created").when(F.col("__c").isNull(), "deleted").when(F.size(diff) > 0, "modified")
    old = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"__p.{f}").cast("string") for f in fields]))
    return (j.withColumn("action", action).where("action IS NOT NULL")
            .select(*keys, "action", F.when(both, diff).otherwise(F.array().cast("array<string>")).alias("changed"),
                    F.when(both, F.map_filter(old, lambda k, v: F.array_contains(diff, k))).when(F.col("__c").isNull(), old).otherwise(F.create_map().cast("map<string,string>")).alias("old")))


def process_diff(previous: DataFrame, current: DataFrame, keys: list[str], fields: list[str], full: bool = False) -> DataFrame:
    """Snapshot diff of processes; an empty snapshot after a filled one is an error, not a mass exit."""
    if current.limit(1).count() == 0 and previous.limit(1).count() > 0:
        raise ValueError("process snapshot holds no record with pid and start time")
    names = {"created": "started", "deleted": "exited", "modified": "changed"}
    d = snapshot_diff(previous, current, keys, fields, full)
    return d.withColumn("action", reduce(lambda c, kv: F.when(F.col("action") == kv[0], kv[1]).otherwise(c), names.items(), F.col("action")))


def line_diff(previous: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """Lines added and removed per key, as multisets: (key, line, removed, added).

    Counts per line fold map-side, so a text with millions of equal lines is
    cheap; the order of lines is not kept.
    """
    lines = lambda df, n: df.select(key, F.explode(F.split(F.col(text), "\n")).alias("line")).withColumn("__n", F.lit(n))
    d = lines(previous, -1).unionByName(lines(current, 1)).groupBy(key, "line").agg(F.sum("__n").alias("__d")).where("__d <> 0")
    return d.select(key, "line", F.greatest(-F.col("__d"), F.lit(0)).cast("bigint").alias("removed"), F.greatest("__d", F.lit(0)).cast("bigint").alias("added"))


def capped_diff(diff: DataFrame, key: str, max_lines: int) -> DataFrame:
    """At most ``max_lines`` diff lines per key (report form), with ``truncated``."""
    total = diff.groupBy(key).agg(F.count(F.lit(1)).alias("__t"))
    return first_rows(diff, [key], ["line"], max_lines).drop("__rn").join(total, key).withColumn("truncated", F.col("__t") > max_lines).drop("__t")


def asset_topology(networks: DataFrame, hosts: DataFrame, assets: DataFrame) -> DataFrame:
    """network → host → asset links by coverage tokens, with the kind of link.

    ``hosts``: host_id, hostname, aliases, network_id; ``assets``: asset_id,
    coverage (tokens). One matched host is ``single``, several are ``coverage``,
    none is ``platform``.
    """
    names = hosts.select("host_id", "network_id", F.explode(F.array_union(F.array(F.lower(F.trim("hostname"))), F.transform("aliases", lambda a: F.lower(F.trim(a))))).alias("token")).where("token <> ''")
    tokens = assets.select("asset_id", F.explode_outer("coverage").alias("t")).withColumn("token", F.lower(F.trim("t")))
    links = tokens.join(names, "token").select("asset_id", "host_id", "network_id").distinct()
    kinds = (assets.select("asset_id").join(links.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_hosts")), "asset_id", "left")
             .withColumn("link_kind", F.when(F.col("n_hosts") == 1, "single").when(F.col("n_hosts") > 1, "coverage").otherwise("platform")))
    return (kinds.select("asset_id", "link_kind").join(links, "asset_id", "left").join(networks.select("network_id", "network"), "network_id", "left"))
