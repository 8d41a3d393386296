"""Filters and condition compilers (F01-F17). All of it is plain Column logic."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.common import SEVERITY_RANK, any_of, first_match, first_present, severity_rank, text_or_null
from ..functions.net import in_cidrs, normalize_ip
from ..functions import web
from .normalize import GENERIC_HOSTS, strip_port

HOST_FIELDS = ("_victim_host", "host", "host_name", "hostname", "host_ip", "log_source", "__source__")
ATTACKER_FIELDS = ("src_ip", "ip", "remote_addr", "client_ip", "source_ip")
# Fixed values (F14): fragments that make a web row look like an attack.
ATTACK_HINTS = ("webshell", "/cmdi/", "cmd=", "command=", "exec=", "shell=", ";id", ";whoami", ";cat", ".php?c=", ".php?cmd", "upload.php",
                "../", "union select", "<script", "${jndi:")


def _bound(text: str, name: str) -> Column:
    if not re.search(r"(Z|[+-]\d{2}:?\d{2})$", text):
        raise ValueError(f"{name} must be an ISO 8601 timestamp with timezone offset")
    return F.lit(text).cast("timestamp")


def strict_window(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows provably inside [start, end]; unknown time drops. Bounds need an offset.

    The bare column is compared, so the test reaches the scan.
    """
    if start:
        df = df.where(F.col(ts) >= _bound(start, "time_start"))
    if end:
        df = df.where(F.col(ts) <= _bound(end, "time_end"))
    return df


def lenient_window(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Drops only rows known to be outside; unknown time stays."""
    test = F.lit(True)
    if start:
        test = test & (F.col(ts) >= F.lit(start).cast("timestamp"))
    if end:
        test = test & (F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.where(F.col(ts).isNull() | test)


def window_report(df: DataFrame, ts: str, by: list[str], start: str, end: str) -> DataFrame:
    """Original, kept, dropped and kept-without-time counts per group."""
    inside = F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("original"), F.count_if(F.col(ts).isNull() | inside).alias("kept"),
                               F.count_if(~inside).alias("dropped"), F.count_if(F.col(ts).isNull()).alias("untimestamped"))


def host_candidates(df: DataFrame) -> Column:
    """All host names of a row; generic ones count only when alone."""
    names = F.array_compact(F.array(*[text_or_null(F.col(c)) for c in HOST_FIELDS if c in df.columns]))
    real = F.filter(names, lambda n: ~F.lower(n).isin(*GENERIC_HOSTS))
    return F.array_distinct(F.when(F.size(real) > 0, real).otherwise(names))


def host_scope(df: DataFrame, hosts) -> DataFrame:
    """Rows with a host candidate among ``hosts``; an empty list keeps all."""
    hosts = [str(h) for h in hosts or []]
    return df.where(F.arrays_overlap(host_candidates(df), F.array(*[F.lit(h) for h in hosts]))) if hosts else df


def port_scope(df: DataFrame, column: str, ports) -> DataFrame:
    """Rows on one of the ports; a missing or non-numeric port passes."""
    ports = [int(p) for p in ports or [] if str(p).isdigit()]
    port = F.col(column).try_cast("int")
    return df.where(port.isNull() | port.isin(*ports)) if ports else df


def severity_floor(df: DataFrame, column: str, floor: str) -> DataFrame:
    return df.where(severity_rank(F.col(column)) <= SEVERITY_RANK.get(floor, 9))


class Conditions:
    """Compiles condition trees (dicts) to boolean columns that are never NULL.

    Nodes: ``all`` / ``any`` / ``not``; leaves name what they look at. An empty
    condition is true, an unknown leaf false, a column the table lacks counts
    as missing. ``predicates`` are named conditions, ``extensions`` extra leaf
    compilers ``(conditions, value, node) -> Column``.
    """

    def __init__(self, df: DataFrame, predicates: dict | None = None, extensions: dict | None = None, web_listeners=()):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.predicates = predicates or {}
        self.extensions = extensions or {}
        self.web_listeners = web_listeners

    def has(self, name: str) -> bool:
        return name in self.types

    def text(self, name: str) -> Column:
        """The column as text, missing as empty; lists joined by blanks."""
        if name == "command_text":
            return self.text("command")
        if not self.has(name):
            return F.lit("")
        c = F.col(name)
        return F.coalesce(F.array_join(c, " ") if isinstance(self.types[name], T.ArrayType) else c.cast("string"), F.lit(""))

    def names(self, name: str) -> Column:
        if not self.has(name):
            return F.array().cast("array<string>")
        c = F.col(name)
        return F.coalesce(c if isinstance(self.types[name], T.ArrayType) else F.array(c.cast("string")), F.array().cast("array<string>"))

    def port(self, name: str) -> Column:
        return F.col(name).try_cast("int") if self.has(name) else F.lit(None).cast("int")

    def one_of(self, name: str, value) -> Column:
        return self.text(name).isin(*[str(v) for v in (value if isinstance(value, (list, tuple, set)) else [value])])

    def regex(self, text: Column, pattern: str, flags: str | None) -> Column:
        return text.rlike(("(?i)" if "i" in (flags or "i").lower() else "") + pattern)

    def compile(self, node: dict | None) -> Column:
        if not node:
            return F.lit(True)
        for key, value in node.items():
            build = self.extensions.get(key) or LEAVES.get(key)
            if build is not None:
                return F.coalesce(build(self, value, node), F.lit(False))
        return F.lit(False)


def _every(parts, start, join):
    for p in parts:
        start = join(start, p)
    return start


def _guardrail(c: Conditions, value, node) -> Column:
    hit = F.array_sort(F.array_intersect(c.names("matched_rules"), F.array(*[F.lit(v) for v in node.get("matched_rules_any", [])])))
    skip = node.get("skip_when") or {}
    unless = any_of(*[c.compile(c.predicates.get(p) or {"never": 1}) for p in skip.get("unless_predicates_any", [])])
    return (F.size(hit) > 0) & ~(F.coalesce(F.get(hit, F.lit(0)) == skip.get("matched_rule", ""), F.lit(False)) & unless)


def _typed(c: Conditions, value, node) -> Column:
    if value == "guardrail_matched":
        return _guardrail(c, value, node)
    if value == "shell_exe":
        from .normalize import SHELL_NAMES, SHELL_PATHS
        return any_of(F.lower(c.text("comm")).isin(*SHELL_NAMES), *[c.text("exe").startswith(p) for p in SHELL_PATHS])
    if value == "persistence_write":
        from .commands import command_writes_persistence
        return command_writes_persistence(c.text("command"))
    return F.lit(False)


def _overlap(c: Conditions, column: str, values, fold: bool = False) -> Column:
    have = F.transform(c.names(column), lambda x: F.lower(x)) if fold else c.names(column)
    return F.arrays_overlap(have, F.array(*[F.lit(str(v).lower() if fold else str(v)) for v in values]))


LEAVES = {
    "type": _typed,
    "all": lambda c, v, n: _every([c.compile(x) for x in v], F.lit(True), lambda a, b: a & b),
    "any": lambda c, v, n: _every([c.compile(x) for x in v], F.lit(False), lambda a, b: a | b),
    "not": lambda c, v, n: ~c.compile(v),
    "risk_module": lambda c, v, n: c.one_of("risk_module", v),
    "matched_rules_any": lambda c, v, n: _overlap(c, "matched_rules", v),
    "matched_rules_all": lambda c, v, n: F.size(F.array_except(F.array(*[F.lit(x) for x in v]), c.names("matched_rules"))) == 0,
    "command_regex": lambda c, v, n: c.regex(c.text("command"), v, n.get("flags")),
    "command_contains": lambda c, v, n: F.lower(c.text("command")).contains(str(v).lower()),
    "event_type": lambda c, v, n: c.one_of("event_type", v),
    "event_type_in": lambda c, v, n: c.one_of("event_type", v),
    "field_equals": lambda c, v, n: c.one_of(v["field"], v.get("value")) & (c.text(v["field"]) != "" if c.has(v["field"]) else F.lit(False)),
    "field_regex": lambda c, v, n: c.regex(c.text(v.get("field") or "command_text"), v["pattern"], v.get("flags")),
    "predicate": lambda c, v, n: c.compile(c.predicates[v]) if v in c.predicates else F.lit(False),
    "listener_port_in": lambda c, v, n: c.port(n.get("port_field") or "listener_port").isin(*v),
    "dst_port_in": lambda c, v, n: c.port("dst_port").isin(*v),
    "dst_ip_in": lambda c, v, n: c.one_of("dst_ip", v),
    "severity_in": lambda c, v, n: c.one_of("severity", v),
    "web_listener_process": lambda c, v, n: any_of(*[F.lower(c.text("listener_process")).contains(w) for w in c.web_listeners]) if v else F.lit(False),
    "rule_id": lambda c, v, n: c.one_of("rule_id", v),
    "rule_id_in": lambda c, v, n: c.one_of("rule_id", v),
    "risk_level_in": lambda c, v, n: any_of(*[F.lower(c.text(k)).isin(*[str(x).lower() for x in v]) for k in ("risk_level", "severity")]),
    "program_in": lambda c, v, n: c.one_of("program", v),
    "tags_contains": lambda c, v, n: _overlap(c, "tags", v, fold=True),
    "user": lambda c, v, n: c.one_of("user", v),
    "message_regex": lambda c, v, n: c.regex(F.concat_ws(" ", c.text("command"), c.text("message"), c.text("rule_name")), v, n.get("flags")),
}


def compile_condition(df: DataFrame, node: dict | None, **kw) -> Column:
    return Conditions(df, **kw).compile(node)


class ThreeValued:
    """Condition trees where unknown stays unknown: NULL through AND, OR and NOT.

    Leaves: ``{"field", "op", "value", "fold"}``. A missing value, a value of
    another type, and an address that does not parse are unknown. ``match``
    turns the outcome into a filter: unknown never matches, not even under NOT.
    """

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def match(self, node: dict) -> Column:
        return F.coalesce(self.compile(node), F.lit(False))

    def compile(self, node: dict) -> Column:
        if "not" in node:
            return ~self.compile(node["not"])
        if "all" in node:
            return _every([self.compile(x) for x in node["all"]], F.lit(True), lambda a, b: a & b)
        if "any" in node:
            return _every([self.compile(x) for x in node["any"]], F.lit(False), lambda a, b: a | b)
        name, op = node["field"], node["op"]
        kind = self.types.get(name)
        if op == "exists":
            return F.col(name).isNotNull() if kind is not None else F.lit(False)
        if kind is None:
            return F.lit(None).cast("boolean")
        return self.leaf(F.col(name), kind, op, node)

    def leaf(self, c: Column, kind, op: str, node: dict) -> Column:
        value, fold, unknown = node.get("value"), bool(node.get("fold")), F.lit(None).cast("boolean")
        is_text, is_list = isinstance(kind, T.StringType), isinstance(kind, T.ArrayType)
        if op == "is_empty":
            return c == "" if is_text else F.when(c.isNotNull(), F.size(c) == 0) if is_list else unknown
        if op.startswith("array_"):
            if not is_list:
                return unknown
            # An empty list says no to every list test.
            nonempty = F.when(c.isNotNull(), F.size(c) > 0)
            if op == "array_eq":
                want = F.array(*[F.lit(v) for v in value]) if value else F.array().cast("array<string>")
                low = lambda a: F.transform(a, lambda x: F.lower(x))
                return nonempty & ((low(c) == low(want)) if fold else (c == want))
            test = lambda x: self.leaf(x, kind.elementType, node["each"]["op"], node["each"])
            if op == "array_any":
                return nonempty & F.exists(c, test)
            if op == "array_all":
                return nonempty & F.forall(c, test)
            return nonempty & ~F.exists(c, test)
        if op in ("eq", "neq"):
            out = self.equal(c, kind, value, fold)
            return ~out if op == "neq" else out
        if op in ("in", "not_in"):
            out = _every([self.equal(c, kind, v, fold) for v in value], F.lit(False), lambda a, b: a | b)
            return ~out if op == "not_in" else out
        if op in ("gt", "gte", "lt", "lte", "between"):
            if not isinstance(kind, T.NumericType):
                return unknown
            if op == "between":
                return c.between(*value)
            return {"gt": c > value, "gte": c >= value, "lt": c < value, "lte": c <= value}[op]
        if not is_text:
            return unknown
        s, v = (F.lower(c), str(value).lower()) if fold else (c, str(value))
        if op == "prefix":
            return s.startswith(v)
        if op == "suffix":
            return s.endswith(v)
        if op == "contains":
            return s.contains(v)
        if op == "regex":
            return c.rlike(("(?i)" if fold else "") + str(value))
        if op == "cidr":
            return in_cidrs(c, [value])
        raise ValueError(f"unknown operator {op}")

    @staticmethod
    def equal(c: Column, kind, value, fold: bool) -> Column:
        same = (isinstance(value, bool) and isinstance(kind, T.BooleanType)) or (isinstance(value, str) and isinstance(kind, T.StringType)) or (
            isinstance(value, (int, float)) and not isinstance(value, bool) and isinstance(kind, T.NumericType))
        if not same:
            return F.lit(None).cast("boolean")
        return F.lower(c) == value.lower() if fold and isinstance(value, str) else c == F.lit(value)


def cidr_match(c: Column, cidrs) -> Column:
    """An empty list matches everything, an invalid address nothing."""
    return F.coalesce(in_cidrs(c, cidrs), F.lit(False)) if cidrs else F.lit(True)


def cidr_lookup(df: DataFrame, ip_num: str, networks: DataFrame) -> DataFrame:
    """Rows with each network (``cidr``, ``lo``, ``hi``) holding the address.

    For network tables too long for literals. Networks are aligned blocks, so
    the first 16 bits are an equi key; a wider block is listed under each of
    its 16-bit parts.
    """
    nets = networks.withColumn("__p", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    return (df.withColumn("__q", F.shiftright(F.col(ip_num), 16))
            .join(nets, (F.col("__q") == F.col("__p")) & F.col(ip_num).between(F.col("lo"), F.col("hi"))).drop("__p", "__q"))


def pattern_hits(text: Column, patterns) -> Column:
    """The literal patterns found in a text, in list order, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: low.contains(F.lower(p)))


def url_pattern_hits(text: Column, patterns) -> Column:
    """As ``pattern_hits``, on the decoded URL text."""
    return pattern_hits(web.decoded_text(text), patterns)


def false_positive_reason(df: DataFrame, catalog: dict) -> Column:
    """Name of the first benign pattern, NULL if none holds.

    URL fragments first; payload patterns (``contains`` all, or ``regex``)
    count only without exploit tokens.
    """
    url, payload = F.coalesce(first_present(df, ["url"]), F.lit("")), F.trim(F.coalesce(first_present(df, ["payload"]), F.lit("")))
    tokens = lambda ts: any_of(*[F.lower(payload).contains(t.lower()) for t in ts])
    pairs = [(url.contains(f), f"whitelist_url:{f}") for f in catalog.get("whitelist_url_fragments", [])]
    for p in catalog.get("patterns", []):
        if p.get("contains"):
            hit = _every([payload.contains(x) for x in p["contains"]], F.lit(True), lambda a, b: a & b)
            pairs.append(((payload != "") & hit & ~tokens(catalog["exploit_tokens_text"]), p["id"]))
        if p.get("regex"):
            hit = payload.rlike(("(?i)" if p.get("flags") == "i" else "") + p["regex"])
            pairs.append(((payload != "") & hit & ~tokens(catalog["exploit_tokens_regex"]), p["id"]))
    return first_match(*pairs, default=F.lit(None).cast("string"))


def degraded_scope(df: DataFrame, target_ip: str | None, source_ips=(), hosts=(), paths=()) -> Column:
    """Gateway rows of a time-only fetch that belong to the incident.

    Target and source are checked only where the row carries them, then the
    host and path tokens must overlap; a target match alone is enough last.
    """
    targets = F.array_compact(F.array(*[strip_port(text_or_null(F.col(c))) for c in ("target_ip", "upstream_addr", "dst_ip") if c in df.columns], F.lit(None).cast("string")))
    sources = F.array_compact(F.array(*[normalize_ip(F.col(c).cast("string")) for c in ATTACKER_FIELDS if c in df.columns], F.lit(None).cast("string")))
    host = F.coalesce(web.url_host(F.col("url")), F.lower(first_present(df, ["http_host", "host"])))
    path = F.regexp_extract(web.normalize_url_path(F.col("url")), r"^([^?]*)", 1)
    lits = lambda xs: F.array(*[F.lit(str(x).lower()) for x in xs]) if xs else F.array().cast("array<string>")
    on_target = F.array_contains(targets, target_ip) if target_ip else F.lit(False)
    wrong_target = (F.size(targets) > 0) & ~on_target if target_ip else F.lit(False)
    wrong_source = (F.size(sources) > 0) & ~F.arrays_overlap(sources, lits(source_ips)) if source_ips else F.lit(False)
    path_near = any_of(*[(path != "") & (path.contains(p) | F.lit(p).contains(path)) for p in [str(x).lower() for x in paths]])
    host_ok = F.coalesce(host.isin(*[str(h).lower() for h in hosts]), F.lit(False)) if hosts else F.lit(False)
    host_path = host_ok & (path.isin(*[str(p).lower() for p in paths]) if paths else F.lit(True))
    return ~wrong_target & ~wrong_source & (host_path | path_near | (on_target if target_ip else F.lit(False)))


def attacker_events(df: DataFrame, attacker_ip: str, fields=ATTACKER_FIELDS) -> DataFrame:
    """Rows where any source field is the attacker, in canonical form."""
    return df.where(any_of(*[normalize_ip(F.col(c).cast("string")) == attacker_ip for c in fields if c in df.columns]))


def attack_like(df: DataFrame, hints=ATTACK_HINTS) -> Column:
    """WAF rows, and web rows whose URL, payload or rule holds a hint."""
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in ("url", "payload", "request_body", "args", "rule_name", "attack_type") if c in df.columns]))
    waf = (F.col("asset_type") == "waf_alert") if "asset_type" in df.columns else F.lit(False)
    return any_of(waf, *[text.contains(h) for h in hints])


def attack_like_rows(df: DataFrame, id_col: str, initial_refs: DataFrame | None = None, hints=ATTACK_HINTS) -> DataFrame:
    """Attack-like rows plus rows whose id is a known first-access reference."""
    hot = df.where(attack_like(df, hints))
    if initial_refs is None:
        return hot
    rest = df.where(~attack_like(df, hints))
    return hot.unionByName(rest.join(initial_refs.select(F.col(initial_refs.columns[0]).alias(id_col)).distinct(), id_col, "left_semi").select(*df.columns))


def self_noise(df: DataFrame, own_pids=(), own_images=(), audit_key_prefix: str = "") -> Column:
    """True for rows of the collector itself and for its own audit rule upkeep.

    Upkeep: ``auditctl`` with a rule action whose key is ours, by an unknown process
    or changing rules.
    """
    f = lambda n: F.coalesce(first_present(df, [n]), F.lit(""))
    exe, parent, cmd = f("exe"), f("parent_exe"), f("command_line")
    base = lambda c: F.lower(F.element_at(F.split(c, r"[\\/]"), -1))
    own = any_of(*[f(c).isin(*[str(p) for p in own_pids]) for c in ("pid", "ppid") if own_pids],
                 *[base(c).isin(*[i.lower() for i in own_images]) for c in (exe, parent) if own_images])
    auditctl = cmd.rlike(r"^(\S*/)?auditctl\s") & cmd.rlike(r"\s-(a|A|d|D|w|W|l|s)\b")
    ours = cmd.contains(audit_key_prefix) if audit_key_prefix else F.lit(False)
    unknown = (exe == "") & (f("comm") == "")
    upkeep = auditctl & ((ours & (cmd.rlike(r"\s-(a|A|d|D|w|W)\b") | unknown)) | (unknown & f("key").startswith(audit_key_prefix or "\u0000")))
    return any_of(own, upkeep)


def sensitive_paths(df: DataFrame, column: str, sensitive) -> DataFrame:
    """Keeps the paths on the list (itself or below a directory); rows left empty drop."""
    exact = [p for p in sensitive if not p.endswith("/")]
    roots = [p for p in sensitive if p.endswith("/")]
    test = lambda p: any_of(p.isin(*exact), *[p.startswith(r) for r in roots])
    return df.withColumn(column, F.filter(column, test)).where(F.size(column) > 0)


def missing_fields(df: DataFrame, required, either=()) -> Column:
    """Names of the mandatory fields a row lacks; ``either`` are groups of which one is enough."""
    lack = [F.when(text_or_null(F.col(c)).isNull() if c in df.columns else F.lit(True), F.lit(c)) for c in required]
    lack += [F.when(first_present(df, group).isNull(), F.lit("|".join(group))) for group in either]
    return F.array_compact(F.array(*lack))


def split_rejects(df: DataFrame, required, either=()) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rejects with ``missing``)."""
    d = df.withColumn("missing", missing_fields(df, required, either))
    return d.where(F.size("missing") == 0).drop("missing"), d.where(F.size("missing") > 0)
