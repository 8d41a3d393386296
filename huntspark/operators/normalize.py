"""Raw rows to evidence."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X, web
from ..functions.common import any_of, first_present, text_or_null
from ..functions.net import normalize_ip
from ..functions.timefn import normalize_timestamp

# Host names that identify nobody.
GENERIC_HOSTS = ("localhost", "localhost.localdomain", "127.0.0.1", "::1")
SOURCE_IP_FIELDS = ("src_ip", "source_ip", "remote_addr", "client_ip", "ip", "rhost")


@dataclass
class Asset:
    """What normalisation must know about one source."""

    asset_id: str
    asset_type: str
    connector_id: str = ""
    aliases: dict = field(default_factory=dict)
    time_field: str | None = None
    timezone: str = "UTC"
    offset_minutes: int = 0
    syslog_year: int = 2024
    masking: dict = field(default_factory=dict)
    repairs: tuple = ()


def apply_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Fill canonical columns from source columns; a value already there stays.

    Empty text counts as missing. Earlier aliases win.
    """
    targets: dict[str, list[str]] = {}
    for src, dst in aliases.items():
        targets.setdefault(dst, [dst]).append(src)
    return df.withColumns({dst: first_present(df, names) for dst, names in targets.items()
                           if any(n in df.columns for n in names)})


def normalize_source_ips(df: DataFrame, fields=SOURCE_IP_FIELDS) -> DataFrame:
    """Canonical addresses; an invalid value stays visible as it was."""
    return df.withColumns({f: F.coalesce(normalize_ip(F.col(f).cast("string")), F.col(f).cast("string"))
                           for f in fields if f in df.columns})


def strip_port(c: Column) -> Column:
    """``1.2.3.4:80`` to ``1.2.3.4``; other text only trimmed."""
    ip = F.regexp_extract(c, r"^\s*((?:\d{1,3}\.){3}\d{1,3})(?::\d+)?\s*$", 1)
    return F.when(ip != "", ip).otherwise(F.trim(c))


def is_generic(host: Column) -> Column:
    return F.lower(host).isin(*GENERIC_HOSTS)


def canonicalize_host(df: DataFrame, asset_type: str = "") -> DataFrame:
    """Columns ``host`` and ``host_ip``; names that say nothing give way to the address.

    Gateway rows (WAF, access log) take the victim's address or site name.
    """
    target = strip_port(first_present(df, ["target_ip"]))
    ip = strip_port(first_present(df, ["host_ip", "log_source", "_victim_host", "__source__"]))
    host = first_present(df, ["host", "host_name", "hostname"])
    weak = host.isNull() | is_generic(host)
    new = {"target_ip": target} if "target_ip" in df.columns else {}
    if asset_type == "waf_alert":
        site = first_present(df, ["http_host", "victim_host"])
        new["host"] = F.when(weak, F.coalesce(target, site, host)).otherwise(host)
        new["host_ip"] = ip
    elif asset_type == "web_access_log":
        other = F.when(ip.isNotNull() & weak, ip).otherwise(host)
        new["host"] = F.when(target.isNotNull(), F.when(weak, target).otherwise(host)).otherwise(other)
        new["host_ip"] = F.when(target.isNotNull(), ip).otherwise(F.coalesce(ip, host))
    else:
        new["host"] = F.when(ip.isNotNull() & weak, ip).otherwise(host)
        new["host_ip"] = F.coalesce(ip, host)
    return df.withColumns(new)


def content_digest(namespace: list[str], cols: list[str]) -> Column:
    """SHA-256 head over the namespace and the named columns in name order."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]))
    return F.left(F.sha2(F.concat(F.lit("|".join(namespace) + "|"), body), 256), F.lit(32))


def evidence_id(df: DataFrame, asset: Asset) -> Column:
    """Caller's id; else v3 for rows with native id, host and time; else v2.

    Computed before masking and independent of row and column order.
    """
    ns = [asset.asset_id, asset.connector_id, asset.asset_type]
    cols = [c for c in df.columns if c != "evidence_id"]
    prefix = asset.asset_type.replace("_", "-")
    native = (first_present(df, ["audit_id", "event_id"]).isNotNull() & first_present(df, ["host_ip", "host"]).isNotNull()
              & first_present(df, ["time", "timestamp"]).isNotNull())
    transport = {"_ingest_time", "_receive_time", "_pack_id"}
    v3 = F.concat(F.lit(f"{prefix}-v3-"), content_digest(ns, [c for c in cols if c not in transport]))
    v2 = F.concat(F.lit(f"{prefix}-v2-"), content_digest(ns, cols))
    return F.coalesce(first_present(df, ["evidence_id"]), F.when(native, v3).otherwise(v2))


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Known JSON keys of a text column as ``column.key`` columns, never overwriting."""
    parsed = F.from_json(F.col(column).cast("string"), schema)
    names = df.select(parsed.alias("p")).select("p.*").columns
    return df.withColumns({f"{column}.{n}": parsed[n] for n in names if f"{column}.{n}" not in df.columns})


def flatten_json_long(df: DataFrame, id_col: str, column: str, depth: int = 4) -> DataFrame:
    """Keys that are not known beforehand: one (id, path, value) row per leaf or level.

    JSON objects inside values open up to ``depth`` levels.
    """
    kv = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
    level = df.select(id_col, F.lit(column).alias("p"), F.explode(kv(F.col(column))).alias("e"))
    level = level.select(id_col, F.concat_ws(".", "p", "e.key").alias("path"), F.col("e.value").alias("value"))
    out = level
    for _ in range(depth - 1):
        level = (level.where(F.trim("value").startswith("{")).select(id_col, "path", F.explode(kv(F.col("value"))).alias("e"))
                 .select(id_col, F.concat_ws(".", "path", "e.key").alias("path"), F.col("e.value").alias("value")))
        out = out.unionByName(level)
    return out


def resolve_payload(df: DataFrame) -> DataFrame:
    """``payload``, ``payload_source``, ``payload_encoding``: what the request carried.

    Order: body in the request JSON, payload, body columns; the URL if all are
    empty. Base64 text is decoded when mostly printable.
    """
    absent = lambda c: F.when(~F.trim(c).isin("", "null", "None"), c)
    found: list[tuple[str, Column]] = []
    if "request" in df.columns:
        body = F.coalesce(F.get_json_object("request", "$.body"), F.get_json_object("request", "$.Body"))
        found.append(("request.json.body", absent(body)))
    found += [(n, absent(F.col(f"`{n}`").cast("string"))) for n in ("payload", "request.body", "request_body", "body") if n in df.columns]
    raw = F.coalesce(*[c for _, c in found]) if found else F.lit(None).cast("string")
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in found]) if found else F.lit(None).cast("string")
    url = F.coalesce(F.col("url"), F.lit("")) if "url" in df.columns else F.lit("")
    d = df.withColumn("__raw", raw).withColumn("__dec", X.decode_base64(F.col("__raw"))).withColumn("payload_source", source)
    return (d.withColumn("payload", F.coalesce("__dec.text", "__raw", url))
            .withColumn("payload_encoding", F.when(F.col("__raw").isNotNull(), F.col("__dec.encoding"))).drop("__raw", "__dec"))


def derive_waf_victim(df: DataFrame) -> DataFrame:
    """``target_ip`` from the upstream address, ``http_host`` from host columns or URL."""
    ip = strip_port(F.coalesce(first_present(df, ["target_ip"]), first_present(df, ["upstream_addr"])))
    named = [F.when(F.trim(F.col(n)) != "-", text_or_null(F.col(n))) for n in ("http_host", "victim_host", "host") if n in df.columns]
    from_url = [web.url_host(F.col(n)) for n in ("url", "payload") if n in df.columns]
    header = ([F.regexp_extract("request_header", r"(?im)^host:\s*([^\s:]+)", 1)] if "request_header" in df.columns else [])
    site = F.coalesce(*[F.trim(c) for c in named], *[F.regexp_replace(c, r":\d+$", "") for c in from_url],
                      *[F.when(h != "", h) for h in header], F.lit(None).cast("string"))
    return df.withColumns({"target_ip": ip, "http_host": site})


def repair_events(df: DataFrame, steps) -> DataFrame:
    """Profile steps in order: ``unwrap`` JSON into missing columns, ``fallback_time``,
    ``source_to_host``. A value already there is never replaced."""
    for step in steps:
        if step["type"] == "unwrap":
            json = F.col(step["column"])
            df = df.withColumns({name: F.coalesce(first_present(df, [name]), text_or_null(F.get_json_object(json, f"$.{path}")))
                                 for name, path in step["fields"].items()})
        elif step["type"] == "fallback_time":
            df = df.withColumn(step["target"], first_present(df, [step["target"], *step["from"]]))
        elif step["type"] == "source_to_host":
            host = first_present(df, ["host"])
            src = first_present(df, step["from"])
            df = df.withColumn("host", F.when(host.isNull() | is_generic(host), F.coalesce(src, host)).otherwise(host))
        else:
            raise ValueError(f"unknown repair step {step['type']}")
    return df


def normalize_events(df: DataFrame, asset: Asset) -> DataFrame:
    """Whole chain: alias, repair, addresses, victim, host, time, id, mask."""
    d = repair_events(apply_aliases(df, asset.aliases), asset.repairs)
    d = normalize_source_ips(d)
    if asset.asset_type == "waf_alert":
        d = resolve_payload(canonicalize_host(derive_waf_victim(d), asset.asset_type))
    else:
        d = canonicalize_host(d, asset.asset_type)
    parse = lambda n: normalize_timestamp(F.col(n), asset.timezone, asset.syslog_year, asset.offset_minutes)
    fields = [n for n in dict.fromkeys([asset.time_field, "timestamp", "time", "_ingest_time"]) if n and n in d.columns]
    d = d.withColumn("ts", F.coalesce(*[parse(n) for n in fields]) if fields else F.lit(None).cast("timestamp"))
    d = d.withColumn("evidence_id", evidence_id(d.drop("ts"), asset))
    return d.withColumns({c: X.mask(F.col(c), rule) for c, rule in asset.masking.items() if c in d.columns})


def mask_nested(df: DataFrame, path: str, rule) -> DataFrame:
    """Mask rule for a dotted path into a struct column."""
    top, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(top, X.mask(F.col(top), rule))
    return df.withColumn(top, F.when(F.col(top).isNotNull(), F.col(top).withField(rest, X.mask(F.col(path), rule))))


# Syslog event types that are SSH logins.
SSH_SUCCESS_TYPES = ("ssh_login_success",)
SSH_FAILED_TYPES = ("ssh_login_failed", "ssh_invalid_user", "ssh_auth_attempts_exceeded", "auth_failure")


def syslog_to_ssh_auth(syslog: DataFrame, success=SSH_SUCCESS_TYPES, failed=SSH_FAILED_TYPES) -> DataFrame:
    """SSH rows of the risk alerts with ``result``; other types drop out.

    Missing source or user come from the message.
    """
    kind = F.lower("event_type")
    msg = F.coalesce(F.col("message"), F.lit(""))
    ip, user = F.regexp_extract(msg, r"from\s+((?:\d{1,3}\.){3}\d{1,3})", 1), F.regexp_extract(msg, r"for (?:invalid user )?(\S+) from", 1)
    return (syslog.where(kind.isin(*success, *failed))
            .withColumn("result", F.when(kind.isin(*success), "accepted").otherwise("failed"))
            .withColumn("src_ip", F.coalesce(first_present(syslog, ["src_ip"]), text_or_null(ip)))
            .withColumn("user", F.coalesce(first_present(syslog, ["user"]), text_or_null(user))))


# Fixed values (W01): how a failed login shows when the row has no result.
FAIL_TYPES = ("ssh_login_failed", "auth_failure")
FAIL_MESSAGE = r"(?i)Failed password|Invalid user|authentication failure"


def failed_logins(rows: DataFrame, failed=FAIL_TYPES) -> DataFrame:
    """Rows that are failed logins, with host, source and user filled from other columns or the message.

    An explicit result decides; without one the event type or the message does.
    Rows without time drop out; missing texts become empty, as the wave search expects.
    """
    msg = F.coalesce(first_present(rows, ["message"]), F.lit(""))
    given = F.lower(first_present(rows, ["result"]))
    derived = F.lower(first_present(rows, ["event_type"])).isin(*failed) | msg.rlike(FAIL_MESSAGE)
    real = lambda c: F.when(~F.lower(c).isin("null", "localhost"), c)
    src = F.coalesce(real(first_present(rows, ["src_ip"])), text_or_null(F.regexp_extract(msg, r"from\s+((?:\d{1,3}\.){3}\d{1,3})", 1)))
    user = F.coalesce(real(first_present(rows, ["user"])), text_or_null(F.regexp_extract(msg, r"for (?:invalid user )?(\S+) from", 1)))
    host = real(first_present(rows, ["_victim_host", "host", "host_ip", "host_name"]))
    hit = F.coalesce(given.isin("failed", "failure", "fail"), derived, F.lit(False))
    return rows.where(hit & F.col("us").isNotNull()).withColumns({"host": F.coalesce(host, src, F.lit("")), "src_ip": F.coalesce(src, F.lit("")), "user": F.coalesce(user, F.lit("")), "result": F.lit("failed")})


def add_missing(base: DataFrame, extra: DataFrame, id_col: str) -> DataFrame:
    """``base`` plus the rows of ``extra`` whose id it lacks; ids NULL count as new."""
    new = extra.join(base.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_anti")
    return base.unionByName(new, allowMissingColumns=True)


# Fixed values for reading an exec row.
NON_INTERACTIVE_TTYS = ("(none)", "none", "?")
SHELL_NAMES = ("sh", "bash", "dash", "zsh", "ksh", "ash")
SHELL_PATHS = ("/bin/sh", "/bin/bash", "/bin/dash", "/usr/bin/sh", "/usr/bin/bash", "/usr/bin/zsh")
WEB_LISTENERS = ("nginx", "httpd", "apache2", "apache", "caddy", "openresty")
SSH_LISTENERS = ("sshd", "ssh")
WEB_PORTS = ("80", "443", "8080")
WEBSHELL_MARKS = ("s.phtml", "webshell", "/uploads/")


def non_interactive(df: DataFrame) -> Column:
    """Tri-state: NULL when neither ``has_tty`` nor ``tty`` tells."""
    has = F.col("has_tty").cast("boolean") if "has_tty" in df.columns else F.lit(None).cast("boolean")
    tty = F.lower(F.trim(F.col("tty"))) if "tty" in df.columns else F.lit(None).cast("string")
    return F.coalesce(~has, F.when(tty.isin(*NON_INTERACTIVE_TTYS), True).when(tty.startswith("pts"), False))


def exec_context_flags(df: DataFrame, webshell_patterns=()) -> DataFrame:
    """``web_listener_exec``, ``non_interactive`` and ``shell_exe``."""
    listener = F.lower(F.coalesce(first_present(df, ["listener_process", "pid_name"]), F.lit("")))
    port = F.coalesce(first_present(df, ["listener_port"]), F.lit(""))
    text = F.lower(F.coalesce(first_present(df, ["command_line", "command", "comm"]), F.lit("")))
    quiet = non_interactive(df)
    shell = text.contains("sh") & (text.contains("-c") | text.contains("bash"))
    indirect = text.contains("s.phtml") | (text.contains("uploads/") & text.contains("curl"))
    not_tty = F.coalesce(quiet, F.lit(True))
    via_ssh = listener.isin(*SSH_LISTENERS) | (port == "22")
    via_web = listener.isin(*WEB_LISTENERS) | port.isin(*WEB_PORTS)
    marked = any_of(*[text.contains(m.lower()) for m in (*WEBSHELL_MARKS, *webshell_patterns)])
    web_exec = F.when(via_ssh, indirect & not_tty).when(via_web & (shell | marked), F.lit(True)).otherwise(indirect & not_tty)
    comm = F.lower(first_present(df, ["comm"]))
    exe = first_present(df, ["exe"])
    return df.withColumns({"web_listener_exec": web_exec, "non_interactive": quiet,
                           "shell_exe": any_of(comm.isin(*SHELL_NAMES), *[exe.startswith(p) for p in SHELL_PATHS])})


def raw_behavior(df: DataFrame) -> Column:
    """One line that says what the row did; needs ``asset_type``."""
    g = lambda *names: F.coalesce(first_present(df, names), F.lit(""))
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    kind = F.col("asset_type")
    url, cmd, dst = g("url", "request_uri", "uri"), g("command_line", "cmdline", "command"), g("dst_ip", "remote_ip")
    query, path, msg = g("query", "qname", "domain"), g("file_path", "path"), g("message", "raw_line")
    web_text = F.concat_ws(" ", part("", F.upper(g("method", "request_method"))), part("", F.when(url != "", url).otherwise(path)), part("status=", g("status", "http_status")),
                           part("action=", g("action", "waf_action")), part("rule=", X.short_text(g("rule_name", "rule_id"), 160)), part("payload=", X.short_text(g("payload"))))
    port = g("dst_port", "remote_port")
    endpoint = F.when((dst != "") & (port != ""), F.concat_ws(":", dst, port)).otherwise(F.concat(dst, port))
    net_text = F.concat_ws(" ", part("", g("protocol", "proto")), F.lit("connect"), part("", endpoint))
    dns_text = F.concat_ws(" ", F.lit("dns"), part("", g("query_type", "qtype")), part("", query), part("rcode=", g("rcode")), part("answer=", X.short_text(g("response", "answer"), 180)))
    file_text = F.concat_ws(" ", part("", g("operation", "action", "event_type")), part("", path))
    is_web = kind.isin("waf_alert", "web_access_log") | (url != "")
    return (F.when(is_web & (web_text != ""), web_text).when(cmd != "", X.short_text(cmd, 600))
            .when(kind.isin("host_connect", "firewall_log") | (dst != ""), net_text)
            .when((kind == "dns_log") | (query != ""), dns_text)
            .when(kind.isin("host_file_op", "host_persistence") | (path != ""), file_text).otherwise(X.short_text(msg, 600)))


def ssh_targets(text: Column) -> Column:
    """Distinct (user, ip) pairs a command logs in to; "?" without a user.

    ``user@ip`` pairs come first, then addresses after ``@`` or an ssh word.
    """
    ip = r"((?:\d{1,3}\.){3}\d{1,3})(?!\d)"
    t = F.coalesce(text, F.lit(""))
    named = rf"([a-zA-Z0-9._-]+)@{ip}"
    users, ips = (F.regexp_extract_all(t, F.lit(named), F.lit(i)) for i in (1, 2))
    pairs = F.zip_with(users, ips, lambda u, i: F.struct(u.alias("user"), i.alias("ip")))
    loose = F.array_compact(F.flatten(F.transform(
        F.regexp_extract_all(t, F.lit(rf"(@{ip}|ssh(?:pass)?[^\n]*?{ip}|s\.phtml\?c=[^\s'\"]*?{ip})"), F.lit(1)),
        lambda m: F.array(F.regexp_extract(m, rf"{ip}$", 1)))))
    loose = F.transform(loose, lambda i: F.struct(F.lit("?").alias("user"), i.alias("ip")))
    from ..functions.net import is_ipv4
    return F.array_distinct(F.filter(F.concat(pairs, loose), lambda p: is_ipv4(p["ip"])))
