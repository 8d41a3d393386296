"""Text and event records to columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..functions.common import any_of, first_match, let, text_or_null

# Built-in line formats: named groups, matched at the start of the line.
BUILTIN_PARSERS = {
    "auth": {"line_regex": r"(?P<month>\w{3})\s+(?P<day>\d{1,2})\s+(?P<time>\d{2}:\d{2}:\d{2})\s+(?P<host>\S+)\s+sshd(?:\[\d+\])?:\s+"
                           r"(?P<result>Accepted|Failed|Invalid|Disconnected|Connection closed|error|fatal)\b"},
    "nginx_combined": {"line_regex": r"(?P<src_ip>\S+) \S+ \S+ \[(?P<timestamp>[^\]]+)\] \"(?P<method>\S+) (?P<url>\S+)[^\"]*\" (?P<status>\d{3})"},
}


def parse_lines(df: DataFrame, line: str, parser_id: str, host: Column, parsers: dict | None = None) -> DataFrame:
    """Adds ``fields`` (map), ``raw_line`` and ``parsed``.

    ``json_lines`` reads objects, other ids name a regex with named groups. A
    line that does not fit keeps an empty map besides host and its raw text.
    Blank lines drop out.
    """
    d = df.where(F.trim(F.col(line)) != "").withColumn("raw_line", F.trim(F.col(line)))
    if parser_id in ("json_lines", "raw_only"):
        got = F.from_json(F.when(F.col("raw_line").startswith("{"), F.col("raw_line")), "map<string,string>") if parser_id == "json_lines" else F.lit(None).cast("map<string,string>")
    else:
        got = X.named_groups(F.col("raw_line"), {**BUILTIN_PARSERS, **(parsers or {})}[parser_id]["line_regex"])
    d = d.withColumn("__m", got).withColumn("parsed", F.coalesce(F.size("__m") > 0, F.lit(False)))
    base = F.coalesce(F.col("__m"), F.create_map().cast("map<string,string>"))
    if parser_id == "auth":
        more = F.map_filter(F.create_map(
            F.lit("src_ip"), F.regexp_extract("raw_line", r"from (\d{1,3}(?:\.\d{1,3}){3})", 1),
            F.lit("user"), F.regexp_extract("raw_line", r"for (?:invalid user )?(\S+)(?:\s+from|\s|$)", 1)), lambda k, v: v != "")
        base = F.when(F.col("parsed"), F.map_concat(base, more)).otherwise(base)
    with_host = F.when(F.map_contains_key(base, "host"), base).otherwise(F.map_concat(base, F.create_map(F.lit("host"), host)))
    return d.withColumn("fields", with_host).drop("__m")


SYSLOG_PATTERN = (r"^(?P<month>[A-Z][a-z]{2})\s+(?P<day>\d{1,2})\s+(?P<clock>\d{2}:\d{2}:\d{2})\s+(?P<host>\S+)\s+"
                  r"(?P<program>[^:\[]+)(?:\[(?P<pid>\d+)\])?:\s*(?P<message>.*)$")
# Ordered rules (every group needs one of its words in the message).
# (event_type, severity, rule_id, tags, word groups)
SECURE_RULES = (
    ("ssh_login_failed", "medium", "secure_ssh_failed_password", "auth,ssh,bruteforce", (("failed password",),)),
    ("ssh_invalid_user", "medium", "secure_ssh_invalid_user", "auth,ssh,recon", (("invalid user",),)),
    ("ssh_auth_attempts_exceeded", "high", "secure_ssh_max_auth_exceeded", "auth,ssh,bruteforce", (("maximum authentication attempts exceeded",),)),
    ("auth_failure", "medium", "secure_pam_auth_failure", "auth,pam", (("authentication failure",),)),
    ("ssh_login_success", "high", "secure_ssh_login_success", "auth,ssh,login_success", (("accepted password", "accepted publickey"),)),
    ("root_session_opened", "high", "secure_root_session_opened", "auth,privilege", (("session opened for user root",),)),
    ("sudo_command", "medium", "secure_sudo_command", "sudo,privilege", (("sudo:",), ("command=",))),
    ("su_failure", "medium", "secure_su_failure", "auth,privilege", (("su:",), ("authentication failure", "failed"))),
    ("account_created", "high", "secure_account_created", "account,persistence", (("useradd", "new user", "add user"),)),
    ("account_modified", "medium", "secure_account_modified", "account,privilege", (("usermod", "groupadd", "passwd"),)),
)
MESSAGE_RULES = (
    ("process_crash", "medium", "messages_process_crash", "stability,exploit_signal", (("segfault", "general protection fault"),)),
    ("oom_kill", "medium", "messages_oom_kill", "availability,dos_signal", (("out of memory", "oom-killer", "killed process"),)),
    ("kernel_panic", "critical", "messages_kernel_panic", "availability,kernel", (("kernel panic", "panic"),)),
    ("security_policy_denied", "medium", "messages_security_policy_denied", "policy,denied", (("audit",), ("avc", "denied"))),
    ("firewall_event", "medium", "messages_firewall_event", "firewall,network", (("iptables", "firewalld", "ufw"),)),
    ("network_anomaly", "high", "messages_network_anomaly", "network,anomaly", (("possible syn flooding", "martian source", "promiscuous mode"),)),
    ("device_attached", "high", "messages_usb_device_attached", "device", (("usb",), ("new", "attached"))),
    ("suspicious_cron_command", "high", "messages_suspicious_cron", "cron,persistence", (("cron",), ("wget", "curl", "bash -c", "/tmp/"))),
    ("service_failure", "high", "messages_service_failure", "service", (("systemd",), ("failed", "failure"))),
)
# Fixed values (P10): programs whose own lines need not name them: their name stands for the first group of words.
RULE_PROGRAMS = {"secure_sudo_command": "sudo", "messages_service_failure": "systemd"}
# Fixed values (P10): words that make a sudo command risky.
RISKY_SUDO_WORDS = ("/etc/sudoers", "useradd", "usermod", "passwd", "chmod 777", "chattr", "iptables", "firewall", "curl ", "wget ",
                    "nc ", "ncat", "bash -c", "/tmp/", "crontab")


def syslog_to_risk_events(df: DataFrame, line: str, kind: Column) -> DataFrame:
    """RFC 3164 lines to classified risk rows; lines no rule takes drop out.

    ``kind`` is "secure" or "messages". Login rules are asked first for secure
    files and for sshd, sudo, su and PAM lines, then (or for messages files)
    the system rules; the first rule of a list wins. A messages file whose line
    fits both lists yields both rows.
    """
    d = df.withColumn("p", X.named_groups(F.col(line), SYSLOG_PATTERN)).where("p IS NOT NULL")
    d = d.withColumns({"host": F.col("p")["host"], "program": F.trim(F.col("p")["program"]), "pid": F.col("p")["pid"],
                       "message": F.coalesce(F.col("p")["message"], F.lit("")),
                       "ts_text": F.concat_ws(" ", F.col("p")["month"], F.col("p")["day"], F.col("p")["clock"])}).drop("p")
    low, prog = F.lower("message"), F.lower("program")

    def pick(rules):
        out = None
        for etype, sev, rule, tags, groups in reversed(rules):
            test = F.lit(True)
            for i, g in enumerate(groups):
                named = [prog == RULE_PROGRAMS[rule]] if i == 0 and rule in RULE_PROGRAMS else []
                test = test & any_of(*[low.contains(w) for w in g], *named)
            row = F.struct(F.lit(etype).alias("event_type"), F.lit(sev).alias("severity"), F.lit(rule).alias("rule_id"), F.lit(tags).alias("tags"))
            out = F.when(test, row) if out is None else F.when(test, row).otherwise(out)
        return out

    login = (kind == "secure") | (prog == "sshd") | any_of(*[low.contains(w) for w in ("pam_unix", "sudo", "su:")])
    d = d.withColumn("__s", F.when(login, pick(SECURE_RULES)))
    d = d.withColumn("__m", F.when((kind == "messages") | F.col("__s").isNull(), pick(MESSAGE_RULES)))
    d = d.withColumn("r", F.explode(F.array_compact(F.array("__s", "__m")))).drop("__s", "__m")
    msg, et = F.col("message"), F.col("r.event_type")
    grab = lambda pattern: text_or_null(F.regexp_extract(msg, pattern, 1))
    from_user = F.coalesce(grab(r"for invalid user\s+(\S+)"), grab(r"for\s+(\S+)\s+from"))
    account = F.coalesce(grab(r"new user:\s+name=([^,\s]+)"), grab(r"user '([^']+)'"), grab(r"\bname=([^,\s]+)"))
    pam = et.isin("auth_failure", "su_failure")
    ssh = et.isin("ssh_login_failed", "ssh_invalid_user", "ssh_auth_attempts_exceeded", "ssh_login_success")
    user = first_match((ssh, from_user), (pam, grab(r"\buser=([^\s]+)")), (et == "root_session_opened", F.rtrim(grab(r"session opened for user\s+(\S+)"), F.lit(")"))),
                       (et == "sudo_command", grab(r"^\s*([^\s:]+)\s*:")), (et.startswith("account_"), account), default=F.lit(None).cast("string"))
    any_ip = grab(r"\b((?:\d{1,3}\.){3}\d{1,3})\b")
    src = first_match((ssh, grab(r"from\s+((?:\d{1,3}\.){3}\d{1,3})")), (pam, F.coalesce(grab(r"\brhost=([^\s]+)"), any_ip)),
                      (et.isin("firewall_event", "network_anomaly"), any_ip), default=F.lit(None).cast("string"))
    cmd = F.when(et == "sudo_command", F.trim(grab(r"COMMAND=(.*)$"))).when(et == "suspicious_cron_command", msg)
    risky = (et == "sudo_command") & any_of(*[F.lower(cmd).contains(w) for w in RISKY_SUDO_WORDS])
    root = (et == "ssh_login_success") & (user == "root")
    return (d.withColumn("event_type", et).withColumn("tags", F.split("r.tags", ",")).withColumn("user", user)
            .withColumn("src_ip", src).withColumn("command", cmd)
            .withColumn("severity", F.when(F.coalesce(risky, F.lit(False)), "high").otherwise(F.col("r.severity")))
            .withColumn("rule_id", F.when(F.coalesce(root, F.lit(False)), "secure_ssh_root_login_success").otherwise(F.col("r.rule_id"))).drop("r"))


# Windows event ids that are risks on their own.
WINDOWS_RULES = {
    4624: ("windows_logon_success", "high", "WIN-AUTH-4624"), 4625: ("windows_logon_failed", "medium", "WIN-AUTH-4625"),
    4648: ("windows_explicit_credentials", "medium", "WIN-AUTH-4648"), 4672: ("windows_special_privileges", "high", "WIN-AUTH-4672"),
    4720: ("windows_user_created", "high", "WIN-ACCOUNT-4720"), 4726: ("windows_user_deleted", "medium", "WIN-ACCOUNT-4726"),
    4728: ("windows_group_member_added", "high", "WIN-ACCOUNT-GROUP-ADD"), 4732: ("windows_group_member_added", "high", "WIN-ACCOUNT-GROUP-ADD"),
    1102: ("windows_audit_log_cleared", "critical", "WIN-AUDIT-1102"), 7045: ("windows_service_installed", "high", "WIN-SYSTEM-7045"),
    4104: ("powershell_script_block", "medium", "WIN-PS-4104"), 4688: ("windows_process_high_risk", "high", "WIN-PROC-4688"),
}
# Fixed values (P11): words that make a command line suspicious.
SUSPICIOUS_WORDS = ("-enc", "-encodedcommand", "downloadstring", "invoke-webrequest", " iwr ", "curl ", "wget ", "certutil", "bitsadmin",
                    "rundll32", "regsvr32", "mimikatz", "add-mppreference", "set-mppreference", "net user", "net localgroup", "schtasks",
                    "wmic", "frombase64string")


def suspicious_command(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return any_of(*[low.contains(w) for w in SUSPICIOUS_WORDS])


WINDOWS_XML = ("System STRUCT<EventID: STRING, Computer: STRING, EventRecordID: STRING, Channel: STRING, Provider: STRUCT<_Name: STRING>, TimeCreated: STRUCT<_SystemTime: STRING>>, "
               "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>")


def parse_windows_xml(df: DataFrame, xml: str) -> DataFrame:
    """``event_code``, ``computer``, ``record_id``, ``channel``, ``provider``, ``time_created`` and the data fields as a map.

    One parse per record; fields without a name are called Data1, Data2, … and
    the first of equal names counts.
    """
    d = df.withColumn("__x", F.from_xml(F.col(xml), WINDOWS_XML))
    named = F.transform(F.coalesce("__x.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>")),
                        lambda e, i: F.struct(F.coalesce(text_or_null(e["_Name"]), F.concat(F.lit("Data"), (i + 1).cast("string"))).alias("k"), e["_VALUE"].alias("v")))
    once = lambda es: F.map_from_entries(F.filter(es, lambda e, i: F.array_position(F.transform(F.slice(es, 1, i), lambda p: p["k"]), e["k"]) == 0))
    x = lambda p: F.trim(text_or_null(F.col(f"__x.{p}")))
    return d.withColumns({"event_code": x("System.EventID").try_cast("int"), "computer": x("System.Computer"), "record_id": x("System.EventRecordID").try_cast("bigint"), "channel": x("System.Channel"),
                          "provider": x("System.Provider._Name"), "time_created": x("System.TimeCreated._SystemTime"), "data": let(named, once)}).drop("__x")


def windows_risk_events(df: DataFrame) -> DataFrame:
    """Rows of a known event id with type, severity and rule; process creations
    only when suspicious. Needs ``event_code``, ``process`` and ``command``."""
    rules = F.create_map(*[v for code, (t, s, r) in WINDOWS_RULES.items()
                           for v in (F.lit(code), F.struct(F.lit(t).alias("event_type"), F.lit(s).alias("severity"), F.lit(r).alias("rule_id")))])
    hot = suspicious_command(F.col("command"))
    d = df.withColumn("__r", rules[F.col("event_code").cast("int")]).where("__r IS NOT NULL")
    d = d.where((F.col("event_code") != 4688) | hot | suspicious_command(F.col("process")))
    severity = F.when((F.col("event_code") == 4104) & hot, "high").otherwise(F.col("__r.severity"))
    return d.withColumns({"event_type": F.col("__r.event_type"), "severity": severity, "rule_id": F.col("__r.rule_id")}).drop("__r")


def windows_evidence(df: DataFrame, agent_images=()) -> DataFrame:
    """Process, network and file rows of Windows and Sysmon events.

    Needs ``event_code``, ``is_sysmon`` and ``data``. Rows of the collector's
    own images drop out.
    """
    f = lambda *names: F.coalesce(*[text_or_null(F.col("data")[n]) for n in names])
    base = lambda c: F.element_at(F.split(c, r"[\\/]"), -1)
    code, sysmon = F.col("event_code"), F.col("is_sysmon")
    kind = first_match((code == 4688, "host_exec"), (sysmon & (code == 1), "host_exec"), (sysmon & (code == 3), "host_connect"),
                       (sysmon & code.isin(11, 23), "host_file_op"), default=F.lit(None).cast("string"))
    exe = F.when(code == 4688, f("NewProcessName", "ProcessName")).otherwise(f("Image"))
    parent = F.when(code == 4688, f("CreatorProcessName", "ParentProcessName")).otherwise(f("ParentImage"))
    hexpid = lambda c: F.when(c.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(c, 3, 16), 16, 10)).otherwise(c)
    d = df.withColumns({
        "asset_type": kind, "event_type": F.when(kind == "host_exec", "exec").when(kind == "host_connect", "active_connect").when(kind == "host_file_op", "file_op"),
        "exe": exe, "comm": base(exe), "parent_process": parent,
        "pid": F.when(code == 4688, hexpid(f("NewProcessId", "ProcessId"))).otherwise(f("ProcessId")),
        "ppid": F.when(code == 4688, hexpid(f("CreatorProcessId", "ParentProcessId"))).when(code == 1, f("ParentProcessId")),
        "user": F.when(code == 4688, f("SubjectUserName", "TargetUserName")).otherwise(f("User")),
        "command_line": F.when(kind == "host_exec", F.coalesce(f("CommandLine"), exe)),
        "dst_ip": F.when(kind == "host_connect", f("DestinationIp")), "dst_port": F.when(kind == "host_connect", f("DestinationPort")),
        "path": F.when(kind == "host_file_op", f("TargetFilename")),
        "action": F.when(kind == "host_file_op", F.when(code == 23, "delete").otherwise("create"))}).where("asset_type IS NOT NULL")
    own = [i.lower() for i in agent_images]
    return d.where(~any_of(F.lower(base(exe)).isin(*own), F.lower(base(parent)).isin(*own))) if own else d
