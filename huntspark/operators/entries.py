"""Where an intrusion entered: the request that most likely opened the door."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import any_of, first_match
from ..functions.text import request_outcome, web_vector
from .windows import best_entry

# Fixed values (W06): what an entry is preferred by, best first; a control page shows control, not how it was gained.
OUTCOMES = ("success", "unknown", "failed", "blocked")
VECTORS = ("web_exploit:rce", "web_exploit:sqli", "webshell", "web_exploit")
#: Patterns that are only a kind of script name no page.
SCRIPT_KINDS = ("php", ".php", "jsp", ".jsp", "asp", ".asp", "aspx", ".aspx")
# Texts in a command that tell of a planted page, and role, status and reason of an entry.
PLANTED = ("s.phtml", "webshell", "uploads/")


def rank_in(value: Column, order: tuple[str, ...], default: int) -> Column:
    """Position of a value in a preference list."""
    return first_match(*[(value == v, i) for i, v in enumerate(order)], default=default)


def entry_ranks(outcome: Column, vector: Column) -> list[Column]:
    """What entries are compared by before their time: outcome first, an unknown one standing as such, then vector."""
    return [rank_in(outcome, OUTCOMES, OUTCOMES.index("unknown")), rank_in(vector, VECTORS, len(VECTORS))]


def _inside(df: DataFrame, us: str, start_us: int | None, end_us: int | None) -> DataFrame:
    test = F.col(us).isNotNull()
    if start_us is not None:
        test = test & (F.col(us) >= start_us)
    if end_us is not None:
        test = test & (F.col(us) <= end_us)
    return df.where(test)


def web_entries(web: DataFrame, group: list[str], patterns: list[str], start_us: int | None = None, end_us: int | None = None, attacker_ip: str | None = None) -> DataFrame:
    """Best entry per group among suspicious requests, with what it stands for.

    ``web``: the group's columns, evidence_id, us, url, and if there are any
    src_ip, action, status. Adds vector, outcome, ``role``,
    ``first_point_status``, ``selection_reason`` and the first page of control
    seen (``control_url``, ``control_us``, ``control_ref``).
    """
    have = lambda c: F.col(c) if c in web.columns else F.lit(None).cast("string")
    names = [p.strip() for p in patterns if p and p.strip().lower() not in ("", *SCRIPT_KINDS)]
    d = _inside(web, "us", start_us, end_us)
    if attacker_ip is not None:
        d = d.where(have("src_ip") == attacker_ip)
    d = d.withColumn("vector", web_vector(F.col("url"), names)).withColumn("outcome", request_outcome(have("action"), have("status")))
    best = best_entry(d, group, entry_ranks(F.col("outcome"), F.col("vector")), "us", "evidence_id")
    controls = d.where((F.col("vector") == "webshell") & F.col("outcome").isin("success", "unknown"))
    first = F.min_by(F.struct(F.col("url").alias("control_url"), F.col("us").alias("control_us"), F.col("evidence_id").alias("control_ref")), F.struct("us", "evidence_id")).alias("__c")
    seen = controls.groupBy(*group).agg(first)
    exploit, page = F.col("vector").isin("web_exploit:rce", "web_exploit:sqli"), F.col("vector") == "webshell"
    return best.join(seen, group, "left").select(
        *best.columns, F.when(exploit, "compromise_trigger").when(page, "observed_control_point").otherwise("suspicious_request").alias("role"),
        F.when(exploit & (F.col("outcome") == "success"), "supported").when(page, "unresolved").otherwise("candidate").alias("first_point_status"),
        F.when(exploit, "successful_exploit_trigger_preferred_over_observed_control_page").when(page, "webshell_control_observed_but_original_compromise_not_proven")
        .otherwise("earliest_ranked_suspicious_web_request").alias("selection_reason"), "__c.control_url", "__c.control_us", "__c.control_ref")


def exec_entries(execs: DataFrame, group: list[str], web_listener: Column, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """First command per group that a web process ran: the entry where no request was logged.

    ``web_listener`` tells which rows those are. The vector is the planted page
    if the command names one, else code execution.
    """
    text = F.lower(F.coalesce("command", F.lit("")))
    d = _inside(execs.where(F.coalesce(web_listener, F.lit(False))), "us", start_us, end_us)
    d = d.withColumn("vector", F.when(any_of(*[text.contains(p) for p in PLANTED]), "webshell").otherwise("web_exploit:rce"))
    return best_entry(d, group, [], "us", "evidence_id")


def initial_access(web: DataFrame, execs: DataFrame | None, group: list[str], patterns: list[str], web_listener: Column | None = None, start_us: int | None = None, end_us: int | None = None,
                   attacker_ip: str | None = None) -> DataFrame:
    """Entry per group from requests, from commands where there is none: ``us, evidence_id, vector, outcome, role, source``."""
    cols = [*group, "us", "evidence_id", "vector"]
    seen = web_entries(web, group, patterns, start_us, end_us, attacker_ip).select(*cols, "outcome", "role", F.lit("web").alias("source"))
    if execs is None:
        return seen
    told = exec_entries(execs, group, web_listener if web_listener is not None else F.lit(True), start_us, end_us)
    told = told.join(seen.select(*group), group, "left_anti").select(*cols, F.lit(None).cast("string").alias("outcome"), F.lit("compromise_trigger").alias("role"), F.lit("exec").alias("source"))
    return seen.unionByName(told)
