"""Where did the intrusion start and spread?

Declared joins give edges and stages; entry, execution and lateral chains join
them; what overlaps is merged; the graph and the verdict close the plan.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import digest
from ..operators import joins as J, lateral as L, rollups as A, rules as R, setops as U
from ..operators.windows import best_entry
from ..session import cut_lineage


@dataclass
class Trace:
    entries: DataFrame
    stages: DataFrame
    edges: DataFrame
    nodes: DataFrame
    verdict: DataFrame


def trace_intrusion(tables: dict[str, DataFrame], specs: dict[str, J.JoinSpec], chain: list[str], stage_of: dict[str, str], logins: DataFrame, firewall: DataFrame | None,
                    entry_ranks: list[Column], anchor_us: int | None, max_hops: int = 10, ceiling: float = 0.95, connect_sec: int = 120, file_sec: int = 300, persistence_sec: int = 600,
                    end_us: int | None = None, lookback_sec: int = 300, blocked_hosts: DataFrame | None = None) -> Trace:
    """``tables``: web_access_log, host_exec, host_connect, host_file_op, host_persistence (evidence_id, host, us, …).

    ``logins``: src, dst, us, evidence_id, result. The entry of each host is its
    best-ranked web row (``operators.entries.entry_ranks``); hosts with an entry
    seed the lateral search. Execs from ``lookback_sec`` before the anchor, and
    logins from the anchor on, count up to ``end_us``. ``blocked_hosts`` (host)
    are those whose evidence was too poor to judge.
    """
    web, execs = tables["web_access_log"], tables["host_exec"]
    entries = best_entry(web, ["host"], entry_ranks, "us", "evidence_id")
    edges = J.run_chain(tables, specs, chain, anchor_us, limit=None)
    keep = lambda t: t.select("evidence_id", "host", "us")
    evidence = reduce(DataFrame.unionByName, [keep(t) for t in tables.values()])
    matrix = lambda edges: J.stages_from_edges(edges, evidence, stage_of).withColumn("stage_id", digest("m-", F.col("stage"), F.col("host"), F.col("second")))
    run = L.execution_chain(execs, tables["host_connect"], tables["host_file_op"], tables["host_persistence"], connect_sec, file_sec, persistence_sec, anchor_us=anchor_us, lookback_sec=lookback_sec, end_us=end_us)
    run = cut_lineage(run.select("evidence_id", "host", "us", "confidence"))
    heur = run.select(F.lit("execution").alias("stage"), "host", F.floor(F.col("us") / 1_000_000).cast("bigint").alias("second"), F.array(F.col("evidence_id").cast("string")).alias("evidence_refs"),
                      F.array().cast("array<string>").alias("join_ids"), "confidence").withColumn("stage_id", digest("h-", F.col("stage"), F.col("host"), F.get("evidence_refs", F.lit(0))))
    stages = J.merge_stages(matrix(edges), heur)
    # The verdict asks of an edge its right end, and its left one only where an exec bears the same id: the rest of the edges is never formed for it.
    ends = J.chain_rights(tables, specs, chain, anchor_us).select("join_id", F.lit(None).cast("string").alias("left_ref"), "right_ref", F.lit(None).cast("bigint").alias("right_us"), "confidence")
    borne = J.run_chain(tables, specs, chain, anchor_us, left_refs=run.select(F.col("evidence_id").alias("ref")))
    judged = J.merge_stages(cut_lineage(matrix(ends.unionByName(borne.select(*ends.columns)))), heur)
    hops = L.lateral_hops(entries.select("host"), logins, firewall, max_hops, anchor_us=anchor_us, end_us=end_us)
    gated = (blocked_hosts if blocked_hosts is not None else entries.limit(0)).select("host").distinct().withColumn("blocked", F.lit(True))
    spread = hops.where("dst IS NOT NULL").select("src", "dst", "us", "evidence_id", F.lit("lateral_movement").alias("stage"))
    graph, nodes = U.graph_edges([spread], ["us", "evidence_id"])
    flags = (nodes.select(F.col("node").alias("host")).unionByName(entries.select("host")).unionByName(execs.select("host")).distinct()
             .join(entries.select("host").withColumn("has_initial", F.lit(True)), "host", "left")
             .join(judged.where("stage = 'execution'").groupBy("host").agg(F.lit(True).alias("has_execution")), "host", "left")
             .join(graph.select(F.col("src").alias("host")).distinct().withColumn("has_lateral", F.lit(True)), "host", "left")
             .join(execs.select("host").distinct().withColumn("has_exec", F.lit(True)), "host", "left").join(gated, "host", "left"))
    conf = A.chain_confidence(judged, ["host"], ceiling).drop("if_empty")
    verdict = R.verdict_policy(flags).join(conf, "host", "left").select("host", "verdict", F.coalesce("confidence", F.lit(0.4)).alias("confidence"))
    return Trace(entries, stages, graph, nodes, verdict)
