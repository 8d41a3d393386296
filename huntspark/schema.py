"""Typed evidence tables and the check of their minimum fields."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .functions.common import text_or_null

_COMMON = "evidence_id STRING, ts TIMESTAMP, ts_raw STRING"
_DDL = {
    "waf_alert": "src_ip STRING, url STRING, method STRING, action STRING, rule_id STRING, rule_name STRING, payload STRING, alert_id STRING, host STRING, target_ip STRING, trace_id STRING",
    "web_access_log": "src_ip STRING, url STRING, method STRING, status INT, upstream_status INT, target_ip STRING, upstream_addr STRING, host STRING, http_host STRING, user_agent STRING, bytes_sent BIGINT",
    "host_exec": "host STRING, host_ip STRING, event_type STRING, listener_port INT, listener_process STRING, listener_pid BIGINT, pid BIGINT, ppid BIGINT, exe STRING, comm STRING, command ARRAY<STRING>, command_line STRING, cwd STRING, user STRING",
    "host_connect": "host STRING, host_ip STRING, event_type STRING, listener_port INT, listener_process STRING, listener_pid BIGINT, pid BIGINT, dst_ip STRING, dst_port INT",
    "host_file_op": "host STRING, host_ip STRING, event_type STRING, listener_pid BIGINT, listener_port INT, pid BIGINT, path STRING, action STRING, file_paths ARRAY<STRING>",
    "host_persistence": "host STRING, event_type STRING, action STRING, persistence_type STRING, path STRING, user STRING, process STRING",
    "ssh_auth": "host STRING, host_ip STRING, src_ip STRING, user STRING, event_type STRING, result STRING, auth_method STRING",
    "syslog_risk_alert": "host STRING, host_ip STRING, event_type STRING, user STRING, src_ip STRING, risk_level STRING, rule_name STRING, message STRING",
    "firewall_log": "src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, action STRING, protocol STRING",
    "dns_log": "client_ip STRING, query STRING, query_type STRING, response STRING, rcode STRING",
    "asset_inventory": "hostname STRING, ip STRING, zone STRING, owner STRING, services ARRAY<STRING>",
}
EVIDENCE: dict[str, StructType] = {name: StructType.fromDDL(f"{_COMMON}, {ddl}, extra MAP<STRING, STRING>") for name, ddl in _DDL.items()}


def conform(df: DataFrame, asset_type: str) -> DataFrame:
    """The table in the type's schema: casts that fail give NULL, unknown columns go to ``extra`` as text."""
    schema = EVIDENCE[asset_type]
    names = [f.name for f in schema.fields if f.name != "extra"]
    cols = [(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields if f.name != "extra"]
    rest = [c for c in df.columns if c not in names]
    extra = (F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])), lambda k, v: v.isNotNull())
             if rest else F.lit(None).cast("map<string,string>"))
    return df.select(*cols, extra.alias("extra"))


def quality_gaps(df: DataFrame, requirements: dict[str, list[str]]) -> DataFrame:
    """Share of rows that have each wanted field: (level, field, present, total). One pass over the table."""
    flat = [(level, f) for level, fs in requirements.items() for f in fs]
    has = lambda f: F.count_if(text_or_null(F.col(f)).isNotNull()) if f in df.columns else F.lit(0).cast("bigint")
    one = df.agg(F.count(F.lit(1)).alias("total"), *[has(f).alias(f"n{i}") for i, (_, f) in enumerate(flat)])
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(f).alias("field"), F.col(f"n{i}").alias("present")) for i, (level, f) in enumerate(flat)])
    return one.select("total", F.explode(rows).alias("r")).select("r.level", "r.field", "r.present", "total")


def union_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """Several evidence tables as one, with ``asset_type`` to partition by."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("asset_type", F.lit(t)) for t, d in tables.items()])
