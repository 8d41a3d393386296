"""Tables and views the checks share, once for Spark and once as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as evidence: user = host, event_type = kind, props.k = port."""
    return table(spark, d, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id",
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), "props")


EV = ("ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, 'host-' || user_id AS host, event_type, value, "
      "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, props FROM events)")
HOUR = 3_600_000_000
DAY = 24 * HOUR


def union_of(modules) -> tuple[dict, dict]:
    q, o = {}, {}
    for m in modules:
        for name, (fn, sql) in m.CHECKS.items():
            if name in q:
                raise ValueError(f"two checks named {name}")
            q[name] = fn
            if sql is not None:
                o[name] = sql
    return q, o
