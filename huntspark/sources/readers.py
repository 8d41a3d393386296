"""Batch sources and sinks."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.rollups import first_rows
from ..operators.windows import dedupe_first


def read_log_files(spark: SparkSession, path: str, pattern: str | None = None, last_n: int | None = None) -> DataFrame:
    """Lines of text files with their ``path``, optionally only matching ones, optionally the last N per file.

    Files may be split: the line order is the split's offset, then the reading
    order inside the split.
    """
    d = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    d = d.withColumn("pos", F.monotonically_increasing_id())
    if pattern:
        d = d.where(F.col("line").rlike(pattern))
    if last_n:
        d = first_rows(d, ["path"], [F.col("block").desc(), F.col("pos").desc()], last_n).drop("__rn")
    return d


def read_payloads(spark: SparkSession, path: str, schema: str | StructType, form: str = "jsonl", params: dict | None = None, cap: int | None = None) -> DataFrame:
    """Objects below a prefix as rows: ``jsonl``, ``array`` (one JSON array per object) or ``text``.

    Keeps the object key, filters by equality params that name columns. gzip by
    suffix. ``cap`` is the asked-for row limit of a preview.
    """
    if form == "text":
        d = spark.read.text(path, recursiveFileLookup=True).withColumnRenamed("value", "raw_line")
    else:
        d = spark.read.schema(schema).json(path, multiLine=form == "array", recursiveFileLookup=True)
    d = d.select("*", F.col("_metadata.file_path").alias("object_key"))
    for name, value in (params or {}).items():
        if name in d.columns:
            d = d.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return d.limit(cap) if cap else d


_TOKENS = re.compile(r"""(?s)(?P<text>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*")|(?P<note>/\*.*?\*/|--[^\n]*)|(?P<mark>(?<![:\w]):[A-Za-z_]\w*)|(?P<rest>.)""")


def assert_select_only(sql: str) -> str:
    """Raises unless the text is one SELECT (or WITH … SELECT) statement; returns it without comments.

    What stands in quotes is neither a comment nor a statement. A quote that is
    never closed, or a backslash in a quoted text, which some servers read as an
    escape, is refused.
    """
    kept, bare = [], []
    for m in _TOKENS.finditer(sql):
        if m.lastgroup == "text" and "\\" in m.group():
            raise ValueError("a quoted text may not hold a backslash")
        if m.lastgroup == "rest" and m.group() in "'\"":
            raise ValueError("a quote is not closed")
        kept.append(" " if m.lastgroup == "note" else m.group())
        bare.append({"note": " ", "text": "''", "name": '""'}.get(m.lastgroup, m.group()))
    text, plain = "".join(kept).strip(), "".join(bare).strip()
    while plain.endswith(";"):
        text, plain = text[:-1].rstrip(), plain[:-1].rstrip()
    if ";" in plain or not re.match(r"(?is)^(select|with)\b", plain):
        raise ValueError("only a single SELECT statement is allowed")
    if re.search(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|exec(ute)?|into\s+outfile)\b", plain):
        raise ValueError("statement is not read-only")
    return text


def bind_params(sql: str, params: dict) -> str:
    """Named ``:param`` markers outside quotes to quoted SQL literals; the JDBC source has no bind variables.

    Texts with a backslash or NUL are refused: servers differ in how they read them.
    """
    def literal(name: str) -> str:
        if name not in params:
            raise ValueError(f"missing parameter {name}")
        v = params[name]
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        if "\\" in str(v) or "\0" in str(v):
            raise ValueError(f"parameter {name} holds a backslash or NUL")
        return "'" + str(v).replace("'", "''") + "'"
    return "".join(literal(m.group()[1:]) if m.lastgroup == "mark" else m.group() for m in _TOKENS.finditer(sql))


def read_jdbc_query(spark: SparkSession, url: str, sql: str, params: dict | None = None, deny: tuple = (), options: dict | None = None,
                    partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """SELECT-only query against a database, denied columns dropped before anything else sees them.

    ``partition`` is (column, lower, upper, count) for parallel reads.
    """
    query = bind_params(assert_select_only(sql), params or {})
    r = spark.read.format("jdbc").options(url=url, **(options or {}))
    if partition:
        col, lo, hi, n = partition
        r = r.option("dbtable", f"({query}) q").options(partitionColumn=col, lowerBound=lo, upperBound=hi, numPartitions=n)
    else:
        r = r.option("query", query)
    low = {d.lower() for d in deny}
    d = r.load()
    return d.drop(*[c for c in d.columns if c.lower() in low])


def read_warehouse(spark: SparkSession, name: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A catalogue table (Hive or other), pruned and filtered at the scan."""
    d = spark.table(name)
    if where is not None:
        d = d.where(where)
    return d.select(*columns) if columns else d


def scan_asset(spark: SparkSession, template: str, defaults: dict, params: dict) -> DataFrame:
    """A query template with named markers; params override defaults, a missing one raises.

    Values travel as arguments, never as text, so they push down and cannot inject.
    """
    args = {**defaults, **{k: v for k, v in params.items() if v is not None}}
    lack = set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", template)) - set(args)
    if lack:
        raise ValueError(f"template parameters missing: {sorted(lack)}")
    return spark.sql(assert_select_only(template), args=args)


def read_asset_union(parts: list[tuple[str, str, DataFrame]], keys: list[str], order: list[str], cap: int | None = None) -> DataFrame:
    """Connectors of an asset in one table, tagged, deduplicated (earlier connector first), capped if asked."""
    tagged = [d.withColumns({"_source_asset_id": F.lit(a), "_source_connector_id": F.lit(c), "__part": F.lit(i)}) for i, (a, c, d) in enumerate(parts)]
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    d = dedupe_first(u, keys, [F.col("__part"), *[F.col(o) for o in order]])
    return (d.orderBy("__part", *order).limit(cap) if cap else d).drop("__part")


def prune_connectors(bindings: dict[str, list[str]], host: str | None) -> list[str]:
    """Connectors bound to the host plus the unbound ones; all when none is bound to it."""
    if not host:
        return list(bindings)
    bound = [c for c, hosts in bindings.items() if host in hosts]
    return [c for c, hosts in bindings.items() if c in bound or not hosts] if bound else list(bindings)


def read_pruned(spark: SparkSession, path: str, bindings: dict[str, list[str]], host: str | None) -> DataFrame:
    """A table partitioned by ``connector_id``, reading only the partitions that can hold the host."""
    return spark.read.parquet(path).where(F.col("connector_id").isin(*prune_connectors(bindings, host)))


def multi_host_scan(df: DataFrame, host: str, hosts: list[str]) -> DataFrame:
    """One scan for all asked hosts; ``_victim_host`` says for which one a row was read."""
    if not hosts:
        return df.withColumn("_victim_host", F.lit(None).cast("string"))
    wanted = df.sparkSession.createDataFrame([(h,) for h in dict.fromkeys(hosts)], "_victim_host string")
    return df.join(wanted, F.col(host) == F.col("_victim_host"))


def load_inventory(hosts: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Registered hosts to (host_id, hostname, ip, …), one row per address, optionally only hosts in scope.

    ``hosts``: host_id, hostname, ips (array). ``scope``: host (name or address).
    """
    d = hosts.withColumn("ip", F.explode_outer("ips")).drop("ips")
    if scope is None:
        return d
    names = scope.select("host").distinct()
    hit = d.select("host_id", F.explode(F.array("hostname", "ip")).alias("host")).join(names, "host", "left_semi").select("host_id").distinct()
    return d.join(hit, "host_id", "left_semi")


def incremental_read(df: DataFrame, channel: str, record_id: str, cursors: DataFrame) -> DataFrame:
    """Rows after the stored cursor of their channel; a channel without cursor is read whole."""
    c = cursors.select(F.col("channel").alias("__ch"), F.col("last_id").alias("__last"))
    return df.join(c, F.col(channel) == F.col("__ch"), "left").where(F.col("__last").isNull() | (F.col(record_id) > F.col("__last"))).drop("__ch", "__last")


def advance_cursors(cursors: DataFrame, written: DataFrame, channel: str, record_id: str) -> DataFrame:
    """New cursor table. Call it on what the sink holds, after the write succeeded."""
    new = written.groupBy(F.col(channel).alias("channel")).agg(F.max(record_id).alias("last_id"))
    return cursors.select("channel", "last_id").unionByName(new).groupBy("channel").agg(F.max("last_id").alias("last_id"))


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> str:
    """JSON lines, columns in table order, NULL fields left out."""
    df.write.mode(mode).json(path)
    return path
