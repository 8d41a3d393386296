"""WARC archives with verified record boundaries.

Writing: one record per page. Of pages with equal payloads the one with the
smallest id is a response record, the others are revisit records that refer to
it. Archives are written by Spark's text writer, whose line separator is the
pair of line ends that closes a record.

Reading: the line separator is the version line, so a line is a candidate
record, whether the version line began a record or stood in a payload. Its
offset in the file follows from the lengths of the lines before it. Every
candidate whose head gives a length names the offset at which its successor
must begin. The part of a file that one offset block covers is first followed
inside one task, which leaves for every candidate the first offset behind the
block; then pointer jumping from the start of the file doubles the reach over
blocks until nothing new is reached, and the candidates on a reached block's
chain are the records. Version lines inside payloads are not on the chain, and
their lines are joined to the record they belong to.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut_lineage

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Rows of a file that is written, and bytes of a file whose chain is followed in one task.
FILE_RECORDS = 20_000
BLOCK_BYTES = 64 << 20
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: five hex digits are four base-32 digits."""
    digits = F.sha1(data)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]), HEX32, BASE32)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", revisit_from: int = 0) -> DataFrame:
    """``value``: the bytes of one record per page, without the closing line ends.

    A NULL body is empty. Payloads of fewer than ``revisit_from`` bytes are
    always responses. Repeated ids keep a record each; the first by url is the
    response. A NULL id comes after all others.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"), payload.alias("_payload")).withColumn("_sha", base32_sha1(F.col("_payload")))
    # Bodies do not move: only digests meet, and what comes back is one id per digest that several pages share.
    light = pages.select(F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url")).alias("_at"), base32_sha1(payload).alias("_sha"))
    # Written first, so that Spark knows its size before it plans how the bodies meet it.
    first = cut_lineage(light.groupBy("_sha").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("_sha", "_first"))
    rows = rows.join(first, "_sha", "left")
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_url").alias("url"))
    repeat = F.col("_first").isNotNull() & (F.octet_length("_payload") >= revisit_from) & ~F.coalesce(own.eqNullSafe(F.col("_first")), F.lit(False))
    target = F.regexp_replace("_url", "[\\x00-\\x20\\x7F]", "_")
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("_payload").cast("string"), F.lit("\r\n\r\n"))
    kind = F.when(repeat, F.lit("revisit")).otherwise(F.lit("response"))
    extra = F.when(repeat, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("_first.id")))).otherwise(F.lit(""))
    size = F.octet_length(http) + F.when(repeat, 0).otherwise(F.octet_length("_payload"))
    head = F.concat(F.lit(VERSION + "WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(F.col("_id")), F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), target,
                    F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_sha"), extra, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    return rows.select(F.concat(head.cast("binary"), http.cast("binary"), F.when(repeat, F.lit("").cast("binary")).otherwise(F.col("_payload"))).alias("value"))


def write(values: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Writes records as archives; the bytes are a string only by name."""
    values.select(F.col("value").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, size, line``: every stretch between version lines, with the offset of the version line before it.

    ``size`` counts the bytes of the line. The stretch before the first version
    line has a negative offset.
    """
    lines = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place"), F.col("value").cast("binary").alias("line"))
    size = F.octet_length("line").cast("bigint")
    return lines.withColumn("size", size)


def located(lines: DataFrame) -> DataFrame:
    """Adds ``offset`` to the lines' places: a sum over the lines of the same file, without their bytes."""
    step = len(VERSION)
    upto = F.sum(F.col("size") + step).over(Window.partitionBy("file").orderBy("_split", "_place"))
    return lines.withColumn("offset", upto - F.col("size") - 2 * step)


def header(line: Column, name: str) -> Column:
    """The value of a named field in the head of a line; NULL where there is none."""
    head = F.substring_index(line.cast("string"), END, 1)
    found = F.regexp_extract(F.concat(F.lit("\r\n"), head), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def chains(points: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, offset`` of the candidates that are reached from offset 0 of their file.

    ``points`` has ``file, offset, successor`` (NULL where a candidate has no
    legal head). The rounds of pointer jumping are the logarithm of the number
    of blocks of the longest file; where every file fits one block there are none.
    """
    points = points.withColumn("block", F.floor(F.col("offset") / block_bytes).cast("bigint"))

    def exits(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        """For every candidate: the first offset of its chain behind the block, or none."""
        pdf = pdf.sort_values("offset")
        at, to = pdf["offset"].to_numpy(np.int64), pdf["successor"].fillna(-1).to_numpy(np.int64)
        end = (keys[1] + 1) * block_bytes
        place = np.searchsorted(at, to)
        inside = (to < end) & (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == to)
        out = np.where(to >= end, to, -1)
        for i in np.flatnonzero(inside)[::-1]:
            out[i] = out[place[i]]
        return pd.DataFrame({"file": keys[0], "offset": at, "exit": out})

    exit_of = points.groupBy("file", "block").applyInPandas(exits, "file string, offset bigint, exit bigint")
    exit_of = cut_lineage(exit_of)
    reached = exit_of.filter("offset = 0").select("file", "offset")
    if exit_of.filter("exit >= 0").limit(1).count():
        hop = exit_of.filter("exit >= 0").select("file", "offset", F.col("exit").alias("to"))
        while True:
            # Twice the reach: where the known ones lead, and hops made of two hops.
            new = reached.join(hop, ["file", "offset"]).select("file", F.col("to").alias("offset")).join(reached, ["file", "offset"], "left_anti").distinct()
            new = cut_lineage(new)
            if not new.limit(1).count():
                break
            reached = cut_lineage(reached.unionByName(new))
            second = hop.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
            hop = cut_lineage(hop.join(second, ["file", "to"]).select("file", "offset", F.col("beyond").alias("to")))
    starts = reached.withColumn("block", F.floor(F.col("offset") / block_bytes).cast("bigint")).withColumnRenamed("offset", "enter")
    # A file's block is entered at most once, so this pairs each candidate with one entry.
    entered = points.join(starts, ["file", "block"])

    def walk(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        at, to = pdf["offset"].to_numpy(np.int64), pdf["successor"].fillna(-1).to_numpy(np.int64)
        place = np.searchsorted(at, to)
        enter = pdf["enter"].iloc[0]
        on, i = [], int(np.searchsorted(at, enter))
        if i < len(at) and at[i] != enter:  # the chain leads to where no candidate is
            i = len(at)
        while i < len(at) and (not on or at[i] == to[on[-1]]):
            on.append(i)
            i = int(place[i]) if to[i] >= 0 else len(at)
        return pd.DataFrame({"file": keys[0], "offset": at[on]})

    return entered.groupBy("file", "block").applyInPandas(walk, "file string, offset bigint")


def read(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per verified record: ``file, record_type, record_id, target_uri, payload_digest, refers_to, payload``.

    ``payload`` is the HTTP body of a response, else empty. Files without a
    record at offset 0 give no rows; a record whose end is missing is dropped.
    """
    lines = candidates(spark, path)
    length = F.try_to_number(header(F.col("line"), "Content-Length"), F.lit("9" * 15)).cast("bigint")
    head_end = F.instr(F.col("line").cast("string"), END)
    # Heads are ASCII up to the closing line ends, so characters are bytes there.
    head = F.when(head_end > 0, F.octet_length(F.substring_index(F.col("line").cast("string"), END, 1)) + len(END))
    light = cut_lineage(located(lines.select("file", "_split", "_place", "size", (head + length).alias("_span"))))
    light = light.withColumn("successor", F.col("offset") + len(VERSION) + F.col("_span") + len(END))
    true = chains(light.filter("offset >= 0").select("file", "offset", "successor"), block_bytes).withColumn("true", F.lit(True))
    marked = light.join(true, ["file", "offset"], "left")
    owner = F.last(F.when(F.col("true"), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    marked = marked.withColumn("record", owner)
    marked = marked.withColumn("_lines", F.count("*").over(Window.partitionBy("file", "record")))
    # Most lines are a record each and stay where they are read. The others are listed, written first so that Spark knows how few they are.
    place = ["file", "_split", "_place"]
    others = cut_lineage(marked.filter("record IS NULL OR _lines > 1").select(*place, "offset", "record"))
    alone = lines.join(others.select(*place), place, "left_anti").select("file", "line")
    parts = lines.join(others.filter("record IS NOT NULL"), place).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("p"))
    line = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["line"], lambda a, x: F.concat(a, F.lit(VERSION).cast("binary"), x["line"]))
    full = alone.unionByName(parts.select("file", line.alias("line")))
    head_bytes = F.octet_length(F.substring_index(F.col("line").cast("string"), END, 1)) + len(END)
    size = header(F.col("line"), "Content-Length").cast("bigint")
    block = F.substring(F.col("line"), head_bytes + 1, size.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    digest = F.regexp_replace(header(F.col("line"), "WARC-Payload-Digest"), "^sha1:", "")
    return full.filter(F.octet_length("line") >= head_bytes + size).select(
        "file", header(F.col("line"), "WARC-Type").alias("record_type"), header(F.col("line"), "WARC-Record-ID").alias("record_id"),
        header(F.col("line"), "WARC-Target-URI").alias("target_uri"), digest.alias("payload_digest"), header(F.col("line"), "WARC-Refers-To").alias("refers_to"),
        F.substring(block, http + 1, F.octet_length(block)).alias("payload"))
