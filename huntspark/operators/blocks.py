"""Ordered work on hot keys, split by time block.

A plain ``Window.partitionBy(host)`` puts all rows of a host into one task. Here
each key is cut into fixed time blocks; the ordered work runs inside ``(key,
block)``, and what must cross a block border (a running count, the last value)
comes from a summary with one row per block. The summary holds no more rows
than the time range has blocks, so its window is small even for a key that owns
a third of the data.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_BLOCK_US = 6 * 3600 * 1_000_000


def block_of(us: Column, width_us: int) -> Column:
    return F.floor(us / F.lit(int(width_us))).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL, without ambiguous columns."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = test if cond is None else cond & test
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def running_total(df: DataFrame, keys: list[str], us: str, order: list, value: Column, out: str,
                  width_us: int = DEFAULT_BLOCK_US) -> DataFrame:
    """Running sum of ``value`` per key up to and including the row.

    ``order`` must be total and start with the time column ``us``.
    """
    b = df.withColumn("__blk", block_of(F.col(us), width_us)).withColumn("__v", value.cast("bigint"))
    per_block = b.groupBy(*keys, "__blk").agg(F.sum("__v").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select(*keys, "__blk", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = b.withColumn("__run", F.sum("__v").over(inside))
    return (_null_safe(run, before, [*keys, "__blk"])
            .withColumn(out, F.col("__run") + F.col("__before"))
            .drop("__blk", "__v", "__run", "__before"))


def numbered(df: DataFrame, keys: list[str], us: str, order: list, out: str = "rn",
             width_us: int = DEFAULT_BLOCK_US) -> DataFrame:
    """1-based row number per key."""
    return running_total(df, keys, us, order, F.lit(1), out, width_us)


def carried(df: DataFrame, keys: list[str], us: str, order: list[str], value: Column, out: str,
            width_us: int = DEFAULT_BLOCK_US, forward: bool = True, include_self: bool = False) -> DataFrame:
    """Last non-NULL ``value`` before the row (``forward``) or first after it.

    ``order`` names plain columns; the first is ``us``.
    """
    b = df.withColumn("__blk", block_of(F.col(us), width_us)).withColumn("__v", value)
    pick = F.max_by if forward else F.min_by
    pos = F.struct(*[F.col(o) for o in order])
    summary = (b.where(F.col("__v").isNotNull()).groupBy(*keys, "__blk").agg(pick("__v", pos).alias("__edge")))
    blocks = b.select(*keys, "__blk").distinct()
    edges = _null_safe(blocks, summary, [*keys, "__blk"])
    outer = Window.partitionBy(*keys).orderBy(F.col("__blk") if forward else F.col("__blk").desc())
    edges = edges.select(*keys, "__blk", F.last("__edge", ignorenulls=True)
                         .over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    inner = Window.partitionBy(*keys, "__blk").orderBy(*[F.col(o) if forward else F.col(o).desc() for o in order])
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    run = b.withColumn("__in", F.last("__v", ignorenulls=True).over(inner))
    return (_null_safe(run, edges, [*keys, "__blk"])
            .withColumn(out, F.coalesce("__in", "__carry")).drop("__blk", "__v", "__in", "__carry"))


def counted_in_window(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_us: str, right_us: str,
                      before_us: int, after_us: int, out: str, width_us: int = DEFAULT_BLOCK_US) -> DataFrame:
    """Rows of ``right`` with equal keys in ``[t - before, t + after]``, per left row.

    Two markers per left row ask for the running count of ``right`` at both ends
    of the window, so the work is linear in both sides: no pairs are formed.
    Rows of ``right`` without key or time are ignored, left rows get 0.
    """
    lo = left.select(*keys, F.col(left_id).alias("__id"), (F.col(left_us) - before_us).alias("__t"), F.lit(0).alias("__c"))
    hi = left.select(*keys, F.col(left_id).alias("__id"), (F.col(left_us) + after_us).alias("__t"), F.lit(2).alias("__c"))
    data = right.select(*keys, F.lit(None).cast(left.schema[left_id].dataType).alias("__id"),
                        F.col(right_us).alias("__t"), F.lit(1).alias("__c"))
    marks = lo.unionByName(hi).unionByName(data).where(F.col("__t").isNotNull())
    for k in keys:
        marks = marks.where(F.col(k).isNotNull())
    run = running_total(marks, keys, "__t", [F.col("__t"), F.col("__c")], (F.col("__c") == 1).cast("int"), "__cum", width_us)
    n = (run.where(F.col("__c") != 1).groupBy("__id")
         .agg(F.sum(F.when(F.col("__c") == 2, F.col("__cum")).otherwise(-F.col("__cum"))).alias(out)))
    return (left.join(n.withColumnRenamed("__id", left_id), left_id, "left")
            .withColumn(out, F.coalesce(out, F.lit(0).cast("bigint"))))


def exists_in_window(left: DataFrame, right: DataFrame, keys: list[str], left_us: str, right_us: str,
                     before_us: int, after_us: int, out: str) -> DataFrame:
    """Flag left rows with a right row of equal keys in ``[t - before, t + after]``.

    With blocks as wide as the window, the answer needs only the latest row of
    the block holding ``t - before`` and the earliest row of the next one. The
    right side is therefore pre-aggregated to one row per (key, block) before
    the shuffle and the join is one equi join with at most one partner.
    """
    span = max(int(before_us + after_us), 1)
    # A zero-width window still needs blocks; one microsecond wide is exact.
    b = block_of(F.col(right_us), span)
    sums = (right.where(F.col(right_us).isNotNull()).groupBy(*keys, b.alias("__blk"))
            .agg(F.min(right_us).alias("__min"), F.max(right_us).alias("__max")))
    both = (sums.select(*keys, "__blk", F.col("__max").alias("__own"), F.lit(None).cast("bigint").alias("__next"))
            .unionByName(sums.select(*keys, (F.col("__blk") - 1).alias("__blk"),
                                     F.lit(None).cast("bigint").alias("__own"), F.col("__min").alias("__next")))
            .groupBy(*keys, "__blk").agg(F.max("__own").alias("__own"), F.min("__next").alias("__next")))
    start = F.col(left_us) - before_us
    joined = left.withColumn("__blk", block_of(start, span)).join(both, [*keys, "__blk"], "left")
    hit = F.coalesce(F.col("__own") >= start, F.lit(False)) | F.coalesce(F.col("__next") <= start + span, F.lit(False))
    if before_us + after_us == 0:
        hit = F.coalesce(F.col("__own") == F.col(left_us), F.lit(False))
    return joined.withColumn(out, hit).drop("__blk", "__own", "__next").select(*left.columns, out)


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_us: str, right_us: str,
                   before_us: int, after_us: int) -> DataFrame:
    """Inner join on equal keys with ``right`` time in ``[t - before, t + after]``.

    For operators whose output is the pairs themselves. The time block joins the
    equi key, so a hot key spreads over its blocks; only the right side is
    doubled, and AQE may split a block that is still heavy.
    """
    span = max(int(before_us + after_us), 1)
    l = left.withColumn("__blk", block_of(F.col(left_us) - before_us, span))
    r = right.withColumn("__blk", F.explode(F.array(block_of(F.col(right_us), span), block_of(F.col(right_us), span) - 1)))
    r = r.withColumnRenamed("__blk", "__rblk")
    cond = F.col("__blk") == F.col("__rblk")
    for a, b in keys:
        cond = cond & (F.col(a) == F.col(b))
    cond = cond & F.col(right_us).between(F.col(left_us) - before_us, F.col(left_us) + after_us)
    return l.join(r, cond, "inner").drop("__blk", "__rblk")


def window_agg(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_us: str, right_us: str,
               before_us: int, after_us: int, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Aggregates of the ``right`` rows in ``[t - before, t + after]`` per ``left`` row.

    ``aggs`` maps an output to (column of ``right``, ``sum`` | ``max`` | ``min``);
    the column may be a struct, so a maximum can carry a whole best row. Rows of
    either side without key or time find nothing. Repeated left ids (several
    probe keys) fold into one result per id.

    With blocks as wide as the window, a window is the tail of one block plus
    the head of the next. Running aggregates from both block ends answer every
    window in one pass: linear work, no pairs, and a hot key is spread over its
    blocks.
    """
    span = int(before_us + after_us)
    if span <= 0:
        raise ValueError("the window must have a width")
    values = sorted({c for c, _ in aggs.values()})
    fields = {f.name: f.dataType for f in right.schema.fields}
    none = [F.lit(None).cast(fields[c]).alias(c) for c in values]
    lid = left.schema[left_id].dataType
    low, high = F.col(left_us) - before_us, F.col(left_us) + after_us
    rows = right.select(*keys, F.lit(None).cast(lid).alias("__id"), F.col(right_us).cast("bigint").alias("__t"), F.lit(0).alias("__c"),
                        block_of(F.col(right_us), span).alias("__blk"), *values)
    lows = left.select(*keys, F.col(left_id).alias("__id"), low.cast("bigint").alias("__t"), F.lit(1).alias("__c"), block_of(low, span).alias("__blk"), *none)
    highs = left.select(*keys, F.col(left_id).alias("__id"), high.cast("bigint").alias("__t"), F.lit(2).alias("__c"), (block_of(low, span) + 1).alias("__blk"), *none)
    marks = rows.unionByName(lows).unionByName(highs).where(F.col("__t").isNotNull())
    for k in keys:
        marks = marks.where(F.col(k).isNotNull())
    part = Window.partitionBy(*keys, "__blk")
    head = part.orderBy("__t", "__c").rowsBetween(Window.unboundedPreceding, 0)
    tail = part.orderBy(F.col("__t").desc(), "__c").rowsBetween(Window.unboundedPreceding, 0)
    fn = {"sum": F.sum, "max": F.max, "min": F.min}
    cols = {f"__{w}_{out}": fn[how](c).over(frame) for out, (c, how) in aggs.items() for w, frame in (("h", head), ("t", tail))}
    run = marks.withColumns(cols).where(F.col("__c") > 0)
    side = lambda out: F.when(F.col("__c") == 1, F.col(f"__t_{out}")).otherwise(F.col(f"__h_{out}"))
    got = run.groupBy(F.col("__id").alias(left_id)).agg(*[fn[how](side(out)).alias(out) for out, (_, how) in aggs.items()])
    return got


def with_window_agg(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_us: str, right_us: str,
                    before_us: int, after_us: int, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``left`` plus the aggregates; NULL (0 for sums) where the window is empty."""
    got = window_agg(left, right, keys, left_id, left_us, right_us, before_us, after_us, aggs)
    out = left.join(got, left_id, "left")
    return out.withColumns({o: F.coalesce(F.col(o), F.lit(0)) for o, (_, how) in aggs.items() if how == "sum"})
