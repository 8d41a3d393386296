"""Small helpers the operators share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from huntspark.session import cut_lineage, shared_dir

#: Words are separated by ASCII white space only.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Bytes of rows that go to a Python worker at once, and the session's setting for it.
BATCH_BYTES, MAX_BYTES = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = ["SPACE", "WORD", "cut_lineage", "give_back", "shared_dir", "small_batches", "table", "partitions", "uniform", "words_in"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the machine; workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about ``BATCH_BYTES``, unless the session has a bound of its own.

    By default 10,000 rows are one batch. Of long texts that is tens of MB, which
    the executor holds outside its heap, twice while the batch grows, and the
    worker once more. The setting stays, as plans run after they are made.
    """
    if spark.conf.get(MAX_BYTES, None) is None:
        spark.conf.set(MAX_BYTES, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the cluster asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_in(text: Column) -> Column:
    """Number of words; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(*parts) -> Column:
    """A number in [0, 1) that the parts decide."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)
