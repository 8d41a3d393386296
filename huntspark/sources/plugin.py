"""Connectors written by users, as a Spark data source."""
from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, value):
        self.value = value


def register_connector(spark: SparkSession, name: str, schema: str, plan: Callable[[dict], Iterable], fetch: Callable[[dict, object], Iterable[tuple]]) -> None:
    """``spark.read.format(name)`` over a user's fetch function.

    ``plan(options)`` lists the pieces of work (time slices, object keys); each
    becomes a task that yields ``fetch(options, piece)`` as tuples in schema order.
    """
    source_name, source_schema = name, schema

    class Connector(DataSource):
        @classmethod
        def name(cls):
            return source_name

        def schema(self):
            return source_schema

        def reader(self, schema):
            options = dict(self.options)

            class Reader(DataSourceReader):
                def partitions(self):
                    return [_Part(p) for p in plan(options)]

                def read(self, partition):
                    yield from fetch(options, partition.value)

            return Reader()

    spark.dataSource.register(Connector)
