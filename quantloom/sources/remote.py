"""Daily bars from a service, a partition a code: spark.read.format("quantloom_bars")."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "code string, date date, open double, high double, low double, close double, volume double, error string"


class BarsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        codes = dict.fromkeys(c.strip() for c in self.options["codes"].split(",") if c.strip())
        return [InputPartition(c) for c in codes]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows of one code; with skip_errors, a row of nulls that says what failed."""
        module, _, name = self.options["fetch"].partition(":")
        try:
            for row in getattr(import_module(module), name)(partition.value, self.options.get("start"), self.options.get("end")):
                yield (partition.value, *row, None)
        except Exception as e:  # the service's own errors, of any kind
            if self.options.get("skip_errors", "false").lower() != "true":
                raise
            yield (partition.value, None, None, None, None, None, None, f"{type(e).__name__}: {e}")


class BarsSource(DataSource):
    """Options: codes (comma-separated), fetch ("module:function" of (code, start, end), giving date, open, high, low, close, volume),
    start, end, skip_errors."""

    @classmethod
    def name(cls) -> str:
        return "quantloom_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarsReader:
        return BarsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BarsSource)
