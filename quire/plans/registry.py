"""Registers queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue(dict[str, tuple[Query, str | None]]):
    """``{name: (query, sql or None)}``."""

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self[function.__name__] = (function, sql)
            return function

        return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one table; the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Repartitions rows that lie in fewer partitions than there are cores, before heavy work on each row."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
