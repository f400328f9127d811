"""Named queries over whole tables, each with the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return register


#: The tables that queries may name; any other name is refused before a path is made of it.
TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings children parents table_summaries jun2023_uvo human_eval_34q audit_sample_review".split())


class Tables:
    """The tables of a folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
