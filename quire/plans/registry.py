"""A registry that binds a query name to its Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names to plans; ``sql`` holds the oracle of those that have one."""

    def __init__(self) -> None:
        self.plans: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that registers a plan under ``name``."""

        def keep(plan: Query) -> Query:
            if name in self.plans:
                raise ValueError(f"{name} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the path may be any that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt by a key to four tasks a core. A small file is read by one task, or one for
    each of its row groups, however long the work on a row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)
