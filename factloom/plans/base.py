"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.tables import role, table, with_roles


class Tables:
    """Roles and tables of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Book:
    """The queries of a module."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, name: str, sql: str = "", roles: str = ""):
        """Registers f(Tables) under a name; roles: blank-separated roles that the SQL reads."""

        def put(f):
            self.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.ORACLE[name] = with_roles(sql, *roles.split()) if roles else sql
            return f

        return put
