"""Pairs each query with its SQL twin and rounds both the same way."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.queries.tables import Tables, with_views

MODULES = ("annotation", "describing", "testing", "spatial", "pixel", "mask", "surface", "tracking", "dataset", "files", "streams")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    body: str | None
    views: Sequence[str]
    digits: Mapping[str, int]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(Tables(spark, sf_dir))
        return out.select(*[
            (F.round(F.col(c), self.digits[c]) + F.lit(0.0)).alias(c) if c in self.digits else F.col(c)
            for c in out.columns])

    def sql(self) -> str | None:
        if self.body is None:
            return None
        if not self.digits:
            return with_views(self.views, self.body)
        rounded = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in self.digits.items())
        return with_views(self.views, f"SELECT * REPLACE ({rounded}) FROM (\n{self.body}\n) AS answer")


_QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = (), digits: Mapping[int, str] | None = None):
    """Register a query; `digits` maps a number of decimals to the columns rounded to it in both languages."""
    per_column = {c: d for d, cols in (digits or {}).items() for c in cols.split()}

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in _QUERIES, name
        _QUERIES[name] = Query(name, build, sql, views, per_column)
        return build

    return register


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"mesograph.queries.{module}")
    return _QUERIES


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in load().items()}


def all_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in load().items() if q.body is not None}
