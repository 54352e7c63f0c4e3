"""Registry of queries and small helpers shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expr import quantize
from tidemark.plans.oracle_views import with_views
from tidemark.session import configure
from tidemark.sources.views import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return self.build(Tables(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def q(expression: str, digits: int = 6) -> str:
    """SQL twin of functions.expr.quantize."""
    scale = f"1e{digits}"
    return f"(floor(({expression}) * {scale} + 0.4873) / {scale})"


def qc(name: str | Column, alias: str | None = None, digits: int = 6) -> Column:
    """Quantized output column."""
    return quantize(name, digits).alias(alias or name)


def big(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return column.cast("bigint").alias(alias or name)
