"""Queries by name, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.plans.oracle import oracle
from pressloom.sources.model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    """Floating results to ``digits`` places, as engines add in different orders."""
    return frame.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes])


def query(name: str, sql: str | None = None, model: bool = True):
    """Register ``function(model)``; ``sql`` runs over the model tables, or as it is."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(Model(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = oracle(sql) if model else sql
        return function

    return register
