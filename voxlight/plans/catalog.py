"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def added(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return f

    return added


def load() -> tuple[dict, dict]:
    from . import apply_queries, coeff_queries, grid_queries, ingest_queries, ray_queries, volume_queries  # noqa: F401

    return QUERIES, ORACLES
