"""All registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from taxloom.plans import analytics, decisions, dialect, engine, paper, rules, stored
from taxloom.sources.adapters import VIEWS


def _sql_query(template: dialect.Template, spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, template, VIEWS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_sql_query, template) for name, template in (analytics.QUERIES | rules.QUERIES).items()} | engine.QUERIES | stored.QUERIES | paper.QUERIES | decisions.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: dialect.render(template, VIEWS, dialect.DUCKDB) for name, template in (analytics.QUERIES | analytics.ORACLES | rules.QUERIES | rules.ORACLES | engine.ORACLES | stored.ORACLES | paper.ORACLES | decisions.ORACLES).items()}
