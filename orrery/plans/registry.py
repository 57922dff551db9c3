"""All queries of the core operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans.oracles import SQL
from orrery.plans.queries import QUERIES
from orrery.session import shipped


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
