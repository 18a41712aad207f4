"""Named queries: a Spark plan over the tables and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidlake.plans.views import VIEWS
from evidlake.session import ship_package
from evidlake.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return register


def with_views(sql: str) -> str:
    """Prepend the views a statement mentions, dependencies first, as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bV_[A-Z]+\b", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[14:]}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            # Zone-less timestamps of the tables are UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plan(Tables(spark, folder))

        return run

    return {name: bind(plan) for name, plan in PLANS.items()}
