"""All queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis_plans, geometry_plans, ranking_plans, raster_plans, recognition_plans, scoring_plans

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (scoring_plans, ranking_plans, geometry_plans, raster_plans, analysis_plans, recognition_plans)


def queries() -> dict[str, Query]:
    return {name: made for m in MODULES for name, (made, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
