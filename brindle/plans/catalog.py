"""All registries of the library, apart from the optional subpackages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import content_queries, core_problems, more_queries, series_queries, sql_queries, stats_queries
from brindle.plans.registry import Registry


def registries() -> list[Registry]:
    return [core_problems.REG, series_queries.REG, stats_queries.REG, sql_queries.REG, content_queries.REG, more_queries.REG]


REG_FLAGSHIP = stats_queries.REG.queries["n16_flux_recipe"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REG_FLAGSHIP(spark, sf_dir)
