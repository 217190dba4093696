"""Every query of the library by name, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.plans import queries as P


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well vectors find the next ones of their label: means by label, question type and all."""
    return P.retrieval_rollup(spark, sf_dir)


def queries() -> dict[str, P.Query]:
    return dict(P.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(P.SQL)
