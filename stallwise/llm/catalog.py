"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import contracts, contracts_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**contracts.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**contracts_sql.SQL, **sql}
