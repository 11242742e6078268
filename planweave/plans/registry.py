"""Registered queries of the document-analytics operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planweave.plans import pages, reports, tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return pages.QUERIES | tables.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return pages.SQL | tables.SQL | reports.SQL
