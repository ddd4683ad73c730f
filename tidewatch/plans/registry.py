"""All queries of the package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans import assurance, failures, studies, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**assurance.QUERIES, **studies.QUERIES, **failures.QUERIES, **tables.QUERIES}
ORACLE: dict[str, str] = {**assurance.ORACLE, **studies.ORACLE, **failures.ORACLE, **tables.ORACLE}
