"""All queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, mixing, nn_descent, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, warc

MODULES = (simhash, chat_format, quality_rules, warc, pii, nn_descent, substring_dedup, quality_classifier, packing, mixing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
