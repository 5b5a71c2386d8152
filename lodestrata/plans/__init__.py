"""The registered queries of the evidence engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import citations, corpus, documents, matching, retrieval, review, rules, statutes

_ALL = retrieval.QUERIES | matching.QUERIES | documents.QUERIES | corpus.QUERIES | citations.QUERIES | review.QUERIES | statutes.QUERIES | rules.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
