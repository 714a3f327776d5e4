"""Named queries over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import evaluation, finals, modelling, pipelines, records, texts

    return {**evaluation.QUERIES, **texts.QUERIES, **modelling.QUERIES, **records.QUERIES, **pipelines.QUERIES, **finals.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _all().items() if q}
