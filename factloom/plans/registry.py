"""Every query of the engine with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, extraction, joins, pages, relations, scalars, scores, state, texts, windows

MODULES: tuple = (scores, aggregates, joins, windows, scalars, state, relations, texts, extraction, pages)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity of every market."""
    return scores.QUERIES["sc03_intensity"](spark, sf_dir)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
