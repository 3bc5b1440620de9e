"""Keeping a table's own columns apart from the ones an operator adds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """`docs` with all columns but `used` renamed by their place; `toDF(*docs.columns)` undoes it."""
    return docs.toDF(*(c if c in used else f"own_{k}" for k, c in enumerate(docs.columns)))
