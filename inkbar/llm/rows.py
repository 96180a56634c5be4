"""Carrying whole rows through joins without touching their column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and the named columns beside it.

    Whatever names ``docs`` has, they cannot clash with those an operator adds.
    """
    return docs.select(F.expr("struct(*)").alias("row"), *(c.alias(k) for k, c in more.items()))


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
