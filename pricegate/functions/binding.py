"""Columns that are worked out once, however often they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with further columns. Unlike those of a projection, the optimizer writes their expressions neither into
    what reads them nor into a filter that it moves down: they come out of a generator of one row."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
