"""Partitions by numbers of rows, so that what a task holds doesn't grow with a table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows of a piece, about.
EACH = 1 << 19


def pieces(rows: int, each: int = EACH) -> int:
    return max(1, math.ceil(rows / each))


def dealt_by(df: DataFrame, rows: int, *by: str, each: int = EACH) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by a hash of ``by`` in pieces of about ``each``; as it is where one would do."""
    n = pieces(rows, each)
    return df.repartition(n, *by) if n > 1 else df


def unique(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    """``df.distinct()`` over about ``rows`` rows: a task takes about ``each`` of them, and none holds those of a whole file before they are dealt."""
    return dealt_by(df, rows, *df.columns, each=each).distinct()
