"""Gaps and islands: consecutive runs along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: str | list[str], starts: Column, name: str = "run") -> DataFrame:
    """``df`` with the ordinal of the run each row belongs to, from 0 within ``keys``.

    ``starts`` is evaluated on each row and may look back with ``prev``; the first row always starts a run.
    One sort per key group serves both windows.
    """
    order = [order] if isinstance(order, str) else order
    along = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(along) == 1
    flagged = df.withColumn("__start", F.when(first | starts, 1).otherwise(0))
    counted = F.sum("__start").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return flagged.withColumn(name, counted.cast("long")).drop("__start")


def prev(column: str, keys: list[str], order: str | list[str]) -> Column:
    """The value one row before, in the same windows as ``islands``."""
    order = [order] if isinstance(order, str) else order
    return F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
