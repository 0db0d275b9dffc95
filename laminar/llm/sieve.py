"""A bounded bitmap that keeps most rows without a partner out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24  # 2**18 words of 64 bits at most, whatever the number of keys


def sieve(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is one of the same column of ``keys``, and a share of others: join exactly afterwards.

    Of n different keys, about n / 2**24 of the other rows pass. The bitmap is broadcast: its size is bounded by its
    number of words, not by the keys. Nulls never pass.
    """
    place = F.xxhash64(column).bitwiseAND((1 << BITS) - 1)
    bitmap = keys.where(F.col(column).isNotNull()).select(place.alias("__at"))
    bitmap = bitmap.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, CAST(`__at` & 63 AS int)))").alias("__bits"))
    placed = rows.where(F.col(column).isNotNull()).withColumn("__at", place).withColumn("__word", F.shiftright("__at", 6))
    passed = placed.join(F.broadcast(bitmap), "__word").where(F.expr("(shiftrightunsigned(`__bits`, CAST(`__at` & 63 AS int)) & 1L) = 1"))
    return passed.select(rows.columns)
