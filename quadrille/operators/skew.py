"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to (a power of two).
SALTS = 512


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (at most one row for each key) on ``key``; columns of both, ``key`` once.

    Rows are dealt by the key and a hash of the columns ``by``, so a key with a
    third of all rows spreads over ``SALTS`` tasks; the table's row goes only to
    the parts that hold the key. Null keys match nothing.
    """
    dealt = rows.withColumn("__salt", F.xxhash64(*by).bitwiseAND(F.lit(SALTS - 1))).repartition(key, "__salt")
    # the parts read the same exchange, so they come without another shuffle of the rows
    parts = dealt.select(key, "__salt").distinct().join(table, key)
    return dealt.join(parts, [key, "__salt"], how).drop("__salt")
