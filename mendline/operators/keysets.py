"""Uniqueness and relationships of integer keys by exact key sets of 64-bit words.

A set of integers is kept as words: ``key >> 6`` names a word, the low six bits a bit of it. Sets are built by a partial aggregation, so what is
shuffled is a row for each word and task, one for up to 64 neighbouring keys, and not a row for each key; a word with as many rows as bits
holds no duplicate, and bits that the parents' words lack are orphans. Only the keys of words that fail are counted one by one, by
reading the table again. Keys that lie far apart have a word each, so the sets are then as large as the keys; for those
``datatests.duplicate_keys`` and ``datatests.orphan_keys`` are the better choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _word(key: Column) -> Column:
    return F.shiftright(key, 6)


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def words(table: DataFrame, column: str) -> DataFrame:
    """``(word, bits, n_rows)`` of an integer column; null keys are left out."""
    keys = table.select(F.col(column).cast("bigint").alias("key")).filter("key is not null")
    return keys.groupBy(_word(F.col("key")).alias("word")).agg(F.bit_or(_bit(F.col("key"))).alias("bits"), F.count(F.lit(1)).alias("n_rows"))


def _counted(table: DataFrame, column: str, failing: DataFrame, name: str) -> DataFrame:
    """Rows of each key whose bit is among the bits of ``failing(word, bits)``."""
    keys = table.select(F.col(column).alias("own"), F.col(column).cast("bigint").alias("number")).filter("number is not null")
    met = keys.withColumn("word", _word(F.col("number"))).join(failing, "word").filter(F.col("bits").bitwiseAND(_bit(F.col("number"))) != 0)
    return met.groupBy(F.col("own").alias(name)).agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_integers(table: DataFrame, column: str) -> DataFrame:
    """``(<column>, n_rows)`` of the keys that occur more than once, as ``datatests.duplicate_keys`` has them."""
    failing = words(table, column).filter(F.col("n_rows") > F.bit_count("bits")).select("word", "bits")
    return _counted(table, column, failing, column).filter("n_rows > 1")


def orphan_integers(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """``(key, n_rows)`` of the child keys without a parent, as ``datatests.orphan_keys`` has them."""
    parents = words(parent, parent_key).select("word", F.col("bits").alias("known"))
    lacking = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("bigint"))))
    failing = words(child, child_key).join(parents, "word", "left").select("word", lacking.alias("bits")).filter("bits <> 0")
    return _counted(child, child_key, failing, "key")
