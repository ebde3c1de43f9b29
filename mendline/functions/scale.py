"""Helpers for long plans and for orders over whole tables.

Joins with heavy keys are left to adaptive execution, which splits such keys by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut points: ``spark.checkpoint.dir`` of the session; where that is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: nothing before it is computed again when an executor is lost.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, which the write itself counts."""
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return done, seen.get["n"]


def grows(df: DataFrame) -> DataFrame:
    """Marks a side of a join as one that grows with the input: it is sorted and merged, never broadcast.

    Spark guesses sizes from the compressed bytes of the files read, far below those of rows made of them, and a broadcast goes through the driver.
    """
    return df.hint("merge")


def looked_up(df: DataFrame) -> DataFrame:
    """Marks a side of a join that has one row for a key, while the other may have very many: those stream past a table for each partition, and
    are neither sorted nor held. Nothing is broadcast."""
    return df.hint("shuffle_hash")


def spread(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` (narrow rows, each of which will cost much work) dealt out to a partition for every ``rows`` of them.

    A small file is read by one task, however much is made of each of its rows.
    """
    n = -(-df.count() // rows)
    return df.repartition(n) if n > 1 else df


def parts(n: int, rows: int = 10_000) -> int:
    """Partitions that ``n`` rows of a few numbers need; for ``coalesce``, which leaves larger tables as they are."""
    return max(1, -(-n // rows))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1..n in ``order`` without sending them through one task.

    Rows are range-partitioned and numbered inside each range; each range then adds the
    row count of the ranges before it. ``order`` should end in a unique column.
    """
    # Finding the range bounds reads the rows once more, so they are computed and written before.
    ranged = cut(cut(df).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    # One row per range: its number is that of the shuffle partitions, not of the data.
    before = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("_range", "_before")
    )
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(before), "_range")
        .withColumn(name, F.col("_local").cast("bigint") + F.col("_before"))
        .drop("_range", "_local", "_before")
    )
