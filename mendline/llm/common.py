"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that nothing before it is computed again."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def cut_with(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates over the rows that the write itself computes."""
    seen = Observation()
    done = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return done, seen.get


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once: long texts make batches of many rows large."""
    for name, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20)),
    ):
        spark.conf.set(name, value)


def give_back() -> None:
    """Return what a finished task has freed to the system: workers are reused, and would hold it while other stages run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def returning(run: Callable) -> Callable:
    """``run``, a function of batches, that gives its memory back at the end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column of ``docs`` can clash; a missing one is null."""
    have = {c.lower(): c for c in docs.columns}
    return docs.select(*[docs[f"`{have[c]}`"] if c in have else F.lit(None).alias(c) for c in columns])


def text_and_id(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (null counts as empty)."""
    d = narrow(docs, "doc_id", "text")
    return d.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


#: Rows of a few numbers each that may be broadcast.
MOST_BROADCAST = 1 << 18


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def few(rows: DataFrame) -> DataFrame:
    """``rows`` (a few numbers each), written and counted: up to ``MOST_BROADCAST`` of them are broadcast, so that what they are joined to stays
    where it is; beyond that they are built into a table for each shuffle partition."""
    done, seen = cut_with(rows, n=F.count(F.lit(1)))
    return F.broadcast(done) if seen["n"] <= MOST_BROADCAST else done.hint("shuffle_hash")


def without(docs: DataFrame, gone: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``gone``. Texts do not move where the ids are few, and are never sorted."""
    name = unused(docs, "gone")
    ids = few(gone.select(F.col(column).cast("long").alias(name)).distinct())
    return docs.join(ids, docs[column].cast("long") == F.col(name), "left_anti")


def without_rows(docs: DataFrame, judged: DataFrame, key: Column) -> DataFrame:
    """``docs`` less the rows that ``judged`` (doc_id, h, stays) says are to go; of repeated rows that stay, one.

    A row is told by its doc_id, which may be null, and by ``key``, a hash of its text that ``h`` holds.
    """
    each = cut(judged.groupBy("doc_id", "h").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")))
    h, gone_id, gone_h = (unused(docs, x) for x in ("h", "gone_id", "gone_h"))
    keyed = docs.withColumn(h, key)
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.col(h) == F.col(gone_h))
    named = lambda rows: few(rows.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)))
    stay = keyed.join(named(each.filter("not stays")), same, "left_anti")
    twice = each.filter("stays and n > 1")
    if not twice.isEmpty():
        twice = named(twice)
        stay = stay.join(twice, same, "left_anti").unionByName(stay.join(twice, same, "left_semi").dropDuplicates(["doc_id", h]))
    return stay.drop(h)
