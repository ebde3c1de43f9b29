"""Live columns, table lists and table descriptions, from Spark's catalog, DataFrames or a database."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from mendline.functions import rules as R
from mendline.operators.drift import spark_type_name

_LIVE = "table STRING, column STRING, data_type STRING, nullable BOOLEAN, ordinal BIGINT"


def _live(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, _LIVE).withColumn("data_type", spark_type_name(F.col("data_type")))


def live_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns of analysed tables; schemas only, no data is read."""
    spark = next(iter(tables.values())).sparkSession
    return _live(
        spark,
        [
            (name, f.name.lower(), f.dataType.simpleString(), f.nullable, i)
            for name, df in tables.items()
            for i, f in enumerate(df.schema.fields, 1)
        ],
    )


def catalog_columns(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Columns of catalog tables; a table that does not exist is left out and shows as unreadable in the drift report."""
    rows = [
        (name, c.name.lower(), c.dataType, c.nullable, i)
        for name in tables
        if spark.catalog.tableExists(name)
        for i, c in enumerate(spark.catalog.listColumns(name), 1)
    ]
    return _live(spark, rows)


def named_columns(columns: DataFrame, schema: str = "public", tables: Sequence[str] | None = None) -> DataFrame:
    """Live columns out of an ``information_schema.columns`` table of any database.

    ``tables`` picks tables as ``table`` (of ``schema``) or ``schema.table``; without it all of ``schema`` are taken. Databases differ in
    the case of unquoted names, so names are compared and returned in lower case; a table asked for as ``schema.table`` is
    called that in the result.
    """
    owner, table = F.lower("table_schema"), F.lower("table_name")
    if tables is None:
        chosen, name = owner == schema.lower(), table
    else:
        wanted = sorted({t.lower() for t in tables})
        full = F.concat(owner, F.lit("."), table)
        plain = (owner == schema.lower()) & table.isin([t for t in wanted if "." not in t])
        dotted = full.isin([t for t in wanted if "." in t])
        chosen, name = plain | dotted, F.when(dotted, full).otherwise(table)
    return columns.filter(chosen).select(
        name.alias("table"),
        F.lower("column_name").alias("column"),
        F.lower("data_type").alias("data_type"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        F.col("ordinal_position").cast("bigint").alias("ordinal"),
        F.col("column_default").cast("string").alias("default"),
    )


def jdbc_columns(
    spark: SparkSession, url: str, schema: str = "public", tables: Sequence[str] | None = None, **options: str
) -> DataFrame:
    """``named_columns`` of a database; the user supplies the driver."""
    return named_columns(spark.read.format("jdbc").options(url=url, dbtable="information_schema.columns", **options).load(), schema, tables)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``(schema, table, type)`` of the catalog's tables and views, by name."""
    rows = [(".".join(t.namespace or []), t.name, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "schema STRING, table STRING, type STRING").orderBy("schema", "table")


def jdbc_tables(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """``(schema, table, type)`` of a database's own tables, system schemas left out."""
    source = spark.read.format("jdbc").options(url=url, dbtable="information_schema.tables", **options).load()
    return (
        source.filter(~F.lower("table_schema").isin("pg_catalog", "information_schema"))
        .select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("table_type").alias("type"))
        .orderBy("schema", "table")
    )


def _default(field: StructField) -> str | None:
    """The default of a column, which Spark keeps in the field's metadata."""
    text = (field.metadata or {}).get("CURRENT_DEFAULT")
    return None if text is None else text[: R.DEFAULT_CHARS]


def describe_table(table: DataFrame, name: str) -> DataFrame:
    """Columns with type, nullability, default, exact row count and null count, from one pass over the table.

    A default is cut to 30 characters; columns without one, and tables that keep none, have null.
    """
    fields = table.schema.fields
    counts = table.agg(
        F.count("*").alias("n_rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)]
    )
    per_column = F.array(
        *[
            F.struct(
                F.lit(f.name.lower()).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"),
                F.lit(i + 1).cast("bigint").alias("ordinal"),
                F.lit(_default(f)).cast("string").alias("default"),
                (F.col("n_rows") - F.col(f"c{i}")).alias("n_nulls"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return (
        counts.select("n_rows", F.explode(per_column).alias("c"))
        .select(F.lit(name).alias("table"), "c.*", "n_rows")
        .withColumn("data_type", spark_type_name(F.col("data_type")))
    )


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``describe_table`` of several tables in one result."""
    return reduce(DataFrame.unionByName, [describe_table(df, name) for name, df in tables.items()])
