"""Test coverage: models against the entries and column tests of their contracts.

``contracts(model, column, data_type, tests)`` has one row per documented column, and one row with a null column for
an entry without columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _filtered(models: DataFrame, contracts: DataFrame, model: str | None) -> tuple[DataFrame, DataFrame]:
    if model:
        return models.filter(F.col("name") == model), contracts.filter(F.col("model") == model)
    return models, contracts


def models_without_entry(models: DataFrame, contracts: DataFrame, model: str | None = None) -> DataFrame:
    """Names of ``models(name)`` that no contract holds."""
    models, contracts = _filtered(models, contracts, model)
    return models.select("name").distinct().join(contracts.select(F.col("model").alias("name")).distinct(), "name", "left_anti")


def _named_columns(contracts: DataFrame) -> DataFrame:
    return contracts.filter(F.coalesce("column", F.lit("")) != "")


def column_coverage(models: DataFrame, contracts: DataFrame, model: str | None = None) -> DataFrame:
    """``(model, n_columns, n_tested, n_untested, coverage)`` of entries that have a model.

    ``coverage`` is full without an untested column, so also for an entry without columns. Columns are counted
    per model before the semi join.
    """
    models, contracts = _filtered(models, contracts, model)
    named = F.coalesce("column", F.lit("")) != ""
    tested = named & (F.coalesce(F.size("tests"), F.lit(0)) > 0)
    counts = contracts.groupBy("model").agg(
        F.count_if(named).alias("n_columns"), F.count_if(tested).alias("n_tested")
    )
    names = models.select(F.col("name").alias("model")).distinct()
    untested = F.col("n_columns") - F.col("n_tested")
    return counts.join(names, "model", "left_semi").select(
        "model",
        "n_columns",
        "n_tested",
        untested.alias("n_untested"),
        F.when(untested == 0, "full").otherwise("partial").alias("coverage"),
    )


def untested_columns(models: DataFrame, contracts: DataFrame, model: str | None = None) -> DataFrame:
    """``(model, column)`` of documented columns without a test, as rows rather than a list per model."""
    models, contracts = _filtered(models, contracts, model)
    untested = _named_columns(contracts).filter(F.coalesce(F.size("tests"), F.lit(0)) == 0).select("model", "column")
    names = models.select(F.col("name").alias("model")).distinct()
    return untested.join(names, "model", "left_semi")


def coverage_summary(models: DataFrame, contracts: DataFrame, model: str | None = None) -> DataFrame:
    """Schema and column coverage in per cent, rounded half to even.

    Entries without a model count as entries, so schema coverage can pass 100.
    """
    models, contracts = _filtered(models, contracts, model)
    per_model = column_coverage(models, contracts)
    names = models.select(F.lit("model").alias("k"), F.col("name").alias("v"))
    entries = contracts.select(F.lit("entry").alias("k"), F.col("model").alias("v"))
    totals = names.unionByName(entries).distinct().agg(
        F.count_if(F.col("k") == "model").alias("n_models"), F.count_if(F.col("k") == "entry").alias("n_entries")
    )
    columns = per_model.agg(
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("n_columns"), F.coalesce(F.sum("n_tested"), F.lit(0)).alias("n_tested")
    )
    # Both are single rows with columns of their own, so their union sums to one row.
    names_of = ["n_models", "n_entries", "n_columns", "n_tested"]
    one = totals.unionByName(columns, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names_of]
    )

    def percent(part: str, whole: str):
        ratio = F.bround(F.col(part) / F.col(whole) * 100, 0).cast("bigint")
        return F.when(F.col(whole) > 0, ratio).otherwise(F.lit(0))

    return one.select(
        "n_models",
        "n_entries",
        percent("n_entries", "n_models").alias("schema_pct"),
        "n_tested",
        "n_columns",
        percent("n_tested", "n_columns").alias("column_pct"),
    )
