"""Schema drift between contracts and live tables.

``contracts(model, column, data_type, …)`` meets ``live(table, column, data_type, …)`` in one full outer join on the
table and the lower-cased column, for all models at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R


def type_family(type_name: Column, strict: bool = False) -> Column:
    """Family of a lower-cased type name, null where unknown. Parameters such as ``(10,2)`` are ignored unless ``strict``."""
    bare = type_name if strict else F.trim(F.regexp_replace(type_name, r"\(.*\)", ""))
    family = F.when(F.lit(False), "")
    for name, aliases in R.TYPE_FAMILIES.items():
        family = family.when(bare.isin(aliases), name)
    return family


def spark_type_name(simple: Column) -> Column:
    """Spark's type name in the wording of the families: a bare ``timestamp`` there carries a zone in Spark."""
    renamed = F.when(F.lit(False), "")
    for spark_name, name in R.SPARK_TYPE_NAMES.items():
        renamed = renamed.when(simple == spark_name, name)
    return renamed.otherwise(simple)


def types_compatible(a: Column, b: Column, strict: bool = False) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a == b) | F.coalesce(type_family(a, strict) == type_family(b, strict), F.lit(False))


def detect_drift(contracts: DataFrame, live: DataFrame, strict: bool = False, model: str | None = None) -> DataFrame:
    """``(model, column, category, declared_type, live_type)`` with category missing, undocumented or type_mismatch.

    Models without any live column are left to ``unreadable_tables``; live tables without a contract are not compared.
    """
    if model:
        contracts = contracts.filter(F.col("model") == model)
    key = F.lower("column")
    declared = (
        contracts.filter(F.col("column").isNotNull())
        .groupBy("model", key.alias("column"))
        .agg(F.max(F.lower(F.trim("data_type"))).alias("declared_type"), F.lit(True).alias("declared"))
    )
    actual = live.groupBy(F.col("table").alias("model"), key.alias("column")).agg(
        F.max(F.lower(F.trim("data_type"))).alias("live_type"), F.lit(True).alias("live")
    )
    models = contracts.select("model").distinct()
    tables = live.select(F.col("table").alias("model")).distinct()
    both = models.join(tables, "model", "left_semi")
    compared = declared.join(actual, ["model", "column"], "full_outer")
    typed = F.coalesce("declared_type", F.lit("")) != ""
    category = (
        F.when(F.col("live").isNull(), "missing")
        .when(F.col("declared").isNull(), "undocumented")
        .when(typed & ~types_compatible(F.col("declared_type"), F.col("live_type"), strict), "type_mismatch")
    )
    found = compared.withColumn("category", category).filter(F.col("category").isNotNull())
    # The pairs are reduced to drift rows before they meet the models that exist on both sides.
    return found.join(both, "model", "left_semi").select("model", "column", "category", "declared_type", "live_type")


def drift_report(contracts: DataFrame, live: DataFrame, strict: bool = False, model: str | None = None) -> DataFrame:
    """Drift counts of every model; ``status`` is drift, clean or unreadable (no live table)."""
    if model:
        contracts = contracts.filter(F.col("model") == model)
    counts = detect_drift(contracts, live, strict).groupBy("model").agg(
        F.count_if(F.col("category") == "missing").alias("n_missing"),
        F.count_if(F.col("category") == "undocumented").alias("n_undocumented"),
        F.count_if(F.col("category") == "type_mismatch").alias("n_type_mismatch"),
    )
    tables = live.select(F.col("table").alias("model")).distinct().withColumn("found", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("n_missing") + zero("n_undocumented") + zero("n_type_mismatch")
    return (
        contracts.select("model")
        .distinct()
        .join(tables, "model", "left")
        .join(counts, "model", "left")
        .select(
            "model",
            zero("n_missing").alias("n_missing"),
            zero("n_undocumented").alias("n_undocumented"),
            zero("n_type_mismatch").alias("n_type_mismatch"),
            total.alias("n_total"),
            F.when(F.col("found").isNull(), "unreadable").when(total > 0, "drift").otherwise("clean").alias("status"),
        )
    )


def unreadable_tables(contracts: DataFrame, live: DataFrame) -> DataFrame:
    """Contract models without a live table: an error row each, the others go on."""
    return contracts.select("model").distinct().join(
        live.select(F.col("table").alias("model")).distinct(), "model", "left_anti"
    )


def unknown_models(requested: DataFrame, contracts: DataFrame) -> DataFrame:
    """Requested models that no contract holds."""
    return requested.select("model").distinct().join(contracts.select("model").distinct(), "model", "left_anti")


def drift_findings(drift: DataFrame) -> DataFrame:
    """Drift rows as findings per model and category."""
    return (
        drift.groupBy("model", "category")
        .agg(F.count("*").alias("n"), F.min("column").alias("evidence"))
        .select(
            F.lit("drift").alias("family"),
            F.col("model").alias("artifact"),
            F.col("category").alias("rule_id"),
            F.when(F.col("category") == "undocumented", "WARNING").otherwise("ERROR").alias("severity"),
            "n",
            "evidence",
        )
    )
