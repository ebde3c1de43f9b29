"""Writers of generated contracts and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.scale import grows
from mendline.sources.textfiles import write_named


def _quoted(text: Column) -> Column:
    """A JSON string, which is also a YAML scalar."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def contract_text(columns: DataFrame, tests: DataFrame) -> DataFrame:
    """Contract documents as text: ``(model, ordinal, value)``, the heading at 0 and one row per column.

    The rows of a model in order of ``ordinal`` are its YAML file. No row gathers more than one column's tests.
    """
    t = F.col("test")
    item = (
        F.when(
            t == "relationships",
            F.concat(
                F.lit("\n          - relationships:\n              to: "),
                _quoted(F.concat(F.lit("ref('"), F.col("ref_model"), F.lit("')"))),
                F.lit("\n              field: "),
                _quoted(F.col("ref_field")),
            ),
        )
        .when(
            t == "accepted_values",
            F.concat(F.lit("\n          - accepted_values:\n              values: "), F.to_json("accepted")),
        )
        .otherwise(F.concat(F.lit("\n          - "), t))
    )
    # The order in which the tests of one column are listed.
    place = F.array_position(F.array(*map(F.lit, ["unique", "not_null", "relationships", "accepted_values"])), t)
    per_column = (
        tests.groupBy("model", "column")
        .agg(F.array_sort(F.collect_set(F.struct(place.alias("p"), item.alias("i")))).alias("items"))
        .select("model", "column", F.array_join(F.transform("items", lambda x: x["i"]), "").alias("items"))
    )
    body = columns.join(grows(per_column), ["model", "column"], "left").select(
        "model",
        "ordinal",
        F.concat(
            F.lit("      - name: "),
            _quoted(F.col("column")),
            F.lit('\n        description: ""\n        tests:'),
            F.coalesce("items", F.lit(" []")),
        ).alias("value"),
    )
    before, after = R.CONTRACT_DESCRIPTION.split("{model}")
    heading = F.concat(
        F.lit("version: 2\nmodels:\n  - name: "),
        _quoted(F.col("model")),
        F.lit("\n    description: "),
        _quoted(F.concat(F.lit(before), F.col("model"), F.lit(after))),
        F.lit("\n    columns:"),
    )
    heads = columns.select("model").distinct().select("model", F.lit(0).cast("bigint").alias("ordinal"), heading.alias("value"))
    return heads.unionByName(body)


def write_contracts(columns: DataFrame, tests: DataFrame, target: str) -> None:
    """One folder per model below ``target``; its part files in name order are the YAML document.

    Rows are range-partitioned by model and position, so a large model is written by several tasks.
    """
    text = contract_text(columns, tests).withColumn("model", F.coalesce("model", F.lit("")))
    (
        text.repartitionByRange("model", "ordinal")
        .sortWithinPartitions("model", "ordinal")
        .select("model", "value")
        .write.mode("errorifexists")
        .partitionBy("model")
        .text(target)
    )


def contract_files(columns: DataFrame, tests: DataFrame, folder: str) -> DataFrame:
    """``(path, content)``: one YAML file ``<folder>/<model>.yml`` per model. A row gathers the columns of one model."""
    text = contract_text(columns, tests).groupBy("model").agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("rows"))
    body = F.concat(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"), F.lit("\n"))
    return text.select(F.concat(F.lit(folder.rstrip("/") + "/"), F.coalesce("model", F.lit("")), F.lit(".yml")).alias("path"), body.alias("content"))


def write_texts(files: DataFrame) -> None:
    """Texts to the files they are named for; see ``textfiles.write_named``."""
    write_named(files)


def write_findings(findings: DataFrame, target: str) -> None:
    """Findings as parquet, one folder per family."""
    findings.write.mode("errorifexists").partitionBy("family").parquet(target)
