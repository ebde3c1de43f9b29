import pytest
from pyspark.sql import functions as F

from mendline.operators import coverage, drift

CONTRACT = "model string, column string, data_type string, tests array<string>"
LIVE = "table string, column string, data_type string"


@pytest.fixture(scope="module")
def project(spark):
    models = spark.createDataFrame([("dim_store",), ("fct_sales",), ("stg_items",), ("lonely",)], "name string")
    contracts = spark.createDataFrame(
        [
            ("dim_store", "store_id", None, ["unique"]),
            ("dim_store", "email", None, ["not_null"]),
            ("fct_sales", "sale_id", None, ["unique", "not_null"]),
            ("fct_sales", "amount", None, None),
            ("fct_sales", "note", None, []),
            ("fct_sales", "", None, None),
            ("stg_items", None, None, None),
            ("no_file", "x", None, None),
        ],
        CONTRACT,
    )
    return models, contracts


def test_coverage(project, rows):
    assert rows(coverage.models_without_entry(*project)) == [("lonely",)]
    assert rows(coverage.column_coverage(*project)) == [
        ("dim_store", 2, 2, 0, "full"),
        ("fct_sales", 3, 1, 2, "partial"),
        ("stg_items", 0, 0, 0, "full"),
    ]
    assert rows(coverage.untested_columns(*project)) == [("fct_sales", "amount"), ("fct_sales", "note")]
    # Entries without a file count as entries.
    assert rows(coverage.coverage_summary(*project)) == [(4, 4, 100, 3, 5, 60)]


def test_coverage_of_one_model(project, rows):
    assert rows(coverage.column_coverage(*project, model="fct_sales"), "model") == [("fct_sales",)]
    assert rows(coverage.models_without_entry(*project, model="lonely")) == [("lonely",)]
    assert rows(coverage.coverage_summary(*project, model="dim_store")) == [(1, 1, 100, 2, 2, 100)]
    assert rows(coverage.coverage_summary(*project, model="nowhere")) == [(0, 0, 0, 0, 0, 0)]


def test_half_even_rounding(spark, rows):
    models = spark.createDataFrame([(f"m{i}",) for i in range(8)], "name string")
    contracts = spark.createDataFrame([("m0", "c", None, None)], CONTRACT)
    # 12.5 % rounds to 12.
    assert rows(coverage.coverage_summary(models, contracts), "schema_pct") == [(12,)]


@pytest.mark.parametrize(
    "declared, live, equal",
    [
        ("integer", "bigint", True),
        ("varchar", "character varying", True),
        ("boolean", "bool", True),
        ("timestamptz", "timestamp with time zone", True),
        ("timestamp", "timestamptz", False),
        ("string", "bigint", False),
        ("numeric(10,2)", "double precision", True),
        ("geometry", "geometry", True),
        ("geometry", "geography", False),
        (" TEXT ", "text", True),
    ],
)
def test_types(spark, declared, live, equal):
    got = spark.range(1).select(drift.types_compatible(F.lit(declared), F.lit(live)).alias("x")).first().x
    assert got is equal


def test_strict_types_keep_parameters(spark):
    same = drift.types_compatible(F.lit("varchar(255)"), F.lit("text"), strict=True)
    assert spark.range(1).select(same.alias("x")).first().x is False


@pytest.fixture(scope="module")
def declared_and_live(spark):
    contracts = spark.createDataFrame(
        [
            ("sales", "Sale_Id", "integer", None),
            ("sales", "ghost", "text", None),
            ("sales", "amount", "varchar", None),
            ("sales", "free", None, None),
            ("clean", "id", None, None),
            ("gone", "id", None, None),
        ],
        CONTRACT,
    )
    live = spark.createDataFrame(
        [
            ("sales", "sale_id", "bigint"),
            ("sales", "amount", "double precision"),
            ("sales", "free", "boolean"),
            ("sales", "extra", "boolean"),
            ("clean", "ID", "bigint"),
            ("unrelated", "x", "bigint"),
        ],
        LIVE,
    )
    return contracts, live


def test_drift(declared_and_live, rows):
    assert rows(drift.detect_drift(*declared_and_live)) == [
        ("sales", "amount", "type_mismatch", "varchar", "double precision"),
        ("sales", "extra", "undocumented", None, "boolean"),
        ("sales", "ghost", "missing", "text", None),
    ]
    assert rows(drift.drift_report(*declared_and_live)) == [
        ("clean", 0, 0, 0, 0, "clean"),
        ("gone", 0, 0, 0, 0, "unreadable"),
        ("sales", 1, 1, 1, 3, "drift"),
    ]
    assert rows(drift.unreadable_tables(*declared_and_live)) == [("gone",)]
    assert rows(drift.drift_report(*declared_and_live, model="clean"), "model") == [("clean",)]
    assert rows(drift.drift_findings(drift.detect_drift(*declared_and_live)), "rule_id", "severity") == [
        ("missing", "ERROR"), ("type_mismatch", "ERROR"), ("undocumented", "WARNING"),
    ]


def test_unknown_model(spark, declared_and_live, rows):
    asked = spark.createDataFrame([("sales",), ("nonexistent",)], "model string")
    assert rows(drift.unknown_models(asked, declared_and_live[0])) == [("nonexistent",)]


def test_swapping_sides_swaps_missing_and_undocumented(declared_and_live, rows):
    contracts, live = declared_and_live
    swapped = drift.detect_drift(
        live.select(F.col("table").alias("model"), "column", "data_type"),
        contracts.select(F.col("model").alias("table"), "column", F.coalesce("data_type", F.lit("")).alias("data_type")),
    )
    forward = drift.detect_drift(contracts, live)
    assert rows(forward.filter("category = 'missing'"), "column") == rows(swapped.filter("category = 'undocumented'"), "column")
    assert rows(forward.filter("category = 'undocumented'"), "column") == rows(swapped.filter("category = 'missing'"), "column")
