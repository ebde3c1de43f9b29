import random

import yaml
from pyspark.sql import functions as F

from mendline.functions.scale import cut
from mendline.operators import datatests, keysets, modelsql
from mendline.sources import sinks

MODEL = """-- header: it's a header
{{ config(materialized='table') }}
WITH sales AS (
    SELECT * FROM {{ ref('stg_sales') }}
),
stores AS (SELECT * FROM {{ ref('stg_stores') }}),
final AS (
    SELECT
        s.sale_id,
        s.store_id,
        st.contact_email,
        s.status,
        -- the sum, with a comma
        SUM(ROUND(COALESCE(s.amount, 0), 2)) AS gross_amount,
        COUNT(*)                             AS line_count,
        'a, b (c'                            AS note,
        s.sold_at,
        CASE WHEN s.status = 'open' THEN 1 WHEN s.status = 'done' THEN 2 END AS status_no,
        st.region
    FROM sales s JOIN stores st ON s.store_id = st.store_id
    WHERE s.channel IN ('web', 'shop') AND s.kind NOT IN ('test')
)
SELECT * FROM final
"""


def models(spark, **sql):
    return spark.createDataFrame(list(sql.items()), "name string, sql string")


def columns(spark, sql):
    found = modelsql.model_columns(models(spark, m=sql)).orderBy("ordinal").collect()
    return [r.column for r in found]


def test_columns_through_last_cte(spark):
    assert columns(spark, MODEL) == [
        "sale_id", "store_id", "contact_email", "status", "gross_amount", "line_count", "note", "sold_at", "status_no", "region",
    ]


def test_columns_of_plain_selects(spark):
    assert columns(spark, "select a, t.b, c as d, e f, count(*) n, 1, x + 1 from t") == ["a", "b", "d", "f", "n"]
    assert columns(spark, "select a from t; select distinct b from u;") == ["b"]
    assert columns(spark, "select a, (select max(x) from (select 1 as x) q) as m from t union all select c, d from u") == ["a", "m"]
    assert columns(spark, "select " + "f(" * 40 + "x" + ")" * 40 + " as deep, y from t") == ["deep", "y"]
    assert columns(spark, "select * from t") == [] and columns(spark, "") == []
    assert columns(spark, "with a as (select x, y from t) select z, * from a") == ["z", "x", "y"]


def test_columns_of_very_long_models(spark):
    many = ", ".join(f"f({i}) as c{i}" for i in range(3000))
    assert columns(spark, f"with a as (select {many} from t) select * from a") == [f"c{i}" for i in range(3000)]


def test_strip_templates(spark):
    sql = "{% set x = 1 %}select {{ x }} from {{ ref('a') }}, {{ source('raw', 'b') }} {{\n config(m={'a': 1}) }}"
    stripped = spark.range(1).select(modelsql.strip_templates(F.lit(sql)).alias("s")).first().s
    assert stripped == "select  from a, raw_b "


def test_hints(spark, rows):
    found = {r.column: r.accepted for r in modelsql.accepted_value_hints(models(spark, m=MODEL)).collect()}
    # A qualified name gives its last part for IN lists, and nothing for comparisons.
    assert found == {"channel": ["web", "shop"]}
    sql = "CASE WHEN Status = 'b' THEN 1 WHEN status='a' END, x IN ('q', 'p', 'q'), status in ('c', 'a')"
    found = {r.column: r.accepted for r in modelsql.accepted_value_hints(models(spark, m=sql)).collect()}
    assert found == {"status": ["b", "a", "c"], "x": ["q", "p"]}


def inferred(spark, *names, shared=(), model="sale", hints=None):
    cols = spark.createDataFrame([(model, c) for c in names], "model string, column string")
    known = spark.createDataFrame([(s,) for s in shared], "name string")
    out = {n: [] for n in names}
    for r in datatests.infer_tests(cols, known, hints=hints).collect():
        out[r.column].append(r.test)
    return {k: sorted(v) for k, v in out.items()}


def test_naming_rules(spark):
    assert inferred(
        spark, "id", "SALE_ID", "surrogate_key", "pk_x", "store_id", "status", "order_status", "sold_at", "due_date", "unit_price",
        "email", "work_email", "total_rows", "n_items", "item_count", "region", "statusx", "price_type",
    ) == {
        "id": ["not_null", "unique"],
        "SALE_ID": ["not_null", "unique"],
        "surrogate_key": ["not_null", "unique"],
        "pk_x": ["not_null", "unique"],
        "store_id": ["not_null"],
        "status": ["not_null"],
        "order_status": ["not_null"],
        "sold_at": ["not_null"],
        "due_date": ["not_null"],
        "unit_price": ["not_null"],
        "email": ["not_null", "unique"],
        "work_email": ["not_null", "unique"],
        "total_rows": ["not_null"],
        "n_items": ["not_null"],
        "item_count": ["not_null"],
        "region": [],
        "statusx": [],
        "price_type": ["not_null"],
    }


def test_reference_targets(spark, rows):
    cols = spark.createDataFrame([("m", c) for c in ("store_id", "customer_id", "boss_id", "other_id")], "model string, column string")
    shared = spark.createDataFrame([("stores",), ("raw_store",), ("dim_customers",), ("customers",), ("bo",)], "name string")
    own = spark.createDataFrame([("m", "store"), ("x", "other")], "model string, name string")
    assert rows(datatests.infer_references(cols, shared)) == [
        ("m", "boss_id", "bo", "boss_id"),
        ("m", "customer_id", "customers", "customer_id"),
        ("m", "other_id", None, None),
        ("m", "store_id", "stores", "store_id"),
    ]
    # A better-placed model of the SQL itself wins, and the field is the key of that model.
    assert ("m", "store_id", "store", "id") in rows(datatests.infer_references(cols, shared, own))


def test_generated_contract_reads_back(spark, tmp_path):
    facts = cut(modelsql.model_facts(models(spark, fct_sales=MODEL, stg='select id, tier from {{ source("raw", "t") }} where tier in (\'a"b\', \'c\')')))
    cols = modelsql.columns_of(facts)
    tests = datatests.infer_tests(cols, facts.select(F.col("model").alias("name")), modelsql.refs_of(facts), modelsql.hints_of(facts))
    target = str(tmp_path / "contracts")
    sinks.write_contracts(cols, tests, target)

    def document(model):
        parts = sorted((tmp_path / "contracts" / f"model={model}").glob("part-*"))
        return yaml.safe_load("".join(p.read_text() for p in parts))

    fct = document("fct_sales")
    assert fct["version"] == 2 and [m["name"] for m in fct["models"]] == ["fct_sales"]
    by_name = {c["name"]: c["tests"] for c in fct["models"][0]["columns"]}
    assert list(by_name)[:3] == ["sale_id", "store_id", "contact_email"]
    assert by_name["store_id"] == ["not_null", {"relationships": {"to": "ref('stg_stores')", "field": "store_id"}}]
    assert by_name["contact_email"] == ["unique", "not_null"] and by_name["region"] == []
    tier = document("stg")["models"][0]["columns"][1]
    assert tier["tests"] == ["not_null", {"accepted_values": {"values": ['a"b', "c"]}}]


def test_evaluation(spark, rows):
    sales = spark.createDataFrame(
        [(1, 10, "a"), (1, 11, None), (2, None, "b"), (None, 12, "zz"), (None, 12, "zz")], "id bigint, store_id bigint, status string"
    )
    stores = spark.createDataFrame([(10,), (11,)], "id bigint")
    assert rows(datatests.check_not_null(sales, "sales", sales.columns), "column", "n_rows", "n_failed") == [
        ("id", 5, 2), ("status", 5, 1), ("store_id", 5, 1),
    ]
    assert rows(datatests.duplicate_keys(sales, ["id"])) == [(1, 2)]
    assert rows(datatests.check_unique(sales, "sales", ["id"]), "n_keys", "n_failed") == [(1, 2)]
    assert rows(datatests.unaccepted_values(sales, "status", ["a", "b"])) == [("zz", 2)]
    values = spark.createDataFrame([("a",), ("zz",)], "v string")
    assert rows(datatests.unaccepted_values(sales, "status", values)) == [("b", 1)]
    assert rows(datatests.orphan_keys(sales, "store_id", stores, "id")) == [(12, 2)]
    assert rows(datatests.observed_values(sales, ["status", "id"], 2)) == [("id", ["1", "2"]), ("status", None)]
    results = datatests.run_tests(
        {"sales": sales, "store": stores},
        [
            {"model": "sales", "column": "id", "test": "unique"},
            {"model": "sales", "column": "id", "test": "not_null"},
            {"model": "sales", "column": "store_id", "test": "relationships", "ref_model": "store", "ref_field": "id"},
            {"model": "sales", "column": "status", "test": "accepted_values", "accepted": ["a", "b", "zz"]},
        ],
    )
    assert rows(results, "test", "n_failed") == [("accepted_values", 0), ("not_null", 2), ("relationships", 2), ("unique", 2)]
    assert rows(datatests.check_findings(results), "rule_id") == [("not_null",), ("relationships",), ("unique",)]


def test_run_inferred(spark, rows):
    tables = {
        "sale": spark.createDataFrame([(1, 1), (1, 5)], "sale_id int, store_id int"),
        "store": spark.createDataFrame([(1,)], "id int"),
    }
    found = rows(datatests.run_inferred(tables), "model", "column", "test", "n_failed")
    assert found == [
        ("sale", "sale_id", "not_null", 0),
        ("sale", "sale_id", "unique", 2),
        ("sale", "store_id", "not_null", 0),
        ("sale", "store_id", "relationships", 1),
        ("store", "id", "not_null", 0),
        ("store", "id", "unique", 0),
    ]


def test_key_sets_of_integers(spark, rows):
    r = random.Random(4)
    far = [-(1 << 63), (1 << 63) - 1, -1, 0, 63, 64, -64, -65, None]
    child = [(r.choice([r.randrange(-300, 300), r.choice(far)]),) for _ in range(400)]
    parent = [(r.choice([r.randrange(-300, 300), r.choice(far)]),) for _ in range(300)]
    c, p = spark.createDataFrame(child, "key bigint"), spark.createDataFrame(parent, "word bigint")
    assert rows(keysets.duplicate_integers(c, "key")) == rows(datatests.duplicate_keys(c, ["key"]))
    assert rows(keysets.orphan_integers(c, "key", p, "word")) == rows(datatests.orphan_keys(c, "key", p, "word"))
    assert keysets.duplicate_integers(spark.range(1000).toDF("n"), "n").collect() == []
    assert keysets.orphan_integers(c, "key", p.filter("false"), "word").agg({"n_rows": "sum"}).first()[0] == sum(k is not None for k, in child)
