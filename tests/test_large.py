"""Plans of operators on inputs whose size Spark underrates: what grows with them stays out of the driver and of a single task."""

import json

import pytest
from pyspark.sql import functions as F

from mendline.functions.scale import cut, cut_counted, spread
from mendline.operators import closure, datatests, lineage, modelsql
from mendline.plans import corpora
from mendline.sources import files, sinks, textfiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def facts(spark):
    text = F.concat(F.lit("SELECT id, order_id, 'x' AS status FROM {{ ref('m_1') }} WHERE status IN ('a', 'b')"))
    return modelsql.model_facts(spark.range(20).select(F.concat(F.lit("m_"), "id").alias("name"), text.alias("sql")))


def inferred(facts):
    columns = modelsql.columns_of(facts)
    return columns, datatests.infer_tests(
        columns.drop("ordinal"), facts.select(F.col("model").alias("name")), modelsql.refs_of(facts), modelsql.hints_of(facts)
    )


def test_inference_broadcasts_no_models(facts):  # F2
    found = inferred(facts)[1]
    assert "Broadcast" not in plan(found) and found.filter("test = 'accepted_values'").count() == 20


def test_contract_text_broadcasts_no_columns(facts):  # F1
    text = sinks.contract_text(*inferred(facts))
    assert "Broadcast" not in plan(text) and text.count() == 80


def test_small_files_of_much_work_are_dealt_out(spark, tmp_path):  # F9
    spark.range(25_000).coalesce(1).selectExpr("id AS p_partkey", "'b' AS p_brand", "1 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    models = corpora.MODELS.load(spark, str(tmp_path))
    assert models.rdd.getNumPartitions() == 3 and models.select("name").distinct().count() == 25_000
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1


def test_a_traversal_broadcasts_short_frontiers_only(spark, rows, monkeypatch):  # F7
    edges = spark.range(2, 400).selectExpr("concat('m_', id) AS child", "concat('m_', floor(id / 2)) AS parent")
    root = spark.createDataFrame([("m_1",)], "root string")
    few = rows(lineage.reach(edges, root, upstream=False))
    monkeypatch.setattr(lineage, "MOST_BROADCAST", 0)
    seen = []
    monkeypatch.setattr(lineage, "cut_counted", lambda df: (seen.append(plan(df)), cut_counted(df))[1])
    assert rows(lineage.reach(edges, root, upstream=False)) == few and len(few) == 398
    assert not any("Broadcast" in p for p in seen)


def test_a_large_component_is_not_sorted_in_one_task(spark, monkeypatch):  # F4, F5, F6
    edges = spark.range(300).selectExpr("concat('o_', id) AS child", "'hub' AS parent")
    seen = []
    monkeypatch.setattr(closure, "cut", lambda df: (seen.append(plan(df)), cut(df))[1])
    sized, _ = closure.pieces(edges, 100)
    assert {(r.m, r.n) for r in sized.groupBy("m").agg(F.count("*").alias("n")).collect()} == {(300, 300)}
    heavy = seen[-1]
    assert "BroadcastHashJoin [part" in heavy  # edges of the large one are not shuffled by it
    assert not any("SortMergeJoin [child" in p or "SortMergeJoin [parent" in p for p in seen)


def test_many_small_hidden_files_take_several_tasks(spark, tmp_path, monkeypatch):  # F10
    for i in range(7):
        (tmp_path / f"_m_{i}.sql").write_text(f"select {i}")
    reader = textfiles._Reader({"files": json.dumps([(str(p), 9) for p in tmp_path.iterdir()])})
    monkeypatch.setattr(textfiles, "MOST_FILES", 3)
    parts = reader.partitions()
    assert [len(p.parts) for p in parts] == [3, 3, 1]
    assert [b.num_rows for p in parts for b in reader.read(p)] == [3, 3, 1]
    assert files.read_models(spark, str(tmp_path)).filter("sql = concat('select ', substr(name, 4))").count() == 7
