import json
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mendline.functions import rules as R
from mendline.functions import scale
from mendline.operators import artifacts, drift, fixes
from mendline.sources import catalog, contracts, files, sinks, textfiles


def write(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_read_logs(spark, tmp_path):
    path = write(tmp_path, "run.log", b"ok \xff line\nERROR x\n")
    (row,) = files.read_logs(spark, path, "dbt").collect()
    assert row.framework == "dbt" and row.path.endswith("/run.log") and row.content == "ok � line\nERROR x\n"
    with pytest.raises(AnalysisException):
        files.read_logs(spark, str(tmp_path / "gone.log")).collect()


def test_truncation(spark, tmp_path):
    path = write(tmp_path, "big.log", "a" * 10 + "é" * 60_000)
    (log,) = files.read_logs(spark, path, truncate=True).collect()
    assert log.content == "[...truncated to last 50000 characters...]\n\n" + "é" * 50_000
    (source,) = files.read_sources(spark, path, truncate=True).collect()
    assert source.content == "a" * 10 + "é" * 29_990 + "\n\n[...truncated at 30000 characters...]"
    small = write(tmp_path, "small/s.log", "x")
    assert files.read_logs(spark, small, truncate=True).first().content == "x"


def test_read_lines_over_many_splits(spark, tmp_path):
    texts = {f"f{i}.log": [f"{i}-{n} " + "x" * (n % 17) for n in range(300 + i)] for i in range(3)}
    for name, lines in texts.items():
        write(tmp_path, name, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        rows = files.read_lines(spark, str(tmp_path), exact=True).collect()
        ordered = sorted(files.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(r.path.split("/")[-1], {})[r.line_no] = r.text
    assert {k: [v[i] for i in range(1, len(v) + 1)] for k, v in got.items()} == texts
    assert {k: [r.text for r in ordered if r.path.endswith(k)] for k in texts} == texts


def test_list_files(spark, tmp_path):
    write(tmp_path, "b/x.sql", "1")
    write(tmp_path, "a/y.sql", "22")
    write(tmp_path, "a/z.txt", "333")
    found = files.list_files(spark, str(tmp_path), "*.sql").collect()
    assert [(r.path.split("/")[-1], r.length) for r in found] == [("y.sql", 2), ("x.sql", 1)]
    assert files.list_files(spark, str(tmp_path)).count() == 3


def test_read_models(spark, tmp_path, rows):
    write(tmp_path, "p/models/m/fct.sql", "select 1")
    write(tmp_path, "p/other.sql", "select 2")
    write(tmp_path, "q/flat.sql", "select 3")
    assert rows(files.read_models(spark, str(tmp_path / "p")), "name", "sql") == [("fct", "select 1")]
    assert rows(files.read_models(spark, str(tmp_path / "q")), "name") == [("flat",)]
    with pytest.raises(AnalysisException):
        files.read_models(spark, str(tmp_path / "q"), fall_back=False)


def test_artifacts(spark, tmp_path, rows):
    write(tmp_path, "Run_Results.json", json.dumps({"results": [{"unique_id": "m.a", "status": "error", "message": "x" * 2000, "execution_time": 1.256}]}))
    write(tmp_path, "out.json", json.dumps({"results": [{"status": "success"}, {"status": "pass"}, {"status": "warn"}, {"status": None}, {"status": "skipped"}]}))
    write(tmp_path, "manifest.json", json.dumps({"nodes": {}, "sources": {}}))
    write(tmp_path, "other.json", json.dumps({"x": 1}))
    write(tmp_path, "bad.json", "{")
    found = files.read_artifacts(spark, str(tmp_path))
    assert rows(found.select(F.element_at(F.split("path", "/"), -1), "kind")) == [
        ("Run_Results.json", "run_results"),
        ("bad.json", "invalid"),
        ("manifest.json", "manifest"),
        ("other.json", "unrecognized"),
        ("out.json", "run_results"),
    ]
    results = artifacts.run_results(found.filter("kind = 'run_results'"))
    assert rows(artifacts.run_summary(results), "n_executed", "n_succeeded", "n_warned", "n_failed") == [(1, 0, 0, 1), (5, 2, 1, 2)]
    failed = {r.status: r for r in artifacts.failed_nodes(results).collect()}
    assert failed["error"].seconds == "1.26" and len(failed["error"].message) == 2000
    failed = {r.status: r for r in artifacts.failed_nodes(results, message_chars=R.MESSAGE_CHARS).collect()}
    assert len(failed["error"].message) == 1000
    assert failed["unknown"].node == "unknown" and failed["skipped"].seconds is None


YAML = """
version: 2
models:
  - name: fct_sales
    columns:
      - name: Sale_Id
        data_type: integer
        tests: [unique, not_null]
      - name: status
        tests:
          - accepted_values:
              values: [a, b]
      - name: note
      - description: no name
  - name: empty
    columns:
  - description: no name
"""


def test_read_contracts(spark, tmp_path, rows):
    write(tmp_path, "models/a/schema.yml", YAML)
    write(tmp_path, "models/b/schema_extra.yaml", "models:\n  - name: other\n    columns: [{name: x}]")
    write(tmp_path, "models/c/_schema.yml", "models:\n  - name: hidden\n    columns: [{name: h, tests: [unique]}]")
    write(tmp_path, "models/models.yml", "models:\n  - name: other\n    columns: [{name: y, data_type: TEXT}]")
    write(tmp_path, "models/schema_bad.yml", "models: [unclosed")
    write(tmp_path, "models/readme.yml", "models: [{name: ignored}]")
    found = rows(contracts.read_contracts(spark, str(tmp_path)))
    assert found == sorted(
        [
            ("empty", None, None, None),
            ("fct_sales", "Sale_Id", "integer", ["unique", "not_null"]),
            ("fct_sales", "note", None, []),
            ("fct_sales", "status", None, ["accepted_values"]),
            ("hidden", "h", None, ["unique"]),
            # Two files define the model: the last path wins, as a whole.
            ("other", "y", "TEXT", []),
        ],
        key=repr,
    )
    one = contracts.read_contracts(spark, str(tmp_path), str(tmp_path / "models/b/schema_extra.yaml"))
    assert rows(one, "model", "column") == [("other", "x")]


def test_odd_contract_files(spark, rows):
    texts = {
        "bad_date.yml": "models: [{name: a, at: 2024-13-45}]",
        "list.yml": "- models",
        "empty.yml": "",
        "null.yml": "models:",
        "tests.yml": "models: [{name: b, columns: [{name: x, tests: unique}, {name: y, tests: {a: 1}}, {name: z, tests: [null]}, text]}, text]",
    }
    df = spark.createDataFrame(list(texts.items()), "path string, content string")
    assert rows(contracts.parse_contracts(df), "model", "column", "tests") == [
        ("b", "x", ["unique"]), ("b", "y", ["a"]), ("b", "z", ["None"]),
    ]


def test_catalog(spark, rows):
    table = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "Id bigint, name string, score double")
    table.createOrReplaceTempView("scores")
    live = catalog.live_columns({"scores": table})
    assert rows(live, "table", "column", "data_type") == [
        ("scores", "id", "bigint"), ("scores", "name", "string"), ("scores", "score", "double precision"),
    ]
    assert rows(catalog.catalog_columns(spark, ["scores", "gone"]), "column") == [("id",), ("name",), ("score",)]
    assert ("", "scores", "TEMPORARY") in rows(catalog.list_tables(spark))
    assert rows(catalog.describe_table(table, "scores"), "column", "ordinal", "n_rows", "n_nulls") == [
        ("id", 1, 2, 0), ("name", 2, 2, 1), ("score", 3, 2, 1),
    ]
    spark.catalog.dropTempView("scores")
    given = StructType([StructField("a", IntegerType(), True, {"CURRENT_DEFAULT": "7"}), StructField("b", IntegerType(), True, {"CURRENT_DEFAULT": "1" * 40})])
    assert rows(catalog.describe_table(spark.createDataFrame([(1, 2)], given), "t"), "column", "default") == [("a", "7"), ("b", "1" * 30)]


def test_spark_timestamps_carry_a_zone(spark):
    df = spark.sql("SELECT timestamp '2024-01-01' AS a, timestamp_ntz '2024-01-01' AS b")
    family = catalog.live_columns({"t": df}).select(drift.type_family(F.col("data_type")).alias("f")).collect()
    assert [r.f for r in family] == ["tstz", "ts"]


def test_write_findings(spark, tmp_path):
    df = spark.createDataFrame([("log", "a", "r", "ERROR", 1, "e")], "family string, artifact string, rule_id string, severity string, n bigint, evidence string")
    sinks.write_findings(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("family = 'log'").count() == 1


def session_with(**settings):
    conf = {k.replace("_", "."): v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get))


def test_shared_dir_comes_from_the_session():
    assert scale.shared_dir(session_with(spark_checkpoint_dir="hdfs://shared/cuts/")) == "hdfs://shared/cuts"
    assert scale.shared_dir(session_with(spark_sql_warehouse_dir="hdfs://house")) == "hdfs://house/_checkpoints"


def test_cut(spark):
    kept, n = scale.cut_counted(spark.range(5).filter("id > 1"))
    assert n == 3 and sorted(r.id for r in kept.collect()) == [2, 3, 4]
    assert scale.cut_counted(spark.range(0))[1] == 0


@pytest.mark.parametrize("form", ["{}", "file://{}"])
def test_no_file_is_lost(spark, rows, tmp_path, form):
    """Names with a leading _ or ., blanks and signs in names, plain paths and URIs."""
    names = ["ok", "a b", "c+d%20", "_y", "_staging/x", ".h/z", "é/_w"]
    for n in names:
        place = tmp_path / "models" / f"{n}.sql"
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(f"select '{n}'\nfrom t\n")
    (tmp_path / "models" / "_SUCCESS").write_text("")
    for at, folder in (("models/schema.yml", "old"), ("models/z/_schema.yml", "new")):
        (tmp_path / at).parent.mkdir(exist_ok=True)
        (tmp_path / at).write_text(f"models:\n  - name: m\n    columns:\n      - name: {folder}\n")
    root = form.format(tmp_path)
    assert rows(files.read_models(spark, root), "name") == sorted((n.split("/")[-1],) for n in names)
    assert all(r.sql == f"select '{r.path.split('models/')[1].removesuffix('.sql')}'\nfrom t\n" for r in files.read_models(spark, root).collect())
    listed = files.list_files(spark, f"{root}/models", "*.sql").collect()
    assert [r.path for r in listed] == sorted(f"file://{tmp_path}/models/{n}.sql" for n in names) and all(r.length > 0 for r in listed)
    assert {r.path for r in files.read_models(spark, root).collect()} == {r.path for r in listed}
    lines = files.read_lines(spark, f"{root}/models").filter("path like '%.sql'").orderBy("path", "line_no").collect()
    assert [r.text for r in lines][1::2] == ["from t"] * len(names) and len({(r.path, r.line_no) for r in lines}) == 2 * len(names)
    assert rows(contracts.read_contracts(spark, root), "model", "column") == [("m", "new")]


@pytest.mark.parametrize("end", ["", "\n"])
def test_hidden_files_are_read_in_ranges(spark, tmp_path, end):
    texts = [f"{n} é " + "x" * (n % 23) for n in range(400)]
    write(tmp_path, "_long.log", "\n".join(texts) + end)
    write(tmp_path, "_bytes.log", b"a\xffb\n\nc")
    sizes = [(f"file://{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in ("_long.log", "_bytes.log")]
    for size in (1, 7, 100, 1 << 20):
        rows = textfiles.read_named(spark, sizes, lines=True, range_bytes=max(size, 300)).collect()
        long = sorted((r.split, r.read_order, r.text) for r in rows if r.path.endswith("_long.log"))
        assert [t for _, _, t in long] == texts
        assert [r.text for r in sorted(rows) if r.path.endswith("_bytes.log")] == ["a\ufffdb", "", "c"]
    parts = textfiles.read_named(spark, sizes, lines=True, range_bytes=500)
    assert parts.rdd.getNumPartitions() > 8
    got = files.read_lines(spark, str(tmp_path)).filter("path like '%long%'").orderBy("line_no").collect()
    assert [r.text for r in got] == texts
    assert {r.content for r in files.read_whole(spark, str(tmp_path)).collect()} == {"\n".join(texts) + end, "a\ufffdb\n\nc"}


def test_write_back(spark, tmp_path, rows):
    one, two = write(tmp_path, "a b/one+%20.py", "x = 1\ny = 1\n"), write(tmp_path, "_two.py", "é")
    found = files.read_sources(spark, str(tmp_path)).cache()
    todo = spark.createDataFrame(
        [(f"file://{one}", "1", "2"), (f"file://{two}", "é", "ü\n"), (f"file://{one}", "nowhere", "z"), ("file:///gone", "a", "b")], "path string, original string, replacement string"
    )
    statuses = rows(fixes.write_back(found, todo), "status")
    assert statuses == [("applied",), ("applied",), ("file_missing",), ("not_found",)]
    assert open(one).read() == "x = 2\ny = 1\n" and open(two).read() == "ü\n"
    before = (tmp_path / "_two.py").stat().st_mtime_ns
    textfiles.write_named(files.read_sources(spark, str(tmp_path)))
    assert (tmp_path / "_two.py").stat().st_mtime_ns == before, "equal texts are not written again"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["_two.py", "one+%20.py"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = write(tmp_path, "keep.txt", "old")
    rows = [(f"file://{tmp_path}/n{i}.txt", "new") for i in range(20)] + [(f"file://{path}", "new")]
    df = spark.createDataFrame(rows, "path string, content string").repartition(4)
    stop = F.when(F.col("path").endswith("n7.txt"), F.raise_error(F.lit("lost"))).otherwise(F.col("content"))
    with pytest.raises(Exception, match="lost"):
        textfiles.write_named(df.withColumn("content", stop))
    assert open(path).read() == "old" and not list(tmp_path.glob("n*.txt"))
    with pytest.raises(Exception, match="several rows"):
        textfiles.write_named(df.unionByName(df))
    assert [p.name for p in tmp_path.iterdir()] == ["keep.txt"]
    textfiles.write_named(df)
    assert open(path).read() == "new" and len(list(tmp_path.iterdir())) == 21


def test_contract_files(spark, tmp_path, rows):
    columns = spark.createDataFrame([("m", "id", 1), ("m", "kind", 2), ("n", "x", 1)], "model string, column string, ordinal bigint")
    tests = spark.createDataFrame(
        [("m", "id", "unique", None, None, None), ("m", "id", "not_null", None, None, None), ("m", "kind", "accepted_values", None, None, ["a", "b"])],
        "model string, column string, test string, ref_model string, ref_field string, accepted array<string>",
    )
    sinks.write_texts(sinks.contract_files(columns, tests, f"file://{tmp_path}/models"))
    read = contracts.read_contracts(spark, str(tmp_path), f"{tmp_path}/models/m.yml")
    assert rows(read, "model", "column", "tests") == [("m", "id", ["unique", "not_null"]), ("m", "kind", ["accepted_values"])]
    assert (tmp_path / "models/n.yml").exists()


def test_columns_of_a_database_in_either_case(spark, rows):
    schema = "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int, column_default string"
    found = spark.createDataFrame(
        [
            ("PUBLIC", "FCT", "ID", "NUMBER", "NO", 1, None),
            ("public", "fct", "Name", "text", "YES", 2, "'x'"),
            ("sales", "fct", "id", "integer", "NO", 1, None),
            ("sales", "other", "id", "integer", "NO", 1, None),
        ],
        schema,
    )
    assert rows(catalog.named_columns(found), "table", "column", "default") == [("fct", "id", None), ("fct", "name", "'x'")]
    assert rows(catalog.named_columns(found, tables=["Sales.FCT", "fct"]), "table", "column") == [("fct", "id"), ("fct", "name"), ("sales.fct", "id")]
