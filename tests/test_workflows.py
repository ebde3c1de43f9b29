import pytest
from pyspark.sql import functions as F

from mendline.operators import findings, fixes, workflows

DAG = """from airflow import DAG
default_args = {"retries": 0}
with DAG(dag_id="sales", schedule="0 6 * * *", catchup=True) as dag:
    pull = PythonOperator(task_id="pull", python_callable=f)
    push = MyOwnOperator (task_id='push')
    # pull >> nothing
    pull >> [push, check] >> done
"""
FLOW = """from prefect import flow, task

@task(retries=3)
def load(x):
    return x

@prefect.task
def clean(x):
    return x

@flow(name="a")
def main():
    f = load.submit(1)

@flow
def other():
    raise_on_failure = True

deploy(cron="0 1 * * *", interval=60)
"""


def source(spark, **content):
    return spark.createDataFrame(list(content.items()), "path string, content string")


def test_syntax(spark):
    files = source(spark, good=DAG, bad="def f(:\n  pass", nul="a = '\0'", deep="(" * 5000 + ")" * 5000)
    found = {r.path: r for r in workflows.syntax(files).collect()}
    assert found["good"].ok and found["good"].lineno is None
    assert not found["bad"].ok and found["bad"].lineno == 1 and "def f(" in found["bad"].text
    assert not found["nul"].ok and not found["deep"].ok
    assert [r.path for r in workflows.valid_files(files).collect()] == ["good"]
    assert {r.artifact for r in workflows.syntax_findings(files).collect()} == {"bad", "nul", "deep"}


def test_dag_inventory(spark, rows):
    assert rows(workflows.dag_inventory(source(spark, d=DAG)), "kind", "pos", "name", "detail") == [
        ("dag", 1, "sales", None),
        ("operator", 1, "pull", "PythonOperator"),
        ("operator", 2, "push", "MyOwnOperator"),
        ("task", 1, "pull", None),
        ("task", 2, "push", None),
    ]


def test_chains(spark, rows):
    chains = workflows.dag_chains(source(spark, d=DAG))
    assert rows(chains) == [("d", 7, "pull >> [push, check] >> done")]
    assert rows(workflows.chain_edges(chains), "parent", "child") == [
        ("check", "done"), ("pull", "check"), ("pull", "push"), ("push", "done"),
    ]


def test_dag_rules(spark, rows):
    assert rows(workflows.dag_rules(source(spark, d=DAG)), "rule_id", "evidence") == [
        ("catchup_not_off", "catchup not set to False"),
        ("catchup_on", "catchup=True"),
        ("no_retries", "retries=0"),
        ("schedule", "0 6 * * *"),
    ]
    # The strict rule sees keyword arguments only.
    assert ("no_retries",) not in rows(workflows.dag_rules(source(spark, d=DAG), strict=True), "rule_id")
    quiet = "DAG(dag_id='x', schedule=None, catchup = False, schedule_interval='1 * * * *')"
    assert workflows.dag_rules(source(spark, d=quiet)).count() == 0


def test_flows(spark, rows):
    assert rows(workflows.flow_inventory(source(spark, f=FLOW)), "kind", "name") == [
        ("flow", "main"), ("flow", "other"), ("retries", "3"), ("schedule", "0 1 * * *"), ("schedule", "60"), ("task", "clean"), ("task", "load"),
    ]
    assert rows(workflows.flow_rules(source(spark, f=FLOW)), "rule_id") == [
        ("nested_flow",), ("raise_on_failure",), ("submit_without_result",),
    ]
    assert workflows.flow_rules(source(spark, f="@flow\ndef a():\n  x.submit().result()\n")).count() == 0


def test_long_flow_file(spark, rows):
    text = "@flow\ndef a():\n" + "    x = 1\n" * 20_000 + "@flow\ndef b():\n    pass\n"
    assert rows(workflows.flow_rules(source(spark, f=text)), "rule_id") == [("nested_flow",)]


@pytest.mark.parametrize(
    "path, original, replacement, status, content",
    [
        ("a", "b", "X", "applied", "aXcb"),
        ("a", "abc", "", "applied", "b"),
        ("a", "zz", "X", "not_found", None),
        ("a", "b", "b", "identical", None),
        ("gone", "b", "X", "file_missing", None),
    ],
)
def test_fixes(spark, path, original, replacement, status, content):
    wanted = spark.createDataFrame([(path, original, replacement)], "path string, original string, replacement string")
    (done,) = fixes.apply_fixes(source(spark, a="abcb"), wanted).collect()
    changed = [r.content for r in fixes.fixed_files(source(spark, a="abcb"), wanted).collect()]
    assert done.status == status and changed == ([content] if content is not None else [])


def test_fixes_of_one_file_build_on_one_another(spark, rows):
    wanted = spark.createDataFrame(
        [("a", 2, "XX", "Y"), ("a", 1, "b", "XX"), ("a", 3, "b", "Z"), ("a", 4, "b", "Q"), ("x", 1, "b", "c")],
        "path string, position int, original string, replacement string",
    )
    files = source(spark, a="abcb", untouched="b")
    assert rows(fixes.apply_fixes(files, wanted), "path", "position", "status") == [
        ("a", 1, "applied"), ("a", 2, "applied"), ("a", 3, "applied"), ("a", 4, "not_found"), ("x", 1, "file_missing"),
    ]
    assert rows(fixes.fixed_files(files, wanted)) == [("a", "aYcZ", 3)]


def test_files_that_do_not_parse_have_their_syntax_finding_only(spark):
    broken = source(spark, d=DAG + "def f(:\n", f=FLOW + "def f(:\n")
    for empty in (workflows.dag_rules, workflows.flow_rules, workflows.dag_chains, workflows.dag_inventory, workflows.flow_inventory):
        assert empty(broken).count() == 0
    assert {r.rule_id for r in workflows.syntax_findings(broken).collect()} == {"syntax_error"}


def test_findings(spark, rows):
    part = workflows.dag_rules(source(spark, d=DAG))
    more = part.limit(1).select(
        F.lit("log").alias("family"), "artifact", F.lit("oom").alias("rule_id"), F.lit("CRITICAL").alias("severity"), F.lit(5).cast("bigint").alias("n"), "evidence"
    )
    both = findings.union_findings([part, more])
    assert rows(findings.by_artifact(both)) == [
        ("log", "d", 1, 5, "CRITICAL", "oom"),
        ("workflow", "d", 4, 4, "WARNING", "catchup_on"),
    ]
    assert ("log", "oom", "CRITICAL", 1, 5) in rows(findings.by_rule(both))


def test_findings_parse_a_file_once(spark):
    files = spark.createDataFrame([("a.py", DAG), ("b.py", "def broken(:"), ("c.py", FLOW), ("d.py", None)], "path string, content string")
    for both, rules in ((workflows.dag_findings, workflows.dag_rules), (workflows.flow_findings, workflows.flow_rules)):
        found = both(files)
        apart = rules(files).unionByName(workflows.syntax_findings(files))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, apart.collect()))
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
