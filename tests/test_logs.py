import random
import re

import pytest

from mendline.functions import rules as R
from mendline.operators import logs

DBT = """08:00:01  Running with dbt
08:00:04  3 of 9 ERROR creating sql view model marts.fct_sales
08:00:05  WARN  freshness of raw.sales
08:00:06  Database Error in model fct_sales (models/fct_sales.sql)
  column "rebate" does not exist
08:00:07  node model.shop.fct_sales had an error
"""
AIRFLOW = """[2024-03-01 09:00:00] {taskinstance.py:10} INFO - start
[2024-03-01 09:00:01] {taskinstance.py:11} ERROR - Task load_sales failed with code 1
Traceback (most recent call last):
  File "/dags/sales.py", line 8, in load

    rows = frame["amount"]
KeyError: 'amount'
airflow.exceptions.AirflowException: load aborted
DagBagError: two dags named sales
Pool default_pool is full
"""
PREFECT = """12:00:00 | ERROR   | Flow run 'red-fox' crashed early
12:00:01 | Task run 'load-0' finished: failed hard
prefect.exceptions.CrashException: lost
"""
JVM = """24/05/01 10:00:00 INFO Context: up
24/05/01 10:00:01 WARN TaskSetManager: Lost task 1.0 in stage 2.0: java.lang.OutOfMemoryError (Java heap space)
java.lang.IllegalStateException: first
\tat a.b.C.d(C.java:1)
\tat a.b.C.e (C.scala:2)
Caused by: org.apache.spark.SparkException: inner
\tat a.b.D.f(D.java:3)
\t... 4 more
Caused by: java.io.IOException: disk
24/05/01 10:00:03 ERROR Scheduler: Job 4 was failed
Stage 7 failed 4 times
ExecutorLostFailure (executor 2 exited) executor 2 lost
task is 9x slower than the rest
"""
FILES = "path string, framework string, content string"


def extracted(spark, framework, content):
    df = logs.extract_errors(spark.createDataFrame([("f", framework, content)], FILES))
    return [(r.rule_id, r.snippet) for r in df.orderBy("rule_no", "pos").collect()]


def test_dbt_rules(spark):
    found = extracted(spark, "DBT", DBT)
    assert ("level_line", "ERROR creating sql view model marts.fct_sales") in found
    assert ("level_line", "WARN  freshness of raw.sales") in found
    # The error runs to the end of the file.
    assert ("database_error", DBT[DBT.index("Database Error") :].strip()) in found
    assert ("node_error", "node model.shop.fct_sales had an error") in found


def test_airflow_rules(spark):
    found = extracted(spark, "airflow", AIRFLOW)
    trace = AIRFLOW[AIRFLOW.index("Traceback") : AIRFLOW.index("\nKeyError")]
    assert ("traceback", trace) in found
    assert [r for r, _ in found] == ["traceback", "level_line", "task_failed", "import_error", "airflow_exception", "pool_full"]


def test_prefect_rules(spark):
    assert [r for r, _ in extracted(spark, "Prefect", PREFECT)] == [
        "level_line",
        "flow_crashed",
        "task_failed",
        "crash_exception",
    ]


def test_spark_rules(spark):
    found = extracted(spark, "spark", JVM)
    assert {r for r, _ in found} == {
        "jvm_exception",
        "stack_frame",
        "caused_by",
        "level_line",
        "engine_exception",
        "task_set_warning",
        "stage_failed",
        "out_of_memory",
    }
    # The exception stops before the first frame.
    assert ("jvm_exception", "java.lang.IllegalStateException: first") in found


def test_unknown_framework_is_generic(spark):
    assert extracted(spark, "cobol", "FATAL  no disk\nBadException: x") == [
        ("level_line", "FATAL  no disk"),
        ("exception", "Exception: x"),
    ]


# Two rules say "up to, not including"; this is that wording with look-ahead.
LOOK_AHEAD = {
    "traceback": r"(?s)(Traceback \(most recent call last\).*?)(?=\n\S|\Z)",
    "jvm_exception": r"(?s)((?:java\.lang\.|org\.apache\.|py4j\.)\S+Exception.*?)(?=\n\s*at |\Z)",
}


def test_rules_against_python(spark):
    """The rules, read as Python patterns, give the same snippets on random text."""
    rng = random.Random(5)
    words = ["ERROR", "WARN ", "Traceback (most recent call last):", "\n", "\n  ", "\n\n", "x", "java.lang.AException", " at ", "Caused by: ",
             "Task t failed", "Stage 3 failed", "JOB 1 FAILED", "Runtime Error", "pool p is full", "Exception:", "CRITICAL - ", "outofmemoryerror", "é "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(120)]
    cases = [(f"{fw}/{i}", fw, t) for fw in R.EXTRACTION_RULES for i, t in enumerate(texts)]
    got = {}
    for r in logs.extract_errors(spark.createDataFrame(cases, FILES)).collect():
        got.setdefault((r.path, r.rule_no), {})[r.pos] = r.snippet
    for path, framework, text in cases:
        for no, rule in enumerate(R.EXTRACTION_RULES[framework], 1):
            pattern = LOOK_AHEAD.get(rule.rule_id, rule.pattern)
            want = [m.group(rule.group).strip() for m in re.finditer(pattern, text)]
            assert [s for _, s in sorted(got.get((path, no), {}).items())] == want, (path, rule.rule_id, text)


def test_dedup_keeps_first_of_equal_snippets_and_is_idempotent(spark, rows):
    long = "ERROR " + "y" * 300
    content = f"{long}1\n{long}2\nERROR short\nERROR short\n"
    snippets = logs.extract_errors(spark.createDataFrame([("f", "generic", content)], FILES))
    once = logs.dedup_snippets(snippets)
    assert rows(once, "snippet", "n_repeats") == [("ERROR short", 2), (long + "1", 1), (long + "2", 1)]
    assert rows(once, "snippet_key") == [("ERROR short",), (long[:200],), (long[:200],)]
    twice = logs.dedup_snippets(once.drop("n_repeats", "snippet_key"))
    assert rows(twice, "snippet", "pos") == rows(once, "snippet", "pos")


def test_snippet_cap(spark):
    files = spark.createDataFrame([("f", "generic", "ERROR " + "z" * 5000)], FILES)
    assert [len(r.snippet) for r in logs.extract_errors(files).collect()] == [5006]
    assert [len(r.snippet) for r in logs.extract_errors(files, snippet_chars=R.SNIPPET_CHARS).collect()] == [2000]


def test_very_long_texts_do_not_exhaust_the_stack(spark):
    trace = "Traceback (most recent call last):\n" + "  File x\n" * 30_000 + "KeyError: 1"
    for framework in ("airflow", "dbt", "spark", "prefect", "generic"):
        found = extracted(spark, framework, trace + "\njava.lang.AException " + "ERROR - z\n" * 5000)
        assert len(found) >= 5000


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_snippets_of_lines_equal_those_of_files(spark, block):
    """Random lines; blanks within a rule stay within a line here."""
    rng = random.Random(11)
    kinds = [
        "ERROR - x ERROR y", "Traceback (most recent call last): a", "  Traceback (most recent call last): b", "  File z", "", "\tindented", "plain",
        "java.lang.AException: m", "  org.apache.BException n", "\tat a.b (C.java:1)", "at x java.lang.CException: o", "Caused by: p", "   ",
        "Database Error in q", "Compilation Error r Database Error", "WARN  TaskSetManager: s", "Stage 3 failed t", "AirflowException: u",
    ]
    cases = []
    for framework in R.EXTRACTION_RULES:
        for i in range(25):
            cases.append((f"{framework}/{i}", framework, "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 20)))))
    files = spark.createDataFrame(cases, FILES)
    lines = logs.split_lines(files, "framework")
    for chars in (None, 30):
        want = sorted((r.path, r.rule_no, r.rule_id, r.snippet) for r in logs.extract_errors(files, snippet_chars=chars).collect())
        got = logs.extract_errors_from_lines(lines, block_lines=block, snippet_chars=chars)
        # White space at the cap may be cut before the end of a match is known.
        assert sorted((r.path, r.rule_no, r.rule_id, r.snippet.strip()) for r in got.collect()) == sorted((p, n, i, t.strip()) for p, n, i, t in want)
    clean = sorted(r.path for r in logs.files_without_errors(files).collect())
    assert sorted(r.path for r in logs.paths_without_errors(lines).collect()) == clean


def test_files_without_errors(spark, rows):
    df = spark.createDataFrame([("a", "dbt", "all good"), ("b", "dbt", DBT), ("c", "x", "fine"), ("d", "airflow", "WARN x")], FILES)
    assert rows(logs.files_without_errors(df), "path") == [("a",), ("c",), ("d",)]


# --- chains -----------------------------------------------------------------------------------

CHAIN = re.compile(
    r"(?:java\.|org\.apache\.|scala\.|com\.|py4j\.)\S+(?:Exception|Error)[^\n]*(?:\n\s+at [^\n]+)*(?:\nCaused by:[^\n]*(?:\n\s+at [^\n]+)*)*"
)


def expected_chains(text):
    return sorted({m.strip() for m in CHAIN.findall(text)})


def random_logs(n, seed):
    rng = random.Random(seed)
    kinds = [
        "INFO nothing", "java.lang.AException: 1", "x org.apache.BError 2", "\tat a.b(C.java:1)", "  at com.XException.f(X.java:2)",
        "at bare.frame", "Caused by: java.io.CException", "Caused by: plain", "", "   ", "\tat ", "\t... 3 more",
    ]
    return [("\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 25)))) for _ in range(n)]


def test_chains_of_files(spark):
    texts = random_logs(150, 1)
    files = spark.createDataFrame([(str(i), "spark", t) for i, t in enumerate(texts)], FILES)
    got = {}
    for r in logs.exception_chains(files).collect():
        got.setdefault(r.path, []).append(r.chain)
    for i, t in enumerate(texts):
        assert sorted(got.get(str(i), [])) == expected_chains(t), t


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_chains_of_lines_equal_those_of_files(spark, block):
    texts = random_logs(80, 2)
    files = spark.createDataFrame([(str(i), "spark", t) for i, t in enumerate(texts)], FILES)
    lines = logs.split_lines(files)
    got = {}
    for r in logs.exception_chains_from_lines(lines, block_lines=block).collect():
        got.setdefault(r.path, []).append((r.chain, r.n_repeats))
    whole = {}
    for r in logs.exception_chains(files).collect():
        whole.setdefault(r.path, []).append((r.chain, r.n_repeats))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in whole.items()}


def test_chains_of_one_hot_file(spark):
    """One path holds most lines; blocks cut it, and results equal a reading of the whole text."""
    text = "\n".join(random_logs(1500, 9))
    others = random_logs(30, 10)
    files = spark.createDataFrame([("hot", "spark", text)] + [(str(i), "spark", t) for i, t in enumerate(others)], FILES)
    got = {}
    for r in logs.exception_chains_from_lines(logs.split_lines(files), block_lines=97).collect():
        got.setdefault(r.path, []).append(r.chain)
    want = {p: expected_chains(t) for p, t in [("hot", text)] + [(str(i), t) for i, t in enumerate(others)]}
    assert {p: sorted(c) for p, c in got.items()} == {p: c for p, c in want.items() if c}


def test_very_long_trace(spark):
    text = "java.lang.StackOverflowError: deep\n" + "\n".join(f"\tat a.B.c(B.java:{i})" for i in range(20_000)) + "\nINFO end"
    files = spark.createDataFrame([("f", "spark", text)], FILES)
    chain = text.removesuffix("\nINFO end")
    (whole,) = logs.exception_chains(files).collect()
    (by_line,) = logs.exception_chains_from_lines(logs.split_lines(files), block_lines=700).collect()
    assert whole.chain == by_line.chain == chain and by_line.chain_key == text[:150]
    (whole,) = logs.exception_chains(files, chain_chars=R.CHAIN_CHARS).collect()
    (by_line,) = logs.exception_chains_from_lines(logs.split_lines(files), block_lines=700, chain_chars=R.CHAIN_CHARS).collect()
    assert whole.chain == text[:2000] and by_line.chain == text[:2000].strip()


def test_first_per_path(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "path string, pos bigint")
    assert rows(logs.first_per_path(df, "pos", 2), "path", "pos", "rank", "n_total") == [("a", 0, 1, 9), ("a", 1, 2, 9), ("b", 1, 1, 1)]


# --- issues -----------------------------------------------------------------------------------


def test_issues(spark):
    files = spark.createDataFrame([("f", "spark", JVM)], FILES)
    found = {r.rule_id: r for r in logs.issue_findings(files).collect()}
    assert {k: (r.severity, r.n) for k, r in found.items()} == {
        "out_of_memory": ("CRITICAL", 2),
        "stage_failure": ("ERROR", 2),
        "executor_loss": ("ERROR", 2),
        "data_skew": ("WARN", 1),
    }
    assert found["stage_failure"].evidence == "Job 4 was failed\nStage 7 failed"
    strict = {r.rule_id: r.evidence for r in logs.issue_findings(files, strict=True).collect()}
    assert strict["stage_failure"] == "Job 4 was failed"


def test_issue_rules_ignore_case_outside_ascii(spark):
    """The fragments that are looked for first must not lose what the pattern would find."""
    text = "task is 3x ſlower; ſtraggler; K; ſtage 3 was faıled; OUTOFMEMORYERROR"
    files = spark.createDataFrame([("f", "spark", text)], FILES)
    found = {r.rule_id: r.n for r in logs.issue_findings(files).collect()}
    for _, rule in R.JVM_ISSUES:
        assert found.get(rule.rule_id, 0) == len(re.findall(rule.pattern, text)), rule.rule_id


def test_issues_of_the_recent_end(spark):
    files = spark.createDataFrame([("f", "spark", "OutOfMemoryError java.lang.AError" + "x" * 100_000)], FILES)
    recent = {"tail_chars": R.JVM_TAIL_CHARS}
    assert logs.issue_findings(files).count() == 1 and logs.issue_findings(files, **recent).count() == 0
    assert logs.clean_files(files).count() == 0 and logs.clean_files(files, **recent).count() == 1
    assert logs.exception_chains(files).count() == 1 and logs.exception_chains(files, **recent).count() == 0


def test_line_hits_and_rollup(spark, rows):
    lines = logs.split_lines(spark.createDataFrame([("f", "spark", JVM), ("g", "spark", JVM)], FILES))
    hits = logs.line_hits(lines)
    assert ("f", "out_of_memory", 1, 2, 2) in rows(logs.rollup_by_rule(hits), "path", "rule_id", "n_hits", "first_line", "last_line")
    top = logs.top_signatures(hits, 100).filter("rule_id = 'warn_line'").collect()
    assert all(r.n_paths == 2 for r in top) and len(top) == 2


def test_warn_lines(spark, rows):
    text = "\n".join(
        ["WARN Store: low", "WARN Store: low", "24/05/01 10:00:01 ERROR Net: gone", "INFO a: b", "ERROR no colon"]
        + [f"FATAL X: {i}" for i in range(30)]
    )
    lines = logs.split_lines(spark.createDataFrame([("f", "spark", text)], FILES))
    shown = logs.warn_lines(lines, first=R.WARNS_SHOWN)
    assert shown.count() == 20
    first = rows(shown.filter("rank <= 2"), "line", "n_repeats", "n_total")
    assert first == [("ERROR Net: gone", 1, 32), ("WARN Store: low", 2, 32)]
    assert rows(logs.warn_lines(lines, strict=True, first=2).filter("rank = 2"), "line") == [("FATAL X: 0",)]
    assert logs.warn_lines(lines).count() == 32


def test_own_rules(spark):
    own = {"generic": [R.Rule("quota", r"quota \d+")], "db": [R.Rule("lock", r"(?i)lock wait", needs=(("wait",),))]}
    files = spark.createDataFrame([("a", "x", "quota 5, quota 6"), ("b", "db", "LOCK WAIT")], FILES)
    assert sorted((r.path, r.snippet) for r in logs.extract_errors(files, own).collect()) == [
        ("a", "quota 5"),
        ("a", "quota 6"),
        ("b", "LOCK WAIT"),
    ]


@pytest.mark.parametrize("tracked", [64, 256, 4096])
def test_heavy_signatures(spark, rows, tracked):
    """Frequent pairs among very many rare ones; a small summary takes more candidates or counts everything."""
    r = random.Random(6)
    names = [f"e{i}" for i in range(12) for _ in range(400 // (i + 1))] + [f"rare{i}" for i in range(3000)]
    r.shuffle(names)
    df = spark.createDataFrame([(f"p{i % 7}", f"r{len(n) % 2}", n) for i, n in enumerate(names)], "path string, rule_id string, evidence string").repartition(5)
    for k in (3, 12):
        assert rows(logs.heavy_signatures(df, k, tracked)) == rows(logs.top_signatures(df, k))
    assert logs.heavy_signatures(df.filter("false"), 3).collect() == []
    few = df.filter("evidence in ('e1', 'e2')")
    assert rows(logs.heavy_signatures(few, 5)) == rows(logs.top_signatures(few, 5))
