import pytest

from mendline.operators import planlint, sqllint, sqlprofile


def models(spark, *sql):
    return spark.createDataFrame([(f"m{i}.sql", s) for i, s in enumerate(sql)], "path string, sql string")


def queries(spark, *sql):
    return spark.createDataFrame([(f"q{i}", s) for i, s in enumerate(sql)], "query_id string, sql string")


SLOW = """-- with a comment (select *)
SELECT *
FROM sales s
JOIN stores t ON s.store_id = t.id
WHERE LOWER(t.email) LIKE '%@mail%' AND s.status NOT IN (
    SELECT DISTINCT status FROM old
)
ORDER BY s.sold_at
"""


def test_metrics_and_score(spark):
    (m,) = sqlprofile.profile(models(spark, SLOW)).collect()
    assert (m.lines, m.ctes, m.joins, m.subqueries, m.distinct_count) == (8, 1, 1, 2, 1)
    assert (m.select_star, m.not_in_subquery, m.order_without_limit) == (True, True, True)
    # The strict wildcard rule wants a word character after the sign.
    assert (m.leading_wildcard, m.no_where, m.cross_join) == (False, False, False)
    assert m.score == 1 + 2 + 4 + 0 + 3 + 1 + 3 + 1 and m.risk == "HIGH"


def test_lines_follow_all_line_breaks(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc", "a\n\n", "a\x0bb\x0cc d\x85e", "\n"]
    got = {r.path: r.lines for r in sqlprofile.model_metrics(models(spark, *texts)).collect()}
    assert [got[f"m{i}.sql"] for i in range(len(texts))] == [len(t.splitlines()) for t in texts]


def test_templates_do_not_count(spark):
    (m,) = sqlprofile.model_metrics(models(spark, "select a from {{ ref('x join y') }}\n{% if join %} where {% endif %}limit 1")).collect()
    assert m.joins == 0 and m.no_where is False


def test_score_caps(spark):
    heavy = "WITH a AS (SELECT 1)" + ", b AS (SELECT 1)" * 30 + " SELECT 1 " + " JOIN t" * 30 + "\n" * 2000
    (m,) = sqlprofile.profile(models(spark, heavy)).collect()
    assert m.ctes == 31 and m.joins == 30 and m.score == 10 + 20 + 10 + 10


def test_risk_labels(spark):
    df = spark.createDataFrame([(0,), (4,), (5,), (9,), (10,), (19,), (20,)], "score bigint")
    labels = [r[0] for r in df.select(sqlprofile.risk_label(df.score)).collect()]
    assert labels == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]


def test_flags_rank_and_summary(spark, rows):
    joins = "select a from t" + " join u on 1" * 6
    ctes = "with a as (select 1)" + ", b as (select 1)" * 6 + " select x from a where 1"
    profiled = sqlprofile.profile(models(spark, SLOW, "select a from t", joins, ctes, "select b from t"))
    assert rows(sqlprofile.flags(profiled)) == [
        ("m0.sql", "not_in_subquery"),
        ("m0.sql", "order_without_limit"),
        ("m0.sql", "select_star"),
        ("m1.sql", "no_where"),
        ("m2.sql", "many_joins"),
        ("m3.sql", "many_ctes"),
        ("m4.sql", "no_where"),
    ]
    ranked = sqlprofile.ranked_models(profiled).orderBy("rank").collect()
    assert [(r["rank"], r.path, r.score) for r in ranked] == [
        (1, "m3.sql", 17), (2, "m0.sql", 15), (3, "m2.sql", 12), (4, "m1.sql", 0), (5, "m4.sql", 0),
    ]
    assert [r.path for r in sqlprofile.top_models(profiled, 2).collect()] == ["m3.sql", "m0.sql"]
    assert rows(sqlprofile.project_summary(profiled)) == [(5, 8.8, 3)]
    assert rows(sqlprofile.project_summary(profiled.limit(0))) == [(0, 0.0, 0)]


def lint(spark, sql, **options):
    return [(r.evidence, r.rule_id) for r in sqllint.lint(queries(spark, sql), **options).orderBy("evidence", "rule_id").collect()]


def test_lint(spark):
    assert [rule for _, rule in lint(spark, SLOW)] == [
        "distinct", "function_in_where", "leading_wildcard", "not_in_subquery", "order_without_limit", "select_star",
    ]
    assert lint(spark, "SELECT a FROM t WHERE b = 1 LIMIT 1") == [("SELECT 1", "no_issue")]
    assert lint(spark, "select a from t") == [("SELECT 1", "no_where")]
    # Words in literals and comments are not seen.
    assert lint(spark, "select a from t where b = 'cross join' -- distinct") == [("SELECT 1", "no_issue")]
    joined = "select a from t" + " join u on 1" * 4 + " where exists (select 1) and x in (select 2) and y = (select 3)"
    found = {r.rule_id: r.n for r in sqllint.lint(queries(spark, joined)).collect()}
    assert found == {"many_joins": 4, "subqueries": 1}


def test_lint_per_statement(spark):
    found = lint(spark, "delete from t; select x from a cross join b; ;")
    assert found == [("DELETE 1", "cross_join"), ("SELECT 2", "cross_join"), ("SELECT 2", "no_where")]


def test_strict_lint_reads_comments(spark):
    assert ("SELECT 1", "cross_join") in lint(spark, "select a from t where b -- cross join", strict=True)
    assert ("SELECT 1", "leading_wildcard") not in lint(spark, "select a from t where b like '%@x'", strict=True)


def test_statements(spark, rows):
    sql = "select 1; with a as (select 1) select * from a; select 1 union select 2; insert into t values (';'); (select 3)"
    assert rows(sqllint.statements(queries(spark, sql)), "stmt_no", "kind") == [
        (1, "SELECT"), (2, "SELECT"), (3, "UNION"), (4, "INSERT"), (5, "SELECT"),
    ]
    assert rows(sqllint.statement_counts(queries(spark, sql)), "n_statements", "n_selects", "n_set_operations") == [(5, 3, 1)]


@pytest.mark.parametrize(
    "sql, allowed",
    [("SELECT 1", True), ("  ((with a as (select 1) select 1))", True), ("table t", True), ("drop table t", False), ("", False)],
)
def test_read_only(spark, sql, allowed):
    assert sqllint.read_only(queries(spark, sql)).first().allowed is allowed


def observed(spark, plan, engine="postgres"):
    plans = spark.createDataFrame([("q", engine, plan)], "query_id string, engine string, plan_text string")
    return {r.rule_id: r.evidence for r in planlint.lint_plans(plans).collect()}


def test_postgres_plans(spark):
    plan = """Nested Loop  (cost=0..9 rows=250000 width=4) (actual time=0..1 rows=20 loops=1)
  Sort Method: external merge  Disk: 9kB
  ->  Hash Join (rows=5) (actual rows=900)
      Batches: 16
  ->  Seq Scan on sales  (rows=7) (actual rows=7)
  ->  Seq Scan on stores
  ->  Seq Scan on sales
  ->  Index Only Scan Backward using ix_a on t
Planning Time: 612.5 ms
Execution Time: 1500.129 ms"""
    assert observed(spark, plan) == {
        "nested_loop": "",
        "sort_spill": "",
        "hash_spill": "",
        "sequential_scan": "sales, stores",
        "row_estimate": "250000 estimated, 20 actual",
        "index_scan": "ix_a",
        "planning_time": "612.50 ms",
        "execution_time": "1500.13 ms slow",
    }
    assert observed(spark, "Result  (rows=1) (actual rows=0)\nBatches: 1\nNested Loop rows=9999") == {"no_issue": ""}
    assert observed(spark, "Execution Time: 99.9 ms")["execution_time"] == "99.90 ms fast"
    assert observed(spark, "Execution Time: 100 ms")["execution_time"] == "100.00 ms moderate"


def test_snowflake_plans(spark):
    assert set(observed(spark, "Table Scan of t; CartesianJoin; sort; UnionAll", " Snowflake ")) == {"table_scan", "cartesian", "sort", "union"}
    assert observed(spark, "Result", "snow") == {"no_issue": ""}


def test_lint_takes_a_query_apart_once(spark):
    found = sqllint.lint(queries(spark, "SELECT 1; SELECT 'a' -- b"))
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("split(") == 1
    # Tests of a statement are columns; the generator only picks among them.
    assert not [line for line in optimized.splitlines() if "Generate" in line and "RLIKE" in line]


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("SELECT * from t ſ limit 1", ["no_where", "select_star"]),
        ("SELECT K FROM t CROſS JOıN u WHERE x = 1", ["cross_join"]),
        ("SELECT DıſTıNCT a FROM t ORDER BY a", ["distinct", "no_where", "order_without_limit"]),
    ],
)
def test_patterns_run_on_letters_outside_ascii(spark, sql, expected):
    """Patterns that ignore case also take the relatives of i, k and s."""
    assert sorted(r.rule_id for r in sqllint.lint(queries(spark, sql)).collect()) == expected


def test_plans_of_both_engines_are_read_once(spark):
    plans = spark.createDataFrame(
        [
            ("a", "postgres", "Nested Loop rows=100000\nrows=7 x actual rows=900"),
            ("b", " SNOW", "Sort; Nested Loop rows=100000"),
            ("c", "other", "Sort"),
            ("d", "postgres", None),
            ("e", "snowflake", None),
        ],
        "query_id string, engine string, plan_text string",
    )
    found = planlint.lint_plans(plans)
    assert sorted((r.artifact, r.rule_id, r.evidence) for r in found.collect()) == [
        ("a", "nested_loop", ""),
        ("a", "row_estimate", "7 estimated, 900 actual"),
        ("b", "sort", "SORT"),
        ("d", "no_issue", ""),
        ("e", "no_issue", ""),
    ]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
