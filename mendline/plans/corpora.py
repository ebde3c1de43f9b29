"""Corpora derived from the given tables: logs, model SQL, artifacts, contracts, plans and workflow files.

The given tables hold no logs or SQL, so each row of a table is turned into one file, query or line by an
expression. The same expression text runs in Spark and in the SQL that checks a query, so every corpus grows with
its table and both sides read equal input.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.functions.scale import spread

NL, TAB = "chr(10)", "chr(9)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def rows(*parts: str) -> str:
    """The parts as lines of one text."""
    return cat(*[p for i, part in enumerate(parts) for p in ([NL, part] if i else [part])])


def case(*pairs: tuple[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def div(key: str, n: int) -> str:
    return f"CAST(floor({key} / {n}) AS BIGINT)"


class Corpus(NamedTuple):
    table: str
    columns: dict[str, str]
    #: Whether the table is small beside the work that its texts make, so that a file must not be a task.
    dealt: bool = False

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """A generator of one row: operators then see plain columns, and no text is built more than once."""
        fields = ", ".join(f"{e} AS `{n}`" for n, e in self.columns.items())
        rows = read(spark, sf_dir, self.table)
        return (spread(rows) if self.dealt else rows).selectExpr(f"inline(array(struct({fields})))")

    @property
    def sql(self) -> str:
        names = ", ".join(f'{e} AS "{n}"' for n, e in self.columns.items())
        return f"(SELECT {names} FROM {self.table})"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- logs, one file per document --------------------------------------------------------------

_F = "doc_id % 6"
_HEAD = case(
    (f"{_F} = 0", rows(cat(lit("10:00:01  Running model m_"), "doc_id"), cat(lit("10:00:02  ERROR creating view m_"), "doc_id % 97"))),
    (
        f"{_F} = 1",
        rows(
            cat(lit("[2024-01-15] {taskinstance.py:1} ERROR - Task load_"), "doc_id % 31", lit(" failed with exit 1")),
            lit("Traceback (most recent call last):"),
            lit('  File "/dags/load.py", line 4, in run'),
            lit(""),
            lit("    rows = load()"),
            lit("KeyError: 'amount'"),
        ),
    ),
    (f"{_F} = 2", rows(lit("14:00:01 | ERROR   | Flow run 'a-b' crashed hard"), lit("Task run 'load-0' has failed early"))),
    (
        f"{_F} = 3",
        rows(
            lit("24/01/15 14:23:01 INFO SparkContext: Running"),
            cat(lit("24/01/15 14:24:15 WARN TaskSetManager: Lost task "), "doc_id % 13", lit(".0: java.lang.OutOfMemoryError (Java heap space)")),
            lit("WARN MemoryStore: Not enough space to cache"),
        ),
    ),
    default=rows(lit("FATAL  cannot start"), cat(lit("ValueException: bad row "), "doc_id % 17")),
)
# What every line break of a document turns into: level lines, plain lines or indented lines.
_BREAK = case(
    ("doc_id % 4 = 0", cat(NL, lit("    INFO "))),
    ("doc_id % 4 = 1", cat(NL, lit("10:04:07 ERROR  "))),
    ("doc_id % 4 = 2", cat(NL, lit("WARN Worker: - "))),
    default=NL,
)
_TAIL = case(
    (
        f"{_F} = 0",
        rows(
            lit(""),
            cat(lit("Database Error in model m_"), "doc_id % 97"),
            cat(lit('  column "c_'), "doc_id % 11", lit('" does not exist')),
            lit("Runtime Error: node model.p.m had an error"),
            lit("the view does not compile"),
            lit("Compilation Error in model x"),
            lit("Unhandled exception: boom"),
            lit("done "),
        ),
    ),
    (
        f"{_F} = 1",
        rows(
            lit(""),
            lit("Traceback (most recent call last):"),
            cat(lit("  File x, line "), "doc_id % 23"),
            cat(lit("airflow.exceptions.AirflowException: job "), "doc_id % 5"),
            lit("DagBagError: duplicate dag"),
            lit("pool default_pool is full"),
        ),
    ),
    (f"{_F} = 2", rows(lit(""), lit("prefect.exceptions.CrashException: lost"), lit("Traceback (most recent call last):"), lit("  at end "))),
    (
        f"{_F} = 3",
        rows(
            lit(""),
            lit("ERROR SparkContext: Error initializing"),
            cat(lit("java.lang.IllegalStateException: bad state "), "doc_id % 9"),
            cat(TAB, lit("at org.apache.spark.Task.run(Task.scala:12)")),
            lit(""),
            cat(TAB, lit("at org.apache.spark.Task.go(Task.scala:14)")),
            lit("Caused by: org.apache.spark.SparkException: Job aborted"),
            cat(TAB, lit("at java.lang.Thread.run(Thread.java:750)")),
            cat(TAB, lit("... 12 more")),
            lit("Caused by: java.io.IOException: No space left"),
            cat(TAB, lit("at com.acme.FooError.run(Foo.java:3)")),
            cat(lit("org.apache.spark.shuffle.FetchFailedException: host-"), "doc_id % 8"),
            cat(lit("Stage "), "doc_id % 3", lit(" has failed; Stage 9 failed 4 times")),
            lit("Job 0 failed: collect at X.scala:1, took 3 s"),
            lit("ExecutorLostFailure (executor 3 exited) executor 3 lost"),
            lit("task is 12x slower than the median"),
            lit("AnalysisException: no such column"),
        ),
    ),
    default=rows(lit(""), lit("ERROR "), lit("last line"), lit("CRITICAL  low disk")),
)

LOG_FILES = Corpus(
    "documents",
    {
        "path": cat(lit("logs/"), "source", lit("/"), "doc_id", lit(".log")),
        "framework": case(
            (f"{_F} = 0", lit("DBT")),
            (f"{_F} = 1", lit("airflow")),
            (f"{_F} = 2", lit("prefect")),
            (f"{_F} = 3", lit("spark")),
            (f"{_F} = 4", lit("generic")),
            default=lit("custom"),
        ),
        "content": case(
            ("doc_id % 7 = 3", "text"),
            default=cat(_HEAD, _BREAK, f"replace(text, {NL}, {_BREAK})", _TAIL),
        ),
    },
)

# Long logs with their errors at the start, so that a reading of the recent end misses some.
LONG_LOGS = Corpus(
    "documents",
    {"path": cat(lit("logs/"), "doc_id", lit(".log")), "content": cat(_HEAD, NL, lit("Stage 4 was failed"), NL, "repeat(text, 8)")},
)

# --- log lines, several per event -------------------------------------------------------------

_E = "event_id % 9"
_BLOCK = case(
    (
        f"event_type = 'error' AND {_E} < 2",
        rows(
            lit("ERROR SparkContext: java.lang.OutOfMemoryError: Java heap space"),
            cat(TAB, lit("at java.util.Arrays.copyOf(Arrays.java:3210)")),
            cat(TAB, lit("at org.apache.spark.Task.run(Task.scala:"), "event_id % 50", lit(")")),
            lit("Caused by: java.io.IOException: No space left"),
            cat(TAB, lit("at com.acme.Disk.write(Disk.java:7)")),
        ),
    ),
    (
        f"event_type = 'error' AND {_E} < 4",
        cat(lit("WARN TaskSetManager: Lost task "), "event_id % 5", lit(": org.apache.spark.shuffle.FetchFailedException: host-"), "event_id % 7"),
    ),
    (
        f"event_type = 'error' AND {_E} < 6",
        rows(
            cat(lit("java.lang.IllegalStateException: value "), "event_id % 4"),
            lit(""),
            cat(TAB, lit("at com.acme.Late.frame(Late.java:2)")),
            lit(""),
            lit("Caused by: java.lang.RuntimeException: inner"),
            lit("at not.indented(Frame.java:1)"),
            lit(""),
            lit("at after.blank(Frame.java:1)"),
        ),
    ),
    (
        "event_type = 'error'",
        rows(
            cat(lit("ERROR DAGScheduler: Stage "), "event_id % 6", lit(" was failed")),
            cat(lit("ExecutorLostFailure (executor "), "event_id % 3", lit(" exited)")),
            lit("Job 12 failed: collect"),
        ),
    ),
    ("event_type = 'signup'", cat(lit("24/01/15 14:23:01 WARN Scheduler: straggler on host "), "event_id % 6")),
    ("event_type = 'click'", rows(cat(TAB, lit("at com.acme.FooError.bar(Foo.java:9)")), lit("Caused by: nothing known"))),
    ("event_type = 'purchase'", rows(lit("   "), cat(lit("INFO Store: "), "props"))),
    default=cat(lit("INFO Web: user "), "user_id"),
)
_EVENT_LINES = Corpus(
    "events",
    {"path": cat(lit("app-"), "user_id", lit(".log")), "event_id": "event_id", "ts": "ts", "block": _BLOCK},
)


def timed_lines(events: DataFrame) -> DataFrame:
    """``(ts, path, line_no, text)`` of a table or stream of events."""
    fields = ", ".join(f"{e} AS `{n}`" for n, e in _EVENT_LINES.columns.items())
    each = events.selectExpr(f"inline(array(struct({fields})))").select("ts", "path", "event_id", F.posexplode(F.split("block", "\n")).alias("pos", "text"))
    return each.select(F.col("ts").cast("timestamp").alias("ts"), "path", (F.col("event_id") * 16 + F.col("pos")).alias("line_no"), "text")


class _LogLines(NamedTuple):
    """``(path, line_no, text)``: line numbers rise with the event, with gaps between events."""

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return (
            _EVENT_LINES.load(spark, sf_dir)
            .select("path", "event_id", F.posexplode(F.split("block", "\n")).alias("pos", "text"))
            .select("path", (F.col("event_id") * 16 + F.col("pos")).alias("line_no"), "text")
        )

    @property
    def sql(self) -> str:
        return (
            "(SELECT path, event_id * 16 + pos - 1 AS line_no, text FROM (SELECT path, event_id, unnest(l) AS text, "
            f"generate_subscripts(l, 1) AS pos FROM (SELECT path, event_id, string_split(block, chr(10)) AS l FROM {_EVENT_LINES.sql})))"
        )


LOG_LINES = _LogLines()

# --- model SQL, one model per part ------------------------------------------------------------

_P = "p_partkey % 7"
_REF = cat(lit("{{ ref('m_"), div("p_partkey", 2), lit("') }}"))
_REF3 = cat(lit("{{ref(\"m_"), div("p_partkey", 3), lit("\")}}"))
_SRC = cat(lit("{{ source('raw', 't_"), "p_size", lit("') }}"))
_SQL = case(
    (
        f"{_P} = 0",
        cat(
            rows(
                lit("{{ config(materialized='table', meta={'a': {'b': 1}}) }}"),
                cat(lit("WITH a AS (SELECT * FROM "), _REF, lit("),")),
                cat(lit("b AS (SELECT k, sum(x) AS total_x FROM "), _SRC, lit(" GROUP BY k)")),
                lit("SELECT a.customer_id, b.total_x, coalesce(a.email, 'none, x') AS email,"),
                lit("  CASE WHEN a.status = 'open' THEN 1 WHEN status = 'open' THEN 1 WHEN status = 'done' THEN 2 END AS order_status,"),
                lit("  count(*), a.kind kind -- it's, the kind"),
                lit("FROM a"),
            ),
            "repeat(' LEFT JOIN t ON t.x = a.x', CAST(p_size % 8 AS INT))",
            rows(lit(""), lit("WHERE a.Kind IN ('p', 'q', 'p') AND b.y NOT IN ('z') AND status in ('void', 'open')")),
        ),
    ),
    (f"{_P} = 1", rows(cat(lit("select * from "), _REF3), lit("order by created_at"), lit(""))),
    (
        f"{_P} = 2",
        rows(
            cat(lit("with src as (select * from "), _REF, lit("), final as (")),
            cat(lit("  select s.m_"), "p_partkey", lit("_id, s.order_id, s.m_"), div("p_partkey", 2), lit("_id, count(*) as n_rows,")),
            lit("    max(f(g(h(x), 2), 3)) as max_amount, s.updated_at, s.region_name"),
            lit("  from src s where s.tier = 'gold' group by 1, 2"),
            lit(") select * from final"),
        ),
    ),
    (
        f"{_P} = 3",
        rows(
            cat(lit("SELECT DISTINCT o.id, o.user_email, o.unit_price FROM "), _REF, lit(" o CROSS  JOIN "), _REF),
            lit("WHERE o.name LIKE '%abc' AND o.id NOT IN ( SELECT id FROM z ) AND o.note LIKE 'SELECT %'"),
            lit("ORDER BY 1"),
        ),
    ),
    (
        f"{_P} = 4",
        cat(
            lit("/* header; with (brackets */ SELECT pk_row, surrogate_key, ship_date, sum(q) FROM "),
            _SRC,
            "repeat(concat(chr(10), '-- pad and JOIN'), CAST(p_size * 4 AS INT))",
        ),
    ),
    (f"{_P} = 5", cat(lit("SELECT id, name, updated_at, type FROM "), _SRC, lit(" WHERE id > 1 LIMIT 10;"), NL)),
    default=cat(
        lit("{% if x %}"),
        NL,
        lit("WITH c0 AS (SELECT 1 AS one)"),
        "repeat(', c AS (SELECT 1 AS one, (SELECT 2) AS two)', CAST(p_size % 12 AS INT))",
        NL,
        lit("{% endif %} SELECT one AS num_ones, t.two, 3 + 4 FROM c0"),
    ),
)
MODELS = Corpus(
    "part",
    {
        "path": cat(lit("models/"), "p_brand", lit("/m_"), "p_partkey", lit(".sql")),
        "name": cat(lit("m_"), "p_partkey"),
        "sql": _SQL,
    },
    dealt=True,
)

# --- query log, one query per order -----------------------------------------------------------

_Q = "o_orderkey % 9"
_QUERY = case(
    (f"{_Q} = 0", lit("SELECT * FROM orders o, customers c ORDER BY o.id")),
    (f"{_Q} = 1", cat(lit("select id from t where lower(name) = 'x; y' and id in (1, 2) and n > "), "o_custkey", lit(" limit 5"))),
    (f"{_Q} = 2", rows(lit("SELECT a.x FROM a JOIN b ON 1 JOIN c ON 2 JOIN d ON 3 JOIN e ON 4 WHERE a.y LIKE '%z'; SELECT *"), lit("FROM a"))),
    (f"{_Q} = 3", rows(lit("WITH w AS (SELECT * FROM t) SELECT DISTINCT x FROM (SELECT x FROM w) s"), lit("-- CROSS JOIN in a comment"), lit("WHERE x NOT IN ( SELECT y FROM u )"))),
    (f"{_Q} = 4", cat(lit("DELETE FROM t WHERE k = "), "o_custkey")),
    (f"{_Q} = 5", lit("(SELECT 1 UNION ALL SELECT 2); ; INSERT INTO t SELECT * FROM s CROSS JOIN r")),
    (f"{_Q} = 6", lit("TABLE orders")),
    (f"{_Q} = 7", cat(lit("  ((select count(distinct x) from t where exists (select 1 from u) and z = "), "o_custkey", lit("))"))),
    default=lit("SELECT x FROM t WHERE y = 1 LIMIT 3;"),
)
QUERIES = Corpus("orders", {"query_id": cat(lit("q"), "o_orderkey"), "sql": _QUERY})

# --- plans, one per order ---------------------------------------------------------------------

_ACTUAL = case(("o_orderkey % 4 = 0", "o_custkey * 500 + 1"), ("o_orderkey % 4 = 1", "0"), default="o_custkey + 3")
_PG = rows(
    cat(
        case(("o_orderkey % 5 = 0", lit("Nested Loop")), ("o_orderkey % 5 = 1", lit("Sort")), default=lit("Hash Join")),
        lit("  (cost=0.00..9.00 rows="),
        "o_custkey + 1",
        lit(" width=8) (actual time=0.1..0.2 rows="),
        _ACTUAL,
        lit(" loops=1)"),
    ),
    cat(lit("  Sort Method: "), case(("o_orderkey % 6 = 0", lit("external merge  Disk: 10kB")), default=lit("quicksort"))),
    cat(lit("  Buckets: 1024  Batches: "), "o_orderkey % 13", lit("  Memory Usage: 9kB")),
    cat(lit("  ->  Seq Scan on orders_"), "o_custkey % 7", lit("  (cost=0.00..1.00 rows=2000 width=8) (actual time=0.0..0.1 rows=5 loops=1)")),
    cat(lit("  ->  Seq Scan on t"), "o_orderkey % 3", lit(" t")),
    case(
        ("o_orderkey % 3 = 0", cat(lit("  ->  Index Only Scan Backward using ix_"), "o_custkey % 5", lit(" on t"))),
        default=lit("  ->  Seq Scan on orders"),
    ),
    cat(lit("Planning Time: "), "o_orderkey % 900", lit(".25 ms")),
    cat(lit("Execution Time: "), "o_custkey % 2000", lit(".5 ms")),
)
_SF = case(
    ("o_orderkey % 8 = 1", lit("Result -> Filter -> TableScan T1")),
    ("o_orderkey % 8 = 3", lit("GlobalStats; table scan of T; Sort by 1")),
    ("o_orderkey % 8 = 5", lit("CartesianJoin -> UnionAll")),
    default=lit("Result"),
)
PLANS = Corpus(
    "orders",
    {
        "query_id": cat(lit("q"), "o_orderkey"),
        "engine": case(("o_orderkey % 2 = 0", lit("postgres")), default=lit(" Snowflake")),
        "plan_text": case(("o_orderkey % 2 = 0", _PG), default=_SF),
    },
)

# --- run artifacts ----------------------------------------------------------------------------

RUN_RESULTS = Corpus(
    "events",
    {
        "run_id": cat(lit("run-"), "user_id"),
        "unique_id": case(("event_id % 19 = 0", "CAST(NULL AS VARCHAR(20))"), default=cat(lit("model.shop.m_"), "event_id")),
        "status": case(
            ("event_id % 17 = 0", "CAST(NULL AS VARCHAR(20))"),
            ("event_type = 'view'", lit("success")),
            ("event_type = 'click'", lit("pass")),
            ("event_type = 'signup'", lit("warn")),
            ("event_type = 'error'", lit("error")),
            default=lit("skipped"),
        ),
        "message": "repeat(props, CAST(event_id % 200 AS INT))",
        "execution_time": case(("event_id % 5 = 0", "CAST(0 AS DOUBLE)"), default="value"),
    },
)


def _node(uid: str, name: str, kind: str, deps: str) -> str:
    return cat(
        lit('"'), uid, lit('": {"name": "'), name, lit('", "resource_type": "'), kind, lit('", "depends_on": {"nodes": ['), deps, lit("]}}")
    )


_MODEL = lambda key: cat(lit("model.shop.m_"), key)
_MANIFEST = cat(
    lit('{"metadata": {"n": 1}, "nodes": {'),
    _node(_MODEL("o_orderkey"), cat(lit("m_"), "o_orderkey"), lit("model"), cat(lit('"source.shop.raw.t'), "o_custkey % 50", lit('", "model.other.base_'), "o_custkey", lit('"'))),
    lit(", "),
    _node(cat(lit("model.shop.k_"), "o_orderkey"), cat(lit("k_"), "o_custkey"), lit("model"), cat(lit('"'), _MODEL("o_orderkey"), lit('"'))),
    lit(", "),
    _node(cat(lit("model.shop.z_"), "o_orderkey"), lit("z"), lit("model"), lit("")),
    lit(", "),
    _node(cat(lit("test.shop.t_"), "o_orderkey"), cat(lit("t_"), "o_orderkey"), lit("test"), cat(lit('"'), _MODEL("o_orderkey"), lit('"'))),
    lit('}, "sources": {"source.shop.raw.t'),
    "o_custkey % 50",
    lit('": {"source_name": "raw", "name": "t'),
    "o_custkey % 50",
    lit('"}}, "exposures": {'),
    case(
        ("o_orderstatus = 'F'", cat(lit('"exposure.shop.board": {"name": "board", "depends_on": {"nodes": ["model.shop.k_'), "o_orderkey", lit('"]}}'))),
        default=lit(""),
    ),
    lit("}}"),
)
_RESULTS = cat(
    lit('{"results": [{"unique_id": "model.shop.m_'),
    "o_orderkey",
    lit('", "status": "'),
    case(("o_orderstatus = 'F'", lit("error")), ("o_orderstatus = 'P'", lit("warn")), default=lit("success")),
    lit('", "message": "took long", "execution_time": '),
    "o_custkey % 100",
    lit('.5}, {"unique_id": "test.shop.t", "status": "pass", "message": null, "execution_time": 0.0}, {"status": "skipped"}]}'),
)
ARTIFACTS = Corpus(
    "orders",
    {
        "path": cat(
            lit("target/"), "o_orderkey", case(("o_orderkey % 5 = 0", lit("/Run_Results.json")), ("o_orderkey % 5 = 1", lit("/out.json")), default=lit("/manifest.json"))
        ),
        "content": case(
            ("o_orderkey % 5 < 2", _RESULTS),
            ("o_orderkey % 5 = 2", lit('{"metadata": {"nodes": 1}}')),
            ("o_orderkey % 5 = 3 AND o_orderstatus = 'P'", lit("not json {")),
            default=_MANIFEST,
        ),
    },
)

# --- graphs -----------------------------------------------------------------------------------


class _Edges(NamedTuple):
    """Union of (table, child expression, parent expression, condition) parts."""

    parts: tuple[tuple[str, str, str, str], ...]

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for table, child, parent, where in self.parts:
            df = read(spark, sf_dir, table).where(where).selectExpr(f"{child} AS child", f"{parent} AS parent")
            out = df if out is None else out.unionByName(df)
        return out

    @property
    def sql(self) -> str:
        return "(" + " UNION ALL ".join(f"SELECT {c} AS child, {p} AS parent FROM {t} WHERE {w}" for t, c, p, w in self.parts) + ")"


_M = lambda key: cat(lit("m_"), key)
# Each part depends on the parts at a half and a third of its key: depth grows with the logarithm of the table.
PART_EDGES = _Edges(
    (
        ("part", _M("p_partkey"), _M(div("p_partkey", 2)), f"{div('p_partkey', 2)} >= 1"),
        ("part", _M("p_partkey"), _M(div("p_partkey", 3)), f"{div('p_partkey', 3)} >= 1"),
    )
)
# Orders depend on customers and priorities, customers on nations, nations on regions: few parents with very many children.
SHOP_EDGES = _Edges(
    (
        ("orders", cat(lit("order_"), "o_orderkey"), cat(lit("customer_"), "o_custkey"), "o_orderkey IS NOT NULL"),
        ("orders", cat(lit("order_"), "o_orderkey"), cat(lit("raw."), "o_orderpriority"), "o_orderkey IS NOT NULL"),
        ("customer", cat(lit("customer_"), "c_custkey"), cat(lit("nation_"), "c_nationkey"), "c_custkey IS NOT NULL"),
        ("nation", cat(lit("nation_"), "n_nationkey"), cat(lit("raw.region_"), "n_regionkey"), "n_nationkey IS NOT NULL"),
    )
)

# --- contracts and live columns, one column per customer --------------------------------------

_MART = div("c_custkey", 10)
CONTRACTS = Corpus(
    "customer",
    {
        "model": case((f"{_MART} % 9 = 0", cat(lit("legacy_"), _MART)), default=cat(lit("mart_"), _MART)),
        "column": case((f"{_MART} % 8 = 1", "CAST(NULL AS VARCHAR(20))"), default=cat(lit("Col_"), "c_custkey")),
        "data_type": case(
            ("c_mktsegment = 'BUILDING'", lit("integer")),
            ("c_mktsegment = 'MACHINERY'", lit(" VARCHAR(255)")),
            ("c_mktsegment = 'HOUSEHOLD'", lit("numeric(10,2)")),
            ("c_mktsegment = 'FURNITURE'", lit("geometry")),
            default="CAST(NULL AS VARCHAR(20))",
        ),
        "n_tests": "CAST(c_nationkey % 3 AS BIGINT)",
    },
)
LIVE_COLUMNS = Corpus(
    "customer",
    {
        "table": case((f"{_MART} % 13 = 5", cat(lit("moved_"), _MART)), (f"{_MART} % 9 = 0", cat(lit("legacy_"), _MART)), default=cat(lit("mart_"), _MART)),
        "column": case(("c_acctbal < 0", cat(lit("col_"), "c_custkey", lit("_v2"))), default=cat(lit("col_"), "c_custkey")),
        "data_type": case(
            ("c_nationkey < 8", lit("bigint")),
            ("c_nationkey < 14", lit("character varying")),
            ("c_nationkey < 20", lit("double precision")),
            default=lit("Geometry"),
        ),
    },
)
SQL_MODELS = Corpus("part", {"name": cat(lit("mart_"), div("p_partkey", 10))})

# --- workflow files ---------------------------------------------------------------------------

_C = "c_custkey % 5"
DAG_FILES = Corpus(
    "customer",
    {
        "path": cat(lit("dags/"), "c_mktsegment", lit("/d_"), "c_custkey", lit(".py")),
        "content": rows(
            lit("from airflow import DAG"),
            cat(
                lit("dag = DAG(dag_id='dag_"),
                "c_custkey",
                lit("', "),
                case(
                    (f"{_C} = 0", lit("schedule_interval='0 9 * * *', catchup=True)")),
                    (f"{_C} = 1", lit('schedule = "@daily", catchup = False)')),
                    (f"{_C} = 2", lit("schedule=None, catchup=False)")),
                    default=lit("default_args={'retries': 0})"),
                ),
            ),
            cat(lit("extract = PythonOperator(task_id='extract_"), "c_nationkey", lit("', retries=0)")),
            lit("load = BashOperator ( task_id = \"load\" )"),
            case(
                ("c_custkey % 6 = 0", lit("def broken(:")),
                default=cat(lit("check_"), "c_nationkey", lit(" = EmptyOperator(task_id='check')")),
            ),
            lit("# extract >> nothing"),
            cat(lit("extract >> [load, check_"), "c_nationkey", lit("] >> notify  # fan out")),
            lit("load >> notify"),
        ),
    },
    dealt=True,
)
_S = "s_suppkey % 4"
FLOW_FILES = Corpus(
    "supplier",
    {
        "path": cat(lit("flows/f_"), "s_suppkey", lit(".py")),
        "content": rows(
            lit("from prefect import flow, task"),
            cat(lit("@task(retries="), "s_nationkey", lit(", retry_delay_seconds=5)")),
            cat(lit("def load_"), "s_suppkey", lit("(x):")),
            lit("    return x"),
            lit("@prefect.task"),
            lit("def clean(x):"),
            lit("    return x"),
            case((f"{_S} = 0", lit("@flow(name='a')")), default=lit("@flow")),
            cat(lit("def main_"), "s_nationkey", lit("():")),
            case((f"{_S} = 1", lit("    f = clean.submit(1)")), (f"{_S} = 2", lit("    f = clean.submit(1).result()")), default=lit("    f = 1")),
            case((f"{_S} = 3", rows(lit("@flow"), lit("def inner():"), lit("    return raise_on_failure"))), default=lit("    return f")),
            case(
                ("s_suppkey % 7 = 3", lit("def broken(:")),
                default=cat(lit("main_schedule = dict(cron='0 "), "s_suppkey % 24", lit(" * * *', interval=60)")),
            ),
        ),
    },
    dealt=True,
)

# --- fixes ------------------------------------------------------------------------------------

DOC_FILES = Corpus("documents", {"path": cat(lit("doc_"), "doc_id"), "content": "text"})
# Long texts, so that both reading limits apply.
LONG_FILES = Corpus("documents", {"path": cat(lit("doc_"), "doc_id"), "content": "repeat(text, 8)"})
# A second fix of the same files, applied after the first.
LATER_FIXES = Corpus(
    "labels",
    {
        "path": case(("toxic = 1", cat(lit("gone_"), "doc_id")), default=cat(lit("doc_"), "doc_id")),
        "original": case(("doc_id % 3 = 0", lit("<fixed>")), default=lit("e")),
        "replacement": case(("doc_id % 4 = 0", lit("e")), default=lit("[e]")),
    },
)
FIXES = Corpus(
    "labels",
    {
        "path": case(("toxic = 1", cat(lit("gone_"), "doc_id")), default=cat(lit("doc_"), "doc_id")),
        "original": case(("doc_id % 5 = 0", lit("no such text")), ("doc_id % 5 = 1", lit("on")), ("doc_id % 5 = 2", lit(". ")), default=lit("e")),
        "replacement": case(("doc_id % 5 = 3", lit("e")), ("quality = 1", lit("")), default=lit("<fixed>")),
    },
)

# --- files of a project -----------------------------------------------------------------------

#: Written to files and read back; every second name begins with a sign that hides a file from Spark's readers.
PROJECT_MODELS = Corpus(
    "supplier",
    {
        "path": cat(lit("models/n_"), "s_nationkey", case(("s_suppkey % 2 = 0", lit("/_m_")), default=lit("/m_")), "s_suppkey", lit(".sql")),
        "name": cat(case(("s_suppkey % 2 = 0", lit("_m_")), default=lit("m_")), "s_suppkey"),
        "sql": rows(cat(lit("-- "), "s_name"), cat(lit("SELECT * FROM {{ ref('m_"), div("s_suppkey", 2), lit("') }}")), lit("")),
    },
    dealt=True,
)
PROJECT_CONTRACTS = Corpus(
    "supplier",
    {
        "path": cat(lit("models/n_"), "s_nationkey", case(("s_suppkey % 2 = 0", lit("/_schema_")), default=lit("/schema_")), "s_suppkey", lit(".yml")),
        "model": cat(lit("m_"), "s_suppkey"),
        "content": rows(
            lit("version: 2"),
            lit("models:"),
            cat(lit("  - name: m_"), "s_suppkey"),
            lit("    columns:"),
            cat(lit("      - {name: k_"), "s_nationkey", lit(", data_type: integer, tests: [unique, not_null]}")),
            case(("s_suppkey % 3 = 0", lit("      - [not a column]")), default=lit("      - name: note")),
            lit(""),
        ),
    },
    dealt=True,
)
FLOW_FIXES = Corpus(
    "supplier",
    {
        "path": cat(lit("flows/f_"), "s_suppkey", lit(".py")),
        "original": case(("s_suppkey % 3 = 0", lit("retry_delay_seconds=5")), ("s_suppkey % 3 = 1", lit("return")), default=lit("nowhere")),
        "replacement": case(("s_suppkey % 3 = 0", lit("retry_delay_seconds=60")), default=lit("yield")),
    },
)
