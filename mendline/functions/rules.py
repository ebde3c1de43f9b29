"""Rule tables as plain data. The values are fixed: they decide which text is a finding."""

from __future__ import annotations

from typing import NamedTuple



class Rule(NamedTuple):
    """A pattern with the group to keep, and the fragments without which it cannot match.

    ``needs`` lists alternatives; of one of them all fragments must occur. Finding a fragment is far cheaper than running
    a pattern, so most texts never reach the pattern. Fragments of patterns that ignore case are lower case and
    avoid the letters i, k and s, which have relatives outside ASCII.
    """

    rule_id: str
    pattern: str
    group: int = 0
    needs: tuple[tuple[str, ...], ...] = ()

    @property
    def ignores_case(self) -> bool:
        return self.pattern.startswith("(?i)")


# --- Fixed values: extraction rules per framework, in reporting order -------------------------
# Two of them stop *before* a terminator: the traceback rule ends at the next line that is not indented, the
# JVM rule ends at the first stack frame.
_TRACEBACK = Rule(
    "traceback", r"Traceback \(most recent call last\)[^\n]*+(?:\n++[^\S\n][^\n]*+)*+", needs=(("Traceback (most",),)
)

EXTRACTION_RULES: dict[str, list[Rule]] = {
    "dbt": [
        Rule("compilation_error", r"(?s)Compilation Error.*", needs=(("Compilation Error",),)),
        Rule("database_error", r"(?s)Database Error.*", needs=(("Database Error",),)),
        Rule("runtime_error", r"(?s)Runtime Error.*", needs=(("Runtime Error",),)),
        Rule("level_line", r"(?:ERROR|WARN)\s+.*", needs=(("ERROR",), ("WARN",))),
        Rule("unhandled_exception", r"(?s)Unhandled exception.*", needs=(("Unhandled exception",),)),
        Rule("node_error", r"(?i)(?:node \S+ had an error|does not compile)", needs=(("had an error",), ("not comp",))),
    ],
    "airflow": [
        _TRACEBACK,
        Rule("level_line", r"(?:ERROR|CRITICAL)\s+-\s+.*", needs=(("ERROR",), ("CRITICAL",))),
        Rule("task_failed", r"(?i)Task\s+\S+\s+failed.*", needs=(("ta", "led"),)),
        Rule("import_error", r"(?:DagBag|Import)Error:.*", needs=(("DagBagError:",), ("ImportError:",))),
        Rule("airflow_exception", r"AirflowException:.*", needs=(("AirflowException:",),)),
        Rule("pool_full", r"(?i)(?:slot|pool)\s+\S+\s+is full", needs=((" full",),)),
    ],
    "prefect": [
        _TRACEBACK,
        Rule("level_line", r"(?:ERROR|CRITICAL)\s+.*", needs=(("ERROR",), ("CRITICAL",))),
        Rule("flow_crashed", r"(?i)Flow run .* crashed.*", needs=(("flow run ", " cra"),)),
        Rule("task_failed", r"(?i)Task run .* failed.*", needs=((" run ", " fa"),)),
        Rule("crash_exception", r"CrashException:.*", needs=(("CrashException:",),)),
    ],
    "spark": [
        Rule(
            "jvm_exception",
            r"(?s)((?:java\.lang\.|org\.apache\.|py4j\.)\S+Exception.*?)(?:\n\s*at |\z)",
            1,
            needs=(("Exception",),),
        ),
        Rule("stack_frame", r"at [\w\.$]+ \([\w\.$]+\.(?:java|scala):\d+\)", needs=(("at ", ".java:"), ("at ", ".scala:"))),
        Rule("caused_by", r"Caused by:.*", needs=(("Caused by:",),)),
        Rule("level_line", r"(?:ERROR|WARN)\s+.*", needs=(("ERROR",), ("WARN",))),
        Rule("engine_exception", r"(?:AnalysisException|SparkException|PythonException):.*", needs=(("Exception:",),)),
        Rule("task_set_warning", r"WARN\s+TaskSetManager.*", needs=(("WARN", "TaskSetManager"),)),
        Rule("job_failed", r"(?i)Job \d+ failed.*", needs=(("job ", "led"),)),
        Rule("stage_failed", r"(?i)Stage \d+ failed.*", needs=(("tage ", "led"),)),
        Rule("out_of_memory", r"(?i)OutOfMemoryError.*", needs=(("outofmemoryerror",),)),
        Rule("gc_overhead", r"(?i)GC overhead limit exceeded", needs=(("gc overhead",),)),
    ],
    "generic": [
        _TRACEBACK,
        Rule("level_line", r"(?:ERROR|CRITICAL|FATAL)\s+.*", needs=(("ERROR",), ("CRITICAL",), ("FATAL",))),
        Rule("exception", r"Exception:.*", needs=(("Exception:",),)),
    ],
}
SNIPPET_CHARS, SNIPPET_KEY_CHARS = 2000, 200

# --- Fixed values: JVM logs -------------------------------------------------------------------
JVM_HEAD = r"(?:java\.|org\.apache\.|scala\.|com\.|py4j\.)\S+(?:Exception|Error)[^\n]*"
# Possessive groups: a trace of any length is matched without growing the regex stack.
JVM_CHAIN = (
    r"(?:java\.|org\.apache\.|scala\.|com\.|py4j\.)\S+(?:Exception|Error)[^\n]*+"
    r"(?:\n\s++at [^\n]++)*+"
    r"(?:\nCaused by:[^\n]*+(?:\n\s++at [^\n]++)*+)*+"
)
CHAIN_CHARS, CHAIN_KEY_CHARS, CHAINS_SHOWN = 2000, 150, 5
WARN_KEY_CHARS, WARNS_SHOWN = 80, 20
STAGE_MATCHES = 10

JVM_CHAIN_NEEDS = (("Exception",), ("Error",))
JVM_CHAIN_STARTS = (("java.",), ("org.apache.",), ("scala.",), ("com.",), ("py4j.",))

# (severity, rule)
JVM_ISSUES: list[tuple[str, Rule]] = [
    (
        "CRITICAL",
        Rule(
            "out_of_memory",
            r"(?i)OutOfMemoryError|GC overhead limit exceeded|java heap space",
            needs=(("outofmemoryerror",), ("gc overhead",), ("java heap",)),
        ),
    ),
    (
        "ERROR",
        Rule(
            "shuffle_failure",
            r"(?i)FetchFailed|shuffle\s+\S+\s+failed|shuffle fetch failed",
            needs=(("fetchfa",), ("huffle", "led")),
        ),
    ),
    (
        "ERROR",
        Rule("stage_failure", r"(?i)Stage \d+.* failed|Job \d+.* failed", needs=(("tage ", "led"), ("job ", "led"))),
    ),
    (
        "ERROR",
        Rule("executor_loss", r"(?i)ExecutorLostFailure|executor\s+\d+\s+(?:lost|dead|failed)", needs=(("executor",),)),
    ),
    (
        "WARN",
        Rule(
            "data_skew",
            r"(?i)task\s+is\s+\d+x\s+slower|speculative\s+task|straggler",
            needs=(("x", "lower"), ("peculat",), ("traggler",)),
        ),
    ),
]
# Wording of the strict mode where it differs: text must stand between the number and the failure.
JVM_ISSUES_STRICT = {
    "stage_failure": Rule(
        "stage_failure", r"(?i)Stage \d+ .* failed|Job \d+ .* failed", needs=(("tage ", "led"), ("job ", "led"))
    ),
}
WARN_LINE_NEEDS = (("WARN",), ("ERROR",), ("FATAL",))
WARN_LINE = r"^(?:\[?\d[\d/:.,\-T ]*\]?\s+)?((?:WARN|ERROR|FATAL)\s+\S+:\s+.+)"
WARN_LINE_STRICT = r"^((?:WARN|ERROR|FATAL)\s+\S+:\s+.+)"

# --- Fixed values: reading limits -------------------------------------------------------------
LOG_TAIL_CHARS, SOURCE_HEAD_CHARS, JVM_TAIL_CHARS = 50_000, 30_000, 100_000
LOG_TAIL_MARK = "[...truncated to last 50000 characters...]"
SOURCE_HEAD_MARK = "[...truncated at 30000 characters...]"

# --- Fixed values: severities, most serious first ---------------------------------------------
SEVERITIES = ["CRITICAL", "ERROR", "WARNING", "WARN", "NOTE", "INFO"]

# --- Fixed values: run results ----------------------------------------------------------------
PASSED, WARNED = ["success", "pass"], ["warn"]
MESSAGE_CHARS, DEFAULT_CHARS = 1000, 30

# --- Fixed values: test inference by column name ----------------------------------------------
CATEGORY_WORDS = ["status", "type", "state", "category", "tier", "kind", "stage"]
TIME_ENDINGS = ["_at", "_date", "_time", "_ts"]
MEASURE_WORDS = ["revenue", "amount", "price", "cost", "discount", "quantity"]
COUNT_STARTS = ["total_", "count_", "num_", "n_"]
MODEL_PREFIXES = ["stg_", "int_", "fct_", "dim_", "raw_"]

# --- Fixed values: families of equal type names -----------------------------------------------
TYPE_FAMILIES: dict[str, list[str]] = {
    "int": ["integer", "int", "int4", "int8", "bigint", "smallint", "int2"],
    "string": ["character varying", "varchar", "text", "string"],
    "float": ["double precision", "float", "float8", "numeric", "decimal", "real", "float4"],
    "bool": ["boolean", "bool"],
    "ts": ["timestamp without time zone", "timestamp", "datetime"],
    "tstz": ["timestamp with time zone", "timestamptz"],
}
# Names that only Spark uses, given the type name of the same meaning above.
SPARK_TYPE_NAMES = {
    "tinyint": "smallint",
    "double": "double precision",
    "timestamp": "timestamp with time zone",
    "timestamp_ntz": "timestamp without time zone",
}

# --- Fixed values: template calls in model SQL ------------------------------------------------
TEMPLATE_BLOCK, TEMPLATE_STATEMENT = r"(?s)\{\{.*?\}\}", r"(?s)\{%.*?%\}"
REF_CALL, SOURCE_CALL = r"ref\(['\"](\w+)['\"]\)", r"source\(['\"](\w+)['\"],\s*['\"](\w+)['\"]\)"
REF_BLOCK, SOURCE_BLOCK = rf"\{{\{{\s*{REF_CALL}\s*\}}\}}", rf"\{{\{{\s*{SOURCE_CALL}\s*\}}\}}"

# --- Fixed values: accepted values in model SQL -----------------------------------------------
WHEN_EQUALS = r"(?i)WHEN\s+(\w+)\s*=\s*'([^']+)'"
IN_LIST = r"(?i)\b(\w+)\s+IN\s*\(([^)]+)\)"
QUOTED_VALUE = r"'([^']+)'"

# --- Fixed values: text of a generated contract -----------------------------------------------
CONTRACT_DESCRIPTION = "Auto-generated schema for {model}. Add descriptions."

# --- Fixed values: metrics of model SQL -------------------------------------------------------
COUNTED = {
    "with": r"(?i)\bWITH\b",
    "cte": r"(?i),\s*\w+\s+AS\s*\(",
    "join": r"(?i)\bJOIN\b",
    "select": r"(?i)\bSELECT\b",
    "distinct": r"(?i)\bDISTINCT\b",
}
SELECT_STAR = r"(?i)SELECT\s+\*"
CROSS_JOIN = r"(?i)\bCROSS\s+JOIN\b"
LEADING_WILDCARD = r"(?i)LIKE\s+'%\w"
NOT_IN_SUBQUERY = r"(?i)NOT\s+IN\s*\(\s*SELECT"
ORDER_BY, LIMIT, WHERE = r"(?i)\bORDER\s+BY\b", r"(?i)\bLIMIT\b", r"(?i)\bWHERE\b"
# (metric, most that counts, points for each) and points of a flag that is set.
SCORED_COUNTS = [("ctes", 10, 1), ("joins", 10, 2), ("subqueries", 5, 2)]
LINES_PER_POINT, MOST_LINE_POINTS = 50, 10
SCORED_FLAGS = {
    "select_star": 3,
    "cross_join": 4,
    "leading_wildcard": 2,
    "not_in_subquery": 3,
    "order_without_limit": 1,
}
MANY_JOINS, MANY_CTES = 5, 6

# --- Fixed values: lint of queries ------------------------------------------------------------
LINT_MANY_JOINS = 3
LINT_WILDCARD = r"(?i)LIKE\s+'%"
LINT_STRICT = {
    "select_star": r"(?i)SELECT(?: |\n| \n)\*",
    "leading_wildcard": r"(?i)LIKE\s+'%\w",
    "not_in_subquery": r"(?i)NOT\s+IN\s*\(SELECT",
    "cross_join": r"(?i)CROSS JOIN",
}

# Fragments without which a pattern of queries and models cannot match, see ``Rule``; a pattern without an entry needs none.
SQL_NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    COUNTED["with"]: (("th",),),
    COUNTED["cte"]: ((",", "("),),
    COUNTED["join"]: (("jo",),),
    COUNTED["select"]: (("elect",),),
    COUNTED["distinct"]: (("nct",),),
    SELECT_STAR: (("*", "elect"),),
    CROSS_JOIN: (("cro", "jo"),),
    LEADING_WILDCARD: (("'%",),),
    LINT_WILDCARD: (("'%",),),
    NOT_IN_SUBQUERY: (("(", "elect", "not"),),
    ORDER_BY: (("order", "by"),),
    WHERE: (("where",),),
    LINT_STRICT["select_star"]: (("*", "elect"),),
    LINT_STRICT["not_in_subquery"]: (("(", "elect", "not"),),
    LINT_STRICT["cross_join"]: (("cro", "jo"),),
}

# --- Fixed values: complexity labels, by least score ------------------------------------------
RISK_LABELS = [(20, "CRITICAL"), (10, "HIGH"), (5, "MEDIUM")]
HIGH_RISK_SCORE = 10

# --- Fixed values: plan texts -----------------------------------------------------------------
PLAN_SEQ_SCAN = r"Seq Scan on (\S+)"
PLAN_INDEX_SCAN = r"Index(?:\s+Only)?\s+Scan(?:\s+Backward)?\s+using\s+(\S+)"
PLAN_NESTED_LOOP = r"(?s)Nested Loop.*rows=\d{5,}"
PLAN_HASH_SPILL = r"Batches: (?:[2-9]\d*|\d{2,})"
PLAN_SORT_SPILL = r"(?i)Sort Method: external"
PLAN_ROWS = r"rows=(\d+).*?actual.*?rows=(\d+)"
PLAN_RUN_TIME, PLAN_PLANNING_TIME = r"Execution Time:\s+([\d.]+)\s+ms", r"Planning Time:\s+([\d.]+)\s+ms"
PLAN_WORDS = [
    ("table_scan", "WARNING", "TABLE SCAN"),
    ("cartesian", "WARNING", "CARTESIAN"),
    ("sort", "NOTE", "SORT"),
    ("union", "NOTE", "UNION"),
]

# --- Fixed values: workflow files -------------------------------------------------------------
DAG_ID, TASK_ID = r"dag_id\s*=\s*[\"']([^\"']+)[\"']", r"task_id\s*=\s*[\"']([^\"']+)[\"']"
OPERATOR = r"\b(\w+)\s*=\s*(\w+Operator|@task)\s*\("
CATCHUP_ON, CATCHUP_OFF = r"catchup\s*=\s*True", r"catchup\s*=\s*False"
NO_RETRIES, NO_RETRIES_STRICT = r"retries[\"']?\s*[=:]\s*0", r"retries\s*=\s*0"
SCHEDULE, NO_SCHEDULE = r"schedule(?:_interval)?\s*=\s*[\"']([^\"']+)[\"']", r"schedule_interval=None|schedule\s*=\s*None"
FLOW_DEF = r"@(?:flow|prefect\.flow)\s*(?:\([^)]*\))?\s*\ndef\s+(\w+)\s*\("
TASK_DEF = r"@(?:task|prefect\.task)\s*(?:\([^)]*\))?\s*\ndef\s+(\w+)\s*\("
FLOW_RETRIES, FLOW_SCHEDULE = r"retries\s*=\s*(\d+)", r"(?:cron|interval|rrule)\s*=\s*[\"']?([^\"',\)]+)"
NESTED_FLOW = r"@flow.*\n.*def\s+\w+.*\n(?s:.*)@flow"

# --- Fixed values: plan limits ----------------------------------------------------------------
ESTIMATE_RATIO, FAST_MS, MODERATE_MS, PLANNING_MS = 100, 100, 1000, 500
READ_ONLY_STARTS = ["SELECT", "WITH", "TABLE"]
