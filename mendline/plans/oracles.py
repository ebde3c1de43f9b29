"""SQL with the meaning of each registered query, for a second engine to check the results."""

from __future__ import annotations

from mendline.functions import rules as R
from mendline.plans import corpora as C
from mendline.plans.queries import SUITE

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """A pattern as a literal, without possessive quantifiers."""
    return q(pattern.replace("*+", "*").replace("++", "+"))


def found(col: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({col}, {rx(pattern)}, {group})"


def n(col: str, pattern: str) -> str:
    return f"CAST(len({found(col, pattern)}) AS BIGINT)"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {rx(pattern)})"


def strip(col: str) -> str:
    return f"trim({col}, {WS})"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def findings(source: str, family: str, artifact: str, rules: list[tuple[str, str, str, str, str]]) -> str:
    """One row per raised rule: (rule, severity, condition, n, evidence)."""
    return union(
        [
            f"SELECT '{family}' AS family, {artifact} AS artifact, '{rule}' AS rule_id, '{severity}' AS severity, "
            f"CAST({count} AS BIGINT) AS n, {shown} AS evidence FROM {source} WHERE {test}"
            for rule, severity, test, count, shown in rules
        ]
    )


def or_no_issue(raised: str, every: str, artifact_of: str) -> str:
    """``raised`` plus a no_issue row for each artifact of ``every`` without one."""
    family = "'plan'"
    return (
        f"WITH raised AS ({raised}) SELECT * FROM raised UNION ALL SELECT {family}, {artifact_of}, 'no_issue', 'INFO', "
        f"CAST(1 AS BIGINT), '' FROM {every} s WHERE {artifact_of} NOT IN (SELECT artifact FROM raised)"
    )


SQL: dict[str, str] = {}

# --- sources ----------------------------------------------------------------------------------

_TAIL = f"CASE WHEN length(content) > 50000 THEN concat({q(R.LOG_TAIL_MARK)}, chr(10), chr(10), right(content, 50000)) ELSE content END"
_HEAD = f"CASE WHEN length(content) > 30000 THEN concat(left(content, 30000), chr(10), chr(10), {q(R.SOURCE_HEAD_MARK)}) ELSE content END"
SQL["src_head_tail_truncate"] = f"""
SELECT path, length(t) AS n_tail, md5(t) AS tail_md5, length(h) AS n_head, md5(h) AS head_md5
FROM (SELECT path, {_TAIL} AS t, {_HEAD} AS h FROM {C.LONG_FILES.sql})"""

_SCHEMAS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:int c_name:string c_nationkey:int c_acctbal:float c_mktsegment:string",
    "supplier": "s_suppkey:int s_name:string s_nationkey:int s_acctbal:float",
    "part": "p_partkey:int p_name:string p_brand:string p_type:string p_size:int p_retailprice:float",
    "orders": "o_orderkey:int o_custkey:int o_orderstatus:string o_totalprice:float o_orderdate:ts o_orderpriority:string",
    "lineitem": "l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float "
    "l_discount:float l_tax:float l_returnflag:string l_linestatus:string l_shipdate:ts",
    "events": "event_id:int ts:ts user_id:int event_type:string value:float props:string",
    "documents": "doc_id:int text:string lang:string source:string n_chars:int",
    "embeddings": "vec_id:int embedding: label:int",
    "pages": "page_id:int url:string html:string",
    "benchmark": "item_id:int text:string",
    "labels": "doc_id:int quality:int toxic:int",
    "conversations": "conv_id:int turn:int role:string text:string",
}


def _describe(table: str) -> str:
    columns = [c.split(":") for c in _SCHEMAS[table].split()]
    names = ", ".join(q(c) for c, _ in columns)
    families = ", ".join(q(f) if f else "NULL" for _, f in columns)
    nulls = ", ".join(f"count(*) - count({c})" for c, _ in columns)
    return (
        f"SELECT '{table}' AS table_name, unnest([{names}]) AS column_name, unnest([{families}]) AS family, "
        f"CAST(unnest(range(1, {len(columns) + 1})) AS BIGINT) AS ordinal, n_rows, unnest(n) AS n_nulls "
        f"FROM (SELECT count(*) AS n_rows, [{nulls}] AS n FROM {table})"
    )


SQL["src_describe_tables"] = union([_describe(t) for t in _SCHEMAS])

SQL["src_list_files"] = f"SELECT path, strlen(content) AS length FROM {C.FLOW_FILES.sql}"
SQL["src_read_models"] = f"SELECT path, name, sql FROM {C.PROJECT_MODELS.sql}"
SQL["src_read_contracts"] = """
SELECT concat('m_', s_suppkey) AS model, concat('k_', s_nationkey) AS column_name, 'integer' AS data_type, 'unique,not_null' AS tests FROM supplier
UNION ALL SELECT concat('m_', s_suppkey), 'note', NULL, '' FROM supplier WHERE s_suppkey % 3 <> 0"""
SQL["src_list_tables"] = union([f"SELECT 'given_{t}' AS table_name, 'TEMPORARY' AS kind, count(*) AS n_rows FROM {t}" for t in _SCHEMAS])
SQL["fix_write_back"] = f"""
SELECT path, CASE WHEN strpos(content, original) > 0
    THEN concat(substr(content, 1, strpos(content, original) - 1), replacement, substr(content, strpos(content, original) + length(original)))
    ELSE content END AS content,
  CASE WHEN strpos(content, original) > 0 THEN 'applied' ELSE 'not_found' END AS status
FROM {C.FLOW_FILES.sql} JOIN {C.FLOW_FIXES.sql} USING (path)"""

# --- Fixed values: patterns of the log rules, written for this engine rather than shared with the operators ----

_TRACE = r"Traceback \(most recent call last\)[^\n]*(?:\n+[^\S\n][^\n]*)*"
_LOG_PATTERNS: dict[str, list[tuple[str, str, int]]] = {
    "dbt": [
        ("compilation_error", r"Compilation Error(?s:.*)", 0),
        ("database_error", r"Database Error(?s:.*)", 0),
        ("runtime_error", r"Runtime Error(?s:.*)", 0),
        ("level_line", r"(?:ERROR|WARN)\s+.*", 0),
        ("unhandled_exception", r"Unhandled exception(?s:.*)", 0),
        ("node_error", r"(?i)node \S+ had an error|does not compile", 0),
    ],
    "airflow": [
        ("traceback", _TRACE, 0),
        ("level_line", r"(?:ERROR|CRITICAL)\s+-\s+.*", 0),
        ("task_failed", r"(?i)task\s+\S+\s+failed.*", 0),
        ("import_error", r"(?:DagBagError|ImportError):.*", 0),
        ("airflow_exception", r"AirflowException:.*", 0),
        ("pool_full", r"(?i)(?:slot|pool)\s+\S+\s+is full", 0),
    ],
    "prefect": [
        ("traceback", _TRACE, 0),
        ("level_line", r"(?:ERROR|CRITICAL)\s+.*", 0),
        ("flow_crashed", r"(?i)flow run .* crashed.*", 0),
        ("task_failed", r"(?i)task run .* failed.*", 0),
        ("crash_exception", r"CrashException:.*", 0),
    ],
    "spark": [
        ("jvm_exception", r"(?s)((?:java\.lang\.|org\.apache\.|py4j\.)\S+Exception.*?)(?:\n\s*at |\z)", 1),
        ("stack_frame", r"at [\w.$]+ \([\w.$]+\.(?:java|scala):\d+\)", 0),
        ("caused_by", r"Caused by:.*", 0),
        ("level_line", r"(?:ERROR|WARN)\s+.*", 0),
        ("engine_exception", r"(?:Analysis|Spark|Python)Exception:.*", 0),
        ("task_set_warning", r"WARN\s+TaskSetManager.*", 0),
        ("job_failed", r"(?i)job \d+ failed.*", 0),
        ("stage_failed", r"(?i)stage \d+ failed.*", 0),
        ("out_of_memory", r"(?i)outofmemoryerror.*", 0),
        ("gc_overhead", r"(?i)gc overhead limit exceeded", 0),
    ],
    "generic": [
        ("traceback", _TRACE, 0),
        ("level_line", r"(?:ERROR|CRITICAL|FATAL)\s+.*", 0),
        ("exception", r"Exception:.*", 0),
    ],
}
_HEAD_RX = r"(?:java|org\.apache|scala|com|py4j)\.\S+(?:Exception|Error)[^\n]*"
_CHAIN_RX = _HEAD_RX + r"(?:\n\s+at [^\n]+)*(?:\nCaused by:[^\n]*(?:\n\s+at [^\n]+)*)*"
_WARN_RX = r"^(?:\[?\d[\d/:.,\-T ]*\]?\s+)?((?:WARN|ERROR|FATAL)\s+\S+:\s+.+)"
# (severity, rule, pattern, pattern of the strict wording)
_ISSUES = [
    ("CRITICAL", "out_of_memory", r"(?i)outofmemoryerror|gc overhead limit exceeded|java heap space", ""),
    ("ERROR", "shuffle_failure", r"(?i)fetchfailed|shuffle\s+\S+\s+failed|shuffle fetch failed", ""),
    ("ERROR", "stage_failure", r"(?i)stage \d+.* failed|job \d+.* failed", r"(?i)stage \d+ .* failed|job \d+ .* failed"),
    ("ERROR", "executor_loss", r"(?i)executorlostfailure|executor\s+\d+\s+(?:lost|dead|failed)", ""),
    ("WARN", "data_skew", r"(?i)task\s+is\s+\d+x\s+slower|speculative\s+task|straggler", ""),
]

# --- logs -------------------------------------------------------------------------------------

_FILES = f"(SELECT path, lower(framework) AS framework, content FROM {C.LOG_FILES.sql})"


def _set_test(name: str) -> str:
    if name != "generic":
        return f"framework = '{name}'"
    return "framework NOT IN (" + ", ".join(q(s) for s in _LOG_PATTERNS if s != "generic") + ")"


_SNIPPETS = union(
    [
        f"SELECT path, framework, {no} AS rule_no, '{rule}' AS rule_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, "
        f"{strip('unnest(m)')} AS snippet "
        f"FROM (SELECT path, framework, {found('content', pattern, group)} AS m FROM {_FILES} WHERE {_set_test(name)})"
        for name, rules in _LOG_PATTERNS.items()
        for no, (rule, pattern, group) in enumerate(rules, 1)
    ]
)
SQL["log_snippets"] = _SNIPPETS
SQL["log_snippet_dedup"] = f"""
SELECT path, framework, rule_no, rule_id, pos, snippet, snippet_key, n_repeats
FROM (SELECT *, count(*) OVER (PARTITION BY path, snippet) AS n_repeats,
        row_number() OVER (PARTITION BY path, snippet ORDER BY rule_no, pos) AS rn
      FROM (SELECT *, left(snippet, 200) AS snippet_key FROM ({_SNIPPETS})))
WHERE rn = 1"""
# Read by lines, blanks in a rule stay within a line; rules over many lines see the whole text as before.
_BY_LINE = f"(SELECT path, framework, unnest(string_split(content, chr(10))) AS content FROM {_FILES})"
_LINE_SNIPPETS = union(
    [
        f"SELECT path, framework, {no} AS rule_no, '{rule}' AS rule_id, {strip('unnest(m)')} AS snippet "
        f"FROM (SELECT path, framework, {found('content', pattern, group)} AS m FROM {_FILES if many else _BY_LINE} WHERE {_set_test(name)})"
        for name, rules in _LOG_PATTERNS.items()
        for no, (rule, pattern, group) in enumerate(rules, 1)
        for many in [rule == "traceback" or "(?s" in pattern]
    ]
)
SQL["log_snippets_lines"] = f"SELECT path, framework, rule_no, rule_id, snippet, count(*) AS n FROM ({_LINE_SNIPPETS}) GROUP BY ALL"
SQL["log_snippet_dedup_lines"] = f"""
SELECT path, framework, min(rule_no) AS rule_no, arg_min(rule_id, rule_no) AS rule_id, snippet, count(*) AS n_repeats
FROM ({_LINE_SNIPPETS}) GROUP BY path, framework, snippet"""
SQL["log_paths_without_errors"] = f"SELECT path, framework FROM {_FILES} WHERE path NOT IN (SELECT path FROM ({_SNIPPETS}))"
SQL["log_snippet_topk"] = f"""
SELECT framework, rule_id, snippet, count(*) AS n_hits, count(DISTINCT path) AS n_paths
FROM ({_SNIPPETS}) GROUP BY ALL ORDER BY n_hits DESC, framework, rule_id, snippet LIMIT 20"""
SQL["log_files_without_errors"] = (
    f"SELECT path, framework FROM {_FILES} WHERE path NOT IN (SELECT path FROM ({_SNIPPETS}))"
)

_CHAINS = f"""
SELECT path, pos, chain, chain_key, n_repeats FROM (
  SELECT *, row_number() OVER (PARTITION BY path, chain ORDER BY pos) AS rn,
    count(*) OVER (PARTITION BY path, chain) AS n_repeats
  FROM (SELECT path, pos, chain, left(chain, 150) AS chain_key FROM (
    SELECT path, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos, {strip('unnest(m)')} AS chain
    FROM (SELECT path, {found('content', _CHAIN_RX)} AS m FROM {C.LOG_FILES.sql}))))
WHERE rn = 1"""
SQL["log_exception_chains"] = _CHAINS
SQL["log_chains_shown"] = f"""
SELECT path, pos, chain, rank, n_total FROM (
  SELECT path, pos, chain, row_number() OVER (PARTITION BY path ORDER BY pos) AS rank, count(*) OVER (PARTITION BY path) AS n_total
  FROM ({_CHAINS})) WHERE rank <= 5"""
SQL["log_exception_chains_lines"] = rf"""
WITH k AS (SELECT path, line_no, text, NOT regexp_matches(text, '\S') AS blank, regexp_matches(text, '^\s+at [^\n]') AS frame,
    regexp_matches(text, '^at [^\n]') AS bare, starts_with(text, 'Caused by:') AS caused, regexp_extract(text, {rx(_HEAD_RX)}) AS head
  FROM {C.LOG_LINES.sql}),
a AS (SELECT *, lag(blank, 1, false) OVER (PARTITION BY path ORDER BY line_no) AS after_blank FROM k),
h AS (SELECT *, NOT (blank OR frame OR (bare AND after_blank) OR (caused AND NOT after_blank)) AS hard FROM a),
s AS (SELECT *, coalesce(max(CASE WHEN hard THEN line_no END) OVER w, -1) AS seg,
    max(CASE WHEN head <> '' THEN line_no END) OVER w AS last_head FROM h WINDOW w AS (PARTITION BY path ORDER BY line_no)),
f AS (SELECT *, min(line_no) OVER (PARTITION BY path, seg) AS first FROM s WHERE last_head >= seg),
c AS (SELECT path, min(line_no) AS pos,
    {strip("string_agg(CASE WHEN line_no = first THEN head ELSE text END, chr(10) ORDER BY line_no)")} AS chain
  FROM f GROUP BY path, seg)
SELECT path, min(pos) AS pos, chain, left(chain, 150) AS chain_key, count(*) AS n_repeats
FROM c GROUP BY path, chain"""


def _issue_sql(strict: bool = False, files: str = C.LOG_FILES.sql, text: str = "content") -> str:
    parts = []
    for severity, name, pattern, narrow in _ISSUES:
        pattern = (narrow or pattern) if strict else pattern
        shown = "m[1]"
        if name == "stage_failure":
            shown = f"array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), chr(10))"
        source = f"(SELECT path, {found(text, pattern)} AS m FROM {files})"
        parts.append(findings(source, "log", "path", [(name, severity, "len(m) > 0", "len(m)", shown)]))
    return union(parts)


SQL["log_issue_flags"] = _issue_sql()
SQL["log_tail_issues"] = _issue_sql(files=C.LONG_LOGS.sql, text=f"right(content, 100000)")
SQL["log_stage_failures"] = f"SELECT artifact, n, evidence FROM ({_issue_sql(True)}) WHERE rule_id = 'stage_failure'"
SQL["log_warn_lines"] = f"""
SELECT path, left(line, 80) AS line_key, min(line_no) AS line_no, line, count(*) AS n_repeats
FROM (SELECT path, line_no, regexp_extract(text, {rx(_WARN_RX)}, 1) AS line FROM {C.LOG_LINES.sql} WHERE {has('text', _WARN_RX)})
GROUP BY path, line"""
SQL["log_tail_window"] = f"""
SELECT path, length(content) AS n_chars, length(t) AS n_tail_chars, length(t) - length(replace(t, chr(10), '')) AS n_tail_breaks, md5(t) AS tail_md5
FROM (SELECT path, content, right(content, 100000) AS t FROM {C.LONG_FILES.sql})"""
_DIRTY = " OR ".join(
    [has("content", _HEAD_RX), has("content", "(?m)" + _WARN_RX)] + [has("content", pattern) for _, _, pattern, _ in _ISSUES]
)
SQL["log_clean_files"] = (
    f"SELECT path FROM {C.LOG_FILES.sql} WHERE NOT ({_DIRTY})"
)
_HITS = union(
    [
        f"SELECT path, line_no, '{name}' AS rule_id, '{severity}' AS severity, regexp_extract(text, {rx(pattern)}) AS evidence "
        f"FROM l WHERE {has('text', pattern)}"
        for severity, name, pattern, _ in _ISSUES
    ]
    + [
        f"SELECT path, line_no, 'warn_line', 'WARN', regexp_extract(text, {rx(_WARN_RX)}, 1) FROM l WHERE {has('text', _WARN_RX)}"
    ]
)
SQL["log_rollup"] = f"""
WITH l AS (SELECT * FROM {C.LOG_LINES.sql})
SELECT path, rule_id, severity, count(*) AS n_hits, min(line_no) AS first_line, max(line_no) AS last_line
FROM ({_HITS}) GROUP BY path, rule_id, severity"""
SQL["log_rollup_topk"] = f"""
WITH l AS (SELECT * FROM {C.LOG_LINES.sql})
SELECT rule_id, evidence, count(*) AS n_hits, count(DISTINCT path) AS n_paths
FROM ({_HITS}) GROUP BY ALL ORDER BY n_hits DESC, rule_id, evidence LIMIT 20"""

SQL["log_rollup_heavy"] = SQL["log_rollup_topk"]
SQL["stream_rule_counts"] = f"""
WITH l AS (SELECT * FROM {C.LOG_LINES.sql}),
h AS (SELECT time_bucket(INTERVAL '5 minutes', CAST(ts AS TIMESTAMP)) AS window_start, rule_id FROM ({_HITS}) JOIN events ON line_no // 16 = event_id)
SELECT window_start, rule_id, count(*) AS n_hits FROM h
WHERE window_start + INTERVAL '5 minutes' <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL '10 minutes' GROUP BY ALL"""

# --- run artifacts ----------------------------------------------------------------------------

_KINDS = f"""(SELECT path, content, CASE WHEN NOT json_valid(content) THEN 'invalid'
  WHEN lower(path) LIKE '%run\\_results%' ESCAPE '\\' OR list_contains(json_keys(j), 'results') THEN 'run_results'
  WHEN list_contains(json_keys(j), 'nodes') OR list_contains(json_keys(j), 'sources') THEN 'manifest' ELSE 'unrecognized' END AS kind
  FROM (SELECT path, content, CASE WHEN json_valid(content) THEN content ELSE '{{}}' END AS j FROM {C.ARTIFACTS.sql}))"""
SQL["artifact_kinds"] = f"SELECT path, kind FROM {_KINDS}"
SQL["run_results_parsed"] = f"""
SELECT path AS run_id, r ->> '$.unique_id' AS unique_id, r ->> '$.status' AS status, r ->> '$.message' AS message,
  CAST(r ->> '$.execution_time' AS DOUBLE) AS execution_time
FROM (SELECT path, unnest(CAST(json_extract(content, '$.results') AS JSON[])) AS r FROM {_KINDS} WHERE kind = 'run_results')"""
_OK = "coalesce(status, '') IN ('success', 'pass')"
_WARN = "coalesce(status, '') = 'warn'"
SQL["run_summary"] = f"""
SELECT run_id, count(*) AS n_executed, count(*) FILTER ({_OK}) AS n_succeeded, count(*) FILTER ({_WARN}) AS n_warned,
  count(*) FILTER (NOT {_OK} AND NOT {_WARN}) AS n_failed
FROM {C.RUN_RESULTS.sql} GROUP BY run_id"""
SQL["run_failed_nodes"] = f"""
SELECT run_id, coalesce(unique_id, 'unknown') AS node, coalesce(status, 'unknown') AS status,
  CASE WHEN execution_time <> 0 THEN CAST(CAST(execution_time AS DECIMAL(18,2)) AS VARCHAR) END AS seconds, message
FROM {C.RUN_RESULTS.sql} WHERE NOT {_OK} AND NOT {_WARN}"""


def _part_sql(part: str) -> str:
    return f"""SELECT path, '{part}' AS part, uid, json_extract(content, '$.{part}."' || uid || '"') AS v
      FROM (SELECT path, content, unnest(json_keys(content, '$.{part}')) AS uid FROM {_KINDS} WHERE kind = 'manifest')"""


_ENTRIES = f"""(SELECT path, part, uid, v ->> '$.name' AS name, v ->> '$.resource_type' AS resource_type, v ->> '$.source_name' AS source_name,
  coalesce(CAST(json_extract(v, '$.depends_on.nodes') AS VARCHAR[]), []) AS deps
  FROM ({union([_part_sql(p) for p in ('nodes', 'sources', 'exposures')])}))"""
SQL["manifest_summary"] = f"""
SELECT path, count(*) FILTER (part = 'nodes' AND resource_type = 'model') AS n_models,
  count(*) FILTER (part = 'nodes' AND resource_type = 'test') AS n_tests,
  count(*) FILTER (part = 'sources') AS n_sources, count(*) FILTER (part = 'exposures') AS n_exposures
FROM {_ENTRIES} GROUP BY path"""
SQL["manifest_deps"] = f"""
SELECT path, string_split(uid, '.')[-1] AS model,
  CASE WHEN len(deps) = 0 THEN 'none' ELSE array_to_string(list_transform(deps, lambda d: string_split(d, '.')[-1]), ', ') END AS depends_on
FROM {_ENTRIES} WHERE part = 'nodes' AND resource_type = 'model'"""

# --- lineage ----------------------------------------------------------------------------------

SQL["lineage_edges_manifest"] = f"""
WITH e AS MATERIALIZED (SELECT *, CASE WHEN part = 'sources' THEN concat(source_name, '.', name) ELSE name END AS shown FROM {_ENTRIES}),
d AS (SELECT DISTINCT path, uid AS child_uid, shown AS child, unnest(deps) AS parent_uid FROM e WHERE part <> 'sources'),
p AS (SELECT path, uid, arg_max(shown, part) AS shown FROM e WHERE part <> 'exposures' GROUP BY path, uid)
SELECT d.path, child_uid, child, parent_uid, coalesce(p.shown, string_split(parent_uid, '.')[-1]) AS parent
FROM d LEFT JOIN p ON d.path = p.path AND d.parent_uid = p.uid"""

SQL["lineage_manifest_impact"] = f"""
WITH RECURSIVE e AS MATERIALIZED ({SQL["lineage_edges_manifest"]}),
r(path, root, node, depth) AS (SELECT DISTINCT path, child_uid, parent_uid, 1 FROM e
  UNION SELECT r.path, r.root, e.parent_uid, r.depth + 1 FROM r JOIN e ON r.path = e.path AND r.node = e.child_uid WHERE r.depth < 12),
p AS (SELECT path, root, node, min(depth) AS depth FROM r GROUP BY ALL),
s AS (SELECT path, root AS uid, TRUE AS up, depth FROM p UNION ALL SELECT path, node, FALSE, depth FROM p),
n AS (SELECT path, uid, min(name) AS name FROM (SELECT path, child_uid AS uid, child AS name FROM e UNION ALL SELECT path, parent_uid, parent FROM e) GROUP BY ALL)
SELECT s.path, s.uid, name, count(*) FILTER (up AND depth = 1) AS direct_parents, count(*) FILTER (up) AS total_ancestors,
  count(*) FILTER (NOT up AND depth = 1) AS direct_children, count(*) FILTER (NOT up) AS total_dependents
FROM s JOIN n ON s.path = n.path AND s.uid = n.uid GROUP BY ALL"""

_RX_REF = r"\{\{\s*ref\(['\"](\w+)['\"]\)\s*\}\}"
_RX_SRC = r"\{\{\s*source\(['\"](\w+)['\"],\s*['\"](\w+)['\"]\)\s*\}\}"
_SQL_EDGES = f"""(SELECT DISTINCT name AS child, parent, parent_type FROM (
  SELECT name, unnest({found('sql', _RX_REF, 1)}) AS parent, 'model' AS parent_type FROM {C.MODELS.sql}
  UNION ALL
  SELECT name, concat(regexp_extract(c, {q(_RX_SRC)}, 1), '.', regexp_extract(c, {q(_RX_SRC)}, 2)), 'source'
  FROM (SELECT name, unnest({found('sql', _RX_SRC)}) AS c FROM {C.MODELS.sql})))"""
SQL["lineage_edges_sql"] = f"SELECT * FROM {_SQL_EDGES}"
SQL["lineage_node_types"] = f"""
WITH e AS (SELECT * FROM {_SQL_EDGES}),
t AS (SELECT name, max(s) AS s FROM (SELECT name, 0 AS s FROM {C.MODELS.sql} UNION ALL SELECT child, 0 FROM e
  UNION ALL SELECT parent, CASE WHEN parent_type = 'source' THEN 1 ELSE 0 END FROM e) GROUP BY name)
SELECT name, CASE WHEN s = 1 THEN 'source' ELSE 'model' END AS type, CASE WHEN s = 1 THEN concat(name, ' [source]') ELSE name END AS label FROM t"""
SQL["lineage_upstream_depth"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.PART_EDGES.sql}),
r(root, node, depth) AS (SELECT child, parent, 1 FROM e
  UNION SELECT r.root, e.parent, r.depth + 1 FROM r JOIN e ON r.node = e.child WHERE r.depth < 3)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node"""
SQL["lineage_downstream_depth"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.SHOP_EDGES.sql}),
r(root, node, depth) AS (SELECT parent, child, 1 FROM e WHERE parent IN (SELECT concat('raw.region_', r_regionkey) FROM region)
  UNION SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON r.node = e.parent)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node"""
SQL["lineage_reach_count"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.SHOP_EDGES.sql}),
r(root, node, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT r.root, e.parent, r.depth + 1 FROM r JOIN e ON r.node = e.child),
m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
a AS (SELECT child AS root FROM e UNION SELECT parent FROM e)
SELECT a.root, count(m.node) FILTER (m.depth <= 2) AS n_within_depth, count(m.node) AS n_total FROM a LEFT JOIN m ON a.root = m.root GROUP BY a.root"""
SQL["lineage_impact"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.SHOP_EDGES.sql}),
r(root, node) AS (SELECT child, parent FROM e UNION SELECT r.root, e.parent FROM r JOIN e ON r.node = e.child),
a AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
up AS (SELECT root AS node, count(*) AS c FROM r GROUP BY root), down AS (SELECT node, count(*) AS c FROM r GROUP BY node),
dp AS (SELECT child AS node, count(*) AS c FROM e GROUP BY child), dc AS (SELECT parent AS node, count(*) AS c FROM e GROUP BY parent)
SELECT a.node, coalesce(dp.c, 0) AS direct_parents, coalesce(up.c, 0) AS total_ancestors, coalesce(dc.c, 0) AS direct_children,
  coalesce(down.c, 0) AS total_dependents
FROM a LEFT JOIN up USING (node) LEFT JOIN down USING (node) LEFT JOIN dp USING (node) LEFT JOIN dc USING (node)"""
SQL["lineage_dependents_deep"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.PART_EDGES.sql}),
r(root, node, depth) AS (SELECT parent, child, 1 FROM e WHERE parent = 'm_1'
  UNION SELECT r.root, e.child, r.depth + 1 FROM r JOIN e ON r.node = e.parent)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY root, node"""
SQL["lineage_missing_roots"] = f"""
SELECT DISTINCT concat('customer_', event_id) AS root FROM events
WHERE concat('customer_', event_id) NOT IN (SELECT child FROM {C.SHOP_EDGES.sql} UNION SELECT parent FROM {C.SHOP_EDGES.sql})"""
SQL["lineage_tree"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.SHOP_EDGES.sql}),
r(root, node, depth, path) AS (SELECT DISTINCT child, child, 0, child FROM e
  UNION ALL SELECT r.root, e.parent, r.depth + 1, concat(r.path, '/', e.parent) FROM r JOIN e ON r.node = e.child)
SELECT root, node, CAST(depth AS INTEGER) AS depth, path FROM r"""
SQL["lineage_tree_page"] = f"""
WITH RECURSIVE e AS (SELECT DISTINCT * FROM {C.SHOP_EDGES.sql}),
r(root, node, depth, path) AS (SELECT DISTINCT child, child, 0, [child] FROM e
  UNION ALL SELECT r.root, e.parent, r.depth + 1, list_append(r.path, e.parent) FROM r JOIN e ON r.node = e.child),
n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY path) AS rank, count(*) OVER (PARTITION BY root) AS n_rows FROM r)
SELECT root, rank, node, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path, n_rows FROM n WHERE rank BETWEEN 2 AND 4"""

# --- model SQL and data tests -----------------------------------------------------------------

_REF_CALL = r"ref\(['\"](\w+)['\"]\)"
_SRC_CALL = r"source\(['\"](\w+)['\"],\s*['\"](\w+)['\"]\)"
_BLOCK = r"(?s)\{\{.*?\}\}"
_STRIPPED = f"""(SELECT path, name, regexp_replace(array_to_string(list_transform(string_split_regex(sql, {q(_BLOCK)}),
    lambda p, i: concat(p, CASE WHEN b[i] IS NULL THEN '' WHEN regexp_matches(b[i], {q(_REF_CALL)}) THEN regexp_extract(b[i], {q(_REF_CALL)}, 1)
      WHEN regexp_matches(b[i], {q(_SRC_CALL)}) THEN concat(regexp_extract(b[i], {q(_SRC_CALL)}, 1), '_', regexp_extract(b[i], {q(_SRC_CALL)}, 2))
      ELSE '' END)), ''), '(?s)\\{{%.*?%\\}}', '', 'g') AS stripped
  FROM (SELECT path, name, sql, {found('sql', _BLOCK)} AS b FROM {C.MODELS.sql}))"""
SQL["jinja_strip"] = f"SELECT path, stripped FROM {_STRIPPED}"


def _folded(text: str, pattern: str, replacement: str, rounds: int = 7) -> str:
    for _ in range(rounds):
        text = f"regexp_replace({text}, {q(pattern)}, {replacement}, 'g')"
    return text


def _items(top: str) -> str:
    body = rf"regexp_extract({top}, '(?is)\bSELECT\b\s*(?:DISTINCT\b|ALL\b)?(.*?)(?:\bFROM\b|\z)', 1)"
    return f"list_transform(string_split({body}, ','), lambda x: {strip('x')})"


def _named(items: str) -> str:
    kept = f"(CASE WHEN list_contains({items}, '*') THEN {items}[1:list_position({items}, '*') - 1] ELSE {items} END)"
    name = (
        r"""coalesce(nullif(regexp_extract(x, '(?i)\bAS\s+["`]?(\w+)["`]?$', 1), ''), """
        r"""nullif(regexp_extract(x, '^(?:["`]?\w+["`]?\.)*["`]?([A-Za-z_]\w*)["`]?$', 1), ''), """
        r"""nullif(nullif(regexp_extract(x, '(?:[\w"`'']|\x01)\s+([A-Za-z_]\w*)$', 1), ''), 'end'))"""
    )
    return f"list_filter(list_transform({kept}, lambda x: {name}), lambda y: y IS NOT NULL)"


_NO_COMMENTS = r"""regexp_replace(regexp_replace(stripped, '(''[^'']*'')|--[^\n]*|/\*(?s:.*?)\*/', '\1', 'g'), '''[^'']*''', '''''', 'g')"""
_COLUMNS = f"""(
  WITH m AS (SELECT name, list_filter(string_split({_NO_COMMENTS}, ';'), lambda s: {strip('s')} <> '')[-1] AS last FROM {_STRIPPED}),
  f AS (SELECT name, {_folded('last', r'\([^()]*\)', 'chr(1)')} AS top,
    {_folded('last', r'(?i)(\bAS\s*\([^()]*\))|\([^()]*\)', "concat('\\1', chr(1))")} AS bodies FROM m),
  l AS (SELECT name, {_items('top')} AS items, {_items("regexp_extract_all(bodies, '(?i)\\bAS\\s*\\(([^()]*)\\)', 1)[-1]")} AS inner_items FROM f),
  c AS (SELECT name, list_concat({_named('items')}, CASE WHEN list_contains(items, '*') THEN coalesce({_named('inner_items')}, []) ELSE [] END) AS cols FROM l)
  SELECT name AS model, unnest(cols) AS column_name, CAST(generate_subscripts(cols, 1) AS BIGINT) AS ordinal FROM c)"""
SQL["model_columns"] = f"SELECT * FROM {_COLUMNS}"

_IN_RX = r"(?i)(\w+)\s+IN\s*\(([^)]+)\)"
_WHEN_RX = r"(?i)WHEN\s+(\w+)\s*=\s*'([^']+)'"
_HINTS = f"""(
  WITH w AS (SELECT name, {found('sql', _WHEN_RX, 1)} AS c, {found('sql', _WHEN_RX, 2)} AS v,
      {found('sql', _IN_RX, 1)} AS ic, {found('sql', _IN_RX, 2)} AS iv FROM {C.MODELS.sql}),
  p AS (SELECT name, 0 AS kind, generate_subscripts(c, 1) AS i, 1 AS j, unnest(c) AS col, unnest(v) AS val FROM w
    UNION ALL SELECT name, 1, i, generate_subscripts(vs, 1), col, unnest(vs) FROM (
      SELECT name, i, col, regexp_extract_all(l, '''([^'']+)''', 1) AS vs FROM (
        SELECT name, generate_subscripts(ic, 1) AS i, unnest(ic) AS col, unnest(iv) AS l FROM w) WHERE lower(col) <> 'not')),
  u AS (SELECT name, lower(col) AS col, val, min((kind, i, j)) AS o FROM p GROUP BY name, lower(col), val)
  SELECT name AS model, col AS column_name, string_agg(val, '|' ORDER BY o) AS accepted FROM u GROUP BY name, col)"""
SQL["accepted_value_hints"] = f"SELECT * FROM {_HINTS}"

_CANDIDATES = "[base, base || 's', rtrim(base, 's')" + "".join(
    f", '{p}' || base, '{p}' || base || 's'" for p in R.MODEL_PREFIXES
) + "]"


def _any_of(test: str, values: list[str]) -> str:
    return "(" + " OR ".join(test.format(v) for v in values) + ")"


_ROLE = f"""CASE WHEN l IN ('id', lower(model) || '_id') AND l IN ('id', model || '_id') OR starts_with(l, 'surrogate_') OR starts_with(l, 'pk_') THEN 'key'
  WHEN ends_with(l, '_id') THEN 'reference'
  WHEN {_any_of("l = '{0}' OR ends_with(l, '_{0}')", R.CATEGORY_WORDS)} THEN 'category'
  WHEN {_any_of("ends_with(l, '{0}')", R.TIME_ENDINGS)} THEN 'time'
  WHEN {_any_of("contains(l, '{0}')", R.MEASURE_WORDS)} THEN 'measure'
  WHEN l = 'email' OR ends_with(l, '_email') THEN 'email'
  WHEN {_any_of("starts_with(l, '{0}')", R.COUNT_STARTS)} OR ends_with(l, '_count') THEN 'count' ELSE 'other' END"""
_ROLES = f"(SELECT model, column_name, l, {_ROLE} AS role FROM (SELECT model, column_name, lower(column_name) AS l FROM {_COLUMNS}))"


def _targets(known: str) -> str:
    """Best candidate per reference column; ``known`` is a condition on (model, name)."""
    return f"""(SELECT model, column_name, arg_min(cand, pos) AS ref_model FROM (
      SELECT model, column_name, unnest(c) AS cand, generate_subscripts(c, 1) AS pos FROM (
        SELECT model, column_name, {_CANDIDATES} AS c FROM (
          SELECT model, column_name, left(l, length(l) - 3) AS base FROM {_ROLES} WHERE role = 'reference')))
      WHERE {known} GROUP BY model, column_name)"""


_SHARED = f"cand IN (SELECT name FROM {C.MODELS.sql})"
_FIELD = "CASE WHEN ref_model || '_id' = lower(column_name) THEN 'id' ELSE replace(lower(column_name), ref_model || '_', '') END"
SQL["fk_inference"] = f"""
SELECT r.model, r.column_name, ref_model, CASE WHEN ref_model IS NOT NULL THEN
  CASE WHEN ref_model || '_id' = r.l THEN 'id' ELSE replace(r.l, ref_model || '_', '') END END AS ref_field
FROM {_ROLES} r LEFT JOIN {_targets(_SHARED)} t ON r.model = t.model AND r.column_name = t.column_name WHERE role = 'reference'"""
_OWN = f"({_SHARED} OR (model, cand) IN (SELECT child, parent FROM {_SQL_EDGES} WHERE parent_type = 'model'))"
_TESTS = f"""(
  WITH b AS (SELECT r.model, r.column_name, role, t.ref_model, {_FIELD.replace('column_name', 'r.column_name').replace('ref_model', 't.ref_model')} AS ref_field, accepted
    FROM {_ROLES} r LEFT JOIN {_targets(_OWN)} t ON r.model = t.model AND r.column_name = t.column_name
    LEFT JOIN {_HINTS} h ON r.model = h.model AND r.l = h.column_name)
  SELECT model, column_name, 'unique' AS test, NULL AS ref_model, NULL AS ref_field, NULL AS accepted FROM b WHERE role IN ('key', 'email')
  UNION ALL SELECT model, column_name, 'not_null', NULL, NULL, NULL FROM b WHERE role <> 'other'
  UNION ALL SELECT model, column_name, 'relationships', ref_model, ref_field, NULL FROM b WHERE role = 'reference' AND ref_model IS NOT NULL
  UNION ALL SELECT model, column_name, 'accepted_values', NULL, NULL, accepted FROM b WHERE role = 'category' AND accepted IS NOT NULL)"""
SQL["test_inference"] = f"SELECT * FROM {_TESTS}"
_ITEM = """CASE WHEN test = 'relationships' THEN concat(chr(10), '          - relationships:', chr(10), '              to: "ref(''', ref_model, ''')"',
    chr(10), '              field: "', ref_field, '"')
  WHEN test = 'accepted_values' THEN concat(chr(10), '          - accepted_values:', chr(10), '              values: ["', replace(accepted, '|', '","'), '"]')
  ELSE concat(chr(10), '          - ', test) END"""
_PLACE = "list_position(['unique', 'not_null', 'relationships', 'accepted_values'], test)"
SQL["contract_text"] = f"""
WITH c AS MATERIALIZED (SELECT * FROM {_COLUMNS}),
t AS (SELECT model, column_name, string_agg(item, '' ORDER BY place) AS items FROM (
    SELECT DISTINCT model, column_name, {_PLACE} AS place, {_ITEM} AS item FROM {_TESTS}) GROUP BY model, column_name)
SELECT DISTINCT model, CAST(0 AS BIGINT) AS ordinal, concat('version: 2', chr(10), 'models:', chr(10), '  - name: "', model, '"', chr(10),
  '    description: "Auto-generated schema for ', model, '. Add descriptions."', chr(10), '    columns:') AS yaml FROM c
UNION ALL
SELECT c.model, c.ordinal, concat('      - name: "', c.column_name, '"', chr(10), '        description: ""', chr(10), '        tests:', coalesce(t.items, ' []'))
FROM c LEFT JOIN t ON c.model = t.model AND c.column_name = t.column_name"""

_ORDERS = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"
SQL["test_not_null"] = union(
    [
        f"SELECT 'orders' AS model, '{c.split(':')[0]}' AS column_name, 'not_null' AS test, count(*) AS n_rows, "
        f"count(*) - count({c.split(':')[0]}) AS n_failed FROM {_ORDERS}"
        for c in _SCHEMAS["orders"].split()
    ]
)
SQL["test_unique"] = "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"
SQL["test_accepted_values"] = (
    "SELECT event_type AS value, count(*) AS n_rows FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type"
)
SQL["test_relationships"] = (
    "SELECT o_custkey AS key, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey"
)
SQL["test_unique_words"] = "SELECT l_orderkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1"
SQL["test_relationships_words"] = (
    "SELECT l_orderkey AS key, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL"
)
SQL["test_observed_values"] = union(
    [
        f"SELECT '{c}' AS column_name, CASE WHEN count(*) <= 10 THEN string_agg(v, '|' ORDER BY v) END AS accepted FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM lineitem)"
        for c in ("l_returnflag", "l_linestatus", "l_linenumber", "l_partkey")
    ]
)


def _test_sql(t: dict, tables: dict[str, str], key: str = "o") -> str:
    model, column, test = t["model"], t["column"], t["test"]
    source = tables[model]
    head = f"SELECT '{model}' AS model, '{column}' AS column_name, '{test}' AS test, "
    status = "CASE WHEN n_failed > 0 THEN 'failed' ELSE 'passed' END AS status"
    if test == "relationships" and t["ref_model"] not in tables:
        return head + "CAST(NULL AS BIGINT) AS n_keys, CAST(NULL AS BIGINT) AS n_failed, 'not_evaluable' AS status"
    if test == "not_null":
        return f"SELECT *, {status} FROM ({head}count(*) AS n_keys, count(*) AS n_failed FROM {source} WHERE {column} IS NULL)"
    inner = {
        "unique": lambda: f"SELECT count(*) AS c FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1",
        "accepted_values": lambda: f"SELECT count(*) AS c FROM {source} WHERE {column} NOT IN ({', '.join(map(q, t['accepted']))}) GROUP BY {column}",
        "relationships": lambda: f"SELECT count(*) AS c FROM {source} WHERE {column} NOT IN (SELECT {t['ref_field']} FROM {tables[t['ref_model']]} WHERE {t['ref_field']} IS NOT NULL) GROUP BY {column}",
    }[test]()
    return f"SELECT *, {status} FROM ({head}count(*) AS n_keys, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_failed FROM ({inner}))"


_SUITE_TABLES = {"orders": _ORDERS, "lineitem": "lineitem", "customer": "(SELECT * REPLACE (CASE WHEN c_acctbal > 0 THEN c_custkey END AS c_custkey) FROM customer)"}
SQL["data_test_suite"] = union([_test_sql(t, _SUITE_TABLES) for t in SUITE])
_INFERRED = [
    ("doc", "id", "unique"),
    ("doc", "id", "not_null"),
    ("doc", "n_chars", "not_null"),
    ("label", "doc_id", "not_null"),
    ("label", "doc_id", "relationships"),
    ("page", "page_id", "unique"),
    ("page", "page_id", "not_null"),
    ("event", "event_id", "unique"),
    ("event", "event_id", "not_null"),
    ("event", "user_id", "not_null"),
    ("event", "event_type", "not_null"),
    ("part", "p_type", "not_null"),
    ("part", "p_retailprice", "not_null"),
    ("lineitem", "l_quantity", "not_null"),
    ("lineitem", "l_extendedprice", "not_null"),
    ("lineitem", "l_discount", "not_null"),
]
_INFERRED_TABLES = {
    "doc": "(SELECT doc_id AS id, n_chars FROM documents)",
    "label": "labels",
    "page": "pages",
    "event": "events",
    "part": "part",
    "lineitem": "lineitem",
}
SQL["data_tests_inferred"] = union(
    [
        _test_sql({"model": m, "column": c, "test": t, "ref_model": "doc", "ref_field": "id"}, _INFERRED_TABLES)
        for m, c, t in _INFERRED
    ]
)

# --- coverage and drift -----------------------------------------------------------------------

_CON, _LIVE, _MODELS = C.CONTRACTS.sql, C.LIVE_COLUMNS.sql, C.SQL_MODELS.sql
SQL["coverage_missing"] = f"SELECT DISTINCT name FROM {_MODELS} WHERE name NOT IN (SELECT model FROM {_CON})"
_COVERAGE = f"""(SELECT model, count("column") AS n_columns, count("column") FILTER (n_tests > 0) AS n_tested,
  count("column") FILTER (n_tests = 0) AS n_untested FROM {_CON} WHERE model IN (SELECT name FROM {_MODELS}) GROUP BY model)"""
SQL["coverage_class"] = f"SELECT *, CASE WHEN n_untested = 0 THEN 'full' ELSE 'partial' END AS coverage FROM {_COVERAGE}"
SQL["coverage_of_one_model"] = f"SELECT * FROM ({SQL['coverage_class']}) WHERE model = 'mart_1'"
SQL["coverage_untested_columns"] = (
    f'SELECT model, "column" AS column_name FROM {_CON} WHERE "column" IS NOT NULL AND n_tests = 0 AND model IN (SELECT name FROM {_MODELS})'
)
SQL["coverage_summary"] = f"""
SELECT n_models, n_entries, CAST(round_even(n_entries / n_models * 100, 0) AS BIGINT) AS schema_pct, n_tested, n_columns,
  CAST(round_even(n_tested / n_columns * 100, 0) AS BIGINT) AS column_pct
FROM (SELECT (SELECT count(DISTINCT name) FROM {_MODELS}) AS n_models, (SELECT count(DISTINCT model) FROM {_CON}) AS n_entries,
  (SELECT CAST(sum(n_tested) AS BIGINT) FROM {_COVERAGE}) AS n_tested, (SELECT CAST(sum(n_columns) AS BIGINT) FROM {_COVERAGE}) AS n_columns)"""


def _family(col: str, strict: bool) -> str:
    bare = col if strict else rf"trim(regexp_replace({col}, '\(.*\)', ''))"
    whens = " ".join(f"WHEN {bare} IN ({', '.join(map(q, names))}) THEN '{f}'" for f, names in R.TYPE_FAMILIES.items())
    return f"CASE {whens} END"


def _drift(strict: bool) -> str:
    return f"""(
  WITH d AS (SELECT model, lower("column") AS c, lower(trim(data_type)) AS dt FROM {_CON}),
  l AS (SELECT "table" AS model, lower("column") AS c, lower(trim(data_type)) AS lt FROM {_LIVE}),
  b AS (SELECT DISTINCT model FROM d WHERE model IN (SELECT model FROM l)),
  j AS (SELECT coalesce(d.model, l.model) AS model, coalesce(d.c, l.c) AS column_name, d.c AS dc, l.c AS lc, dt, lt
    FROM (SELECT * FROM d WHERE c IS NOT NULL) d FULL JOIN l ON d.model = l.model AND d.c = l.c)
  SELECT model, column_name, CASE WHEN lc IS NULL THEN 'missing' WHEN dc IS NULL THEN 'undocumented' ELSE 'type_mismatch' END AS category,
    dt AS declared_type, lt AS live_type
  FROM j WHERE model IN (SELECT model FROM b) AND (lc IS NULL OR dc IS NULL OR (dt IS NOT NULL AND dt <> lt
    AND NOT coalesce({_family('dt', strict)} = {_family('lt', strict)}, false))))"""


SQL["drift_columns"] = f"SELECT * FROM {_drift(False)}"
SQL["drift_columns_strict"] = f"SELECT * FROM {_drift(True)}"
SQL["drift_summary"] = f"""
WITH m AS (SELECT model, count(*) FILTER (category = 'missing') AS a, count(*) FILTER (category = 'undocumented') AS b,
    count(*) FILTER (category = 'type_mismatch') AS c, count(*) AS n FROM {_drift(False)} GROUP BY model)
SELECT d.model, coalesce(a, 0) AS n_missing, coalesce(b, 0) AS n_undocumented, coalesce(c, 0) AS n_type_mismatch, coalesce(n, 0) AS n_total,
  CASE WHEN d.model NOT IN (SELECT "table" FROM {_LIVE}) THEN 'unreadable' WHEN n > 0 THEN 'drift' ELSE 'clean' END AS status
FROM (SELECT DISTINCT model FROM {_CON}) d LEFT JOIN m ON d.model = m.model"""
SQL["drift_unknown_models"] = f"SELECT DISTINCT name AS model FROM {_MODELS} WHERE name NOT IN (SELECT model FROM {_CON})"

# --- SQL corpus and plans ---------------------------------------------------------------------

_METRICS = rf"""(SELECT path, length(sql) - length(replace(sql, chr(10), '')) + CASE WHEN ends_with(sql, chr(10)) THEN 0 ELSE 1 END AS lines,
  {n('c', r'(?i)\bWITH\b')} + {n('c', r'(?i),\s*\w+\s+AS\s*\(')} AS ctes, {n('c', r'(?i)\bJOIN\b')} AS joins,
  greatest({n('c', r'(?i)\bSELECT\b')} - 1, 0) AS subqueries, {has('c', r'(?i)SELECT\s+\*')} AS select_star,
  {n('c', r'(?i)\bDISTINCT\b')} AS distinct_count, {has('c', r'(?i)\bCROSS\s+JOIN\b')} AS cross_join,
  {has('sql', r"(?i)LIKE\s+'%\w")} AS leading_wildcard, {has('c', r'(?i)NOT\s+IN\s*\(\s*SELECT')} AS not_in_subquery,
  {has('c', r'(?i)\bORDER\s+BY\b')} AND NOT {has('c', r'(?i)\bLIMIT\b')} AS order_without_limit, NOT {has('c', r'(?i)\bWHERE\b')} AS no_where
  FROM (SELECT path, sql, regexp_replace(regexp_replace(sql, '(?s)\{{\{{.*?\}}\}}', '', 'g'), '(?s)\{{%.*?%\}}', '', 'g') AS c FROM {C.MODELS.sql}))"""
SQL["sql_metrics"] = f"SELECT * FROM {_METRICS}"
_PROFILE = f"""(SELECT *, CASE WHEN score >= 20 THEN 'CRITICAL' WHEN score >= 10 THEN 'HIGH' WHEN score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM (SELECT *, CAST(least(ctes, 10) + 2 * least(joins, 10) + 2 * least(subqueries, 5) + least(lines // 50, 10) + distinct_count
    + 3 * CAST(select_star AS INT) + 4 * CAST(cross_join AS INT) + 2 * CAST(leading_wildcard AS INT) + 3 * CAST(not_in_subquery AS INT)
    + CAST(order_without_limit AS INT) AS BIGINT) AS score FROM {_METRICS}))"""
SQL["sql_score_risk"] = f"SELECT path, score, risk FROM {_PROFILE}"
_FLAGS = {
    "select_star": "select_star",
    "no_where": "no_where AND joins = 0",
    "order_without_limit": "order_without_limit",
    "leading_wildcard": "leading_wildcard",
    "not_in_subquery": "not_in_subquery",
    "cross_join": "cross_join",
    "many_joins": "joins > 5",
    "many_ctes": "ctes > 6",
}
_FLAG_SQL = union([f"SELECT path, '{flag}' AS flag FROM p WHERE {test}" for flag, test in _FLAGS.items()])
SQL["sql_flags"] = f"WITH p AS (SELECT * FROM {_PROFILE}) {_FLAG_SQL}"
SQL["sql_rank_topn"] = f"SELECT path, score, risk FROM {_PROFILE} ORDER BY score DESC, path LIMIT 10"
SQL["sql_rank_all"] = f"SELECT row_number() OVER (ORDER BY score DESC, path) AS rank, path, score FROM {_PROFILE}"
SQL["sql_summary"] = f"""
SELECT count(*) AS n_models, round_even(sum(score) / count(*), 1) AS mean_score, count(*) FILTER (score >= 10) AS n_high_risk FROM {_PROFILE}"""

_BARE = r"""regexp_replace(sql, '(''[^'']*'')|--[^\n]*|/\*(?s:.*?)\*/', '\1', 'g')"""
_MASKED = f"""regexp_replace({_BARE}, '''[^'']*''', '''''', 'g')"""
_PARTS = f"""list_filter(string_split({_MASKED}, ';'), lambda s: {strip('s')} <> '')"""
_STATEMENTS = rf"""(SELECT query_id, sql, bare, masked, stmt_no, {strip('stmt')} AS stmt, CASE WHEN word NOT IN ('SELECT', 'WITH') THEN word
    WHEN regexp_matches(stmt, '(?i)\b(?:UNION|INTERSECT|EXCEPT)\b') THEN 'UNION' ELSE 'SELECT' END AS kind
  FROM (SELECT *, upper(regexp_extract(stmt, '^[\s(]*(\w+)', 1)) AS word
    FROM (SELECT query_id, sql, {_BARE} AS bare, {_MASKED} AS masked, unnest(p) AS stmt, CAST(generate_subscripts(p, 1) AS BIGINT) AS stmt_no
      FROM (SELECT query_id, sql, {_PARTS} AS p FROM {C.QUERIES.sql}))))"""
SQL["sql_statements"] = f"SELECT query_id, stmt_no, kind FROM {_STATEMENTS}"
_NO_FUNCTIONS = ", ".join(
    map(q, "IN AND OR NOT EXISTS SELECT ANY ALL SOME VALUES WHERE ON THEN WHEN ELSE AS".split())
)
_CALLS = (
    r"len(list_filter(regexp_extract_all(regexp_extract(stmt, '(?is)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\z)', 1), "
    rf"'\b([A-Za-z_]\w*)\s*\(', 1), lambda w: upper(w) NOT IN ({_NO_FUNCTIONS})))"
)
_SEL = "kind = 'SELECT' AND "
_SUBQ = f"({n('stmt', r'(?i)\(\s*SELECT\b')} - {n('stmt', r'(?i)\b(?:AS|IN|EXISTS)\s*\(\s*SELECT\b')})"
_LINT_RULES = [
    ("select_star", "WARNING", has("masked", r"(?i)SELECT\s+\*"), "1"),
    ("no_where", "NOTE", _SEL + "NOT " + has("stmt", r"(?i)\bWHERE\b"), "1"),
    ("many_joins", "NOTE", _SEL + n("stmt", r"(?i)\bJOIN\b") + " > 3", n("stmt", r"(?i)\bJOIN\b")),
    ("subqueries", "NOTE", _SEL + _SUBQ + " > 0", _SUBQ),
    ("distinct", "NOTE", _SEL + has("stmt", r"(?i)\bDISTINCT\b"), "1"),
    ("order_without_limit", "WARNING", _SEL + has("stmt", r"(?i)\bORDER\s+BY\b") + " AND NOT " + has("stmt", r"(?i)\bLIMIT\b"), "1"),
    ("function_in_where", "WARNING", _SEL + _CALLS + " > 0", "1"),
    ("leading_wildcard", "WARNING", has("bare", r"(?i)LIKE\s+'%"), "1"),
    ("not_in_subquery", "WARNING", has("masked", r"(?i)NOT\s+IN\s*\(\s*SELECT"), "1"),
    ("cross_join", "WARNING", has("masked", r"(?i)CROSS\s+JOIN"), "1"),
]
_SHOWN = "concat(kind, ' ', stmt_no)"
SQL["sql_lint"] = f"""
WITH s AS MATERIALIZED (SELECT * FROM {_STATEMENTS}),
r AS ({findings('s', 'query', 'query_id', [(rule, sev, test, count, _SHOWN) for rule, sev, test, count in _LINT_RULES])})
SELECT * FROM r UNION ALL
SELECT 'query', query_id, 'no_issue', 'INFO', CAST(1 AS BIGINT), {_SHOWN} FROM s WHERE (query_id, {_SHOWN}) NOT IN (SELECT artifact, evidence FROM r)"""
SQL["plan_readonly_guard"] = rf"""
SELECT query_id, starts_with(s, 'SELECT') OR starts_with(s, 'WITH') OR starts_with(s, 'TABLE') AS allowed
FROM (SELECT query_id, upper(regexp_replace({strip('sql')}, '^\(+', '')) AS s FROM {C.QUERIES.sql})"""

_PG = f"(SELECT * FROM {C.PLANS.sql} WHERE engine = 'postgres')"
_SNOW = f"(SELECT query_id, upper(plan_text) AS u FROM {C.PLANS.sql} WHERE trim(engine) = 'Snowflake')"


def _distinct(list_: str) -> str:
    return f"array_to_string(list_filter({list_}, lambda x, i: list_position({list_}, x) = i), ', ')"


_PAIR = r"rows=(\d+).*?actual.*?rows=(\d+)"
_PG_READ = rf"""(SELECT query_id, plan_text, {found('plan_text', r'Seq Scan on (\S+)', 1)} AS seq,
  {found('plan_text', r'Index(?:\s+Only)?\s+Scan(?:\s+Backward)?\s+using\s+(\S+)', 1)} AS ix,
  list_filter(list_zip(CAST({found('plan_text', _PAIR, 1)} AS BIGINT[]), CAST({found('plan_text', _PAIR, 2)} AS BIGINT[])),
    lambda p: p[1] > 0 AND p[2] > 0 AND greatest(p[1], p[2]) >= 100 * least(p[1], p[2]))[1] AS off,
  TRY_CAST(nullif(regexp_extract(plan_text, 'Execution Time:\s+([\d.]+)\s+ms', 1), '') AS DOUBLE) AS run_ms,
  TRY_CAST(nullif(regexp_extract(plan_text, 'Planning Time:\s+([\d.]+)\s+ms', 1), '') AS DOUBLE) AS plan_ms FROM {_PG})"""
_PG_RAISED = findings(
    _PG_READ,
    "plan",
    "query_id",
    [
        ("sequential_scan", "WARNING", "len(seq) > 0", "1", _distinct("seq")),
        ("nested_loop", "WARNING", has("plan_text", r"(?s)Nested Loop.*rows=\d{5,}"), "1", "''"),
        ("hash_spill", "WARNING", has("plan_text", r"Batches: [2-9]\d*|Batches: \d{2,}"), "1", "''"),
        ("sort_spill", "WARNING", has("plan_text", r"(?i)Sort Method: external"), "1", "''"),
        ("row_estimate", "WARNING", "off IS NOT NULL", "1", "concat(off[1], ' estimated, ', off[2], ' actual')"),
        ("index_scan", "INFO", "len(ix) > 0", "1", _distinct("ix")),
        (
            "execution_time",
            "INFO",
            "run_ms IS NOT NULL",
            "1",
            "concat(CAST(run_ms AS DECIMAL(18,2)), ' ms ', CASE WHEN run_ms < 100 THEN 'fast' WHEN run_ms < 1000 THEN 'moderate' ELSE 'slow' END)",
        ),
        ("planning_time", "WARNING", "plan_ms > 500", "1", "concat(CAST(plan_ms AS DECIMAL(18,2)), ' ms')"),
    ],
)
_SNOW_RAISED = findings(
    _SNOW,
    "plan",
    "query_id",
    [
        (rule, sev, f"contains(u, '{word}')", "1", f"'{word}'")
        for rule, sev, word in [
            ("table_scan", "WARNING", "TABLE SCAN"),
            ("cartesian", "WARNING", "CARTESIAN"),
            ("sort", "NOTE", "SORT"),
            ("union", "NOTE", "UNION"),
        ]
    ],
)
SQL["plan_lint_postgres"] = or_no_issue(_PG_RAISED, _PG, "query_id")
SQL["plan_lint_snowflake"] = or_no_issue(_SNOW_RAISED, _SNOW, "query_id")

# --- workflow files ---------------------------------------------------------------------------

_DAG = C.DAG_FILES.sql
_BROKEN = "contains(content, 'def broken(:')"
SQL["dag_syntax"] = f"SELECT path, NOT {_BROKEN} AS ok, CASE WHEN {_BROKEN} THEN CAST(5 AS BIGINT) END AS line_no FROM {_DAG}"


def _inventory(source: str, kinds: list[tuple[str, str, str]]) -> str:
    return union(
        [
            f"SELECT path, '{kind}' AS kind, CAST(generate_subscripts(a, 1) AS BIGINT) AS pos, unnest(a) AS name, unnest(b) AS detail "
            f"FROM (SELECT path, {names} AS a, {details} AS b FROM {source})"
            for kind, names, details in kinds
        ]
    )


def _none(names: str) -> str:
    return f"list_transform({names}, lambda x: CAST(NULL AS VARCHAR))"


_IDS = found("content", r"dag_id\s*=\s*[\"']([^\"']+)[\"']", 1)
_TASKS = found("content", r"task_id\s*=\s*[\"']([^\"']+)[\"']", 1)
_OP = r"(\w+)\s*=\s*(\w+Operator|@task)\s*\("
SQL["dag_inventory"] = _inventory(
    f"(SELECT * FROM {_DAG} WHERE NOT {_BROKEN})",
    [
        ("dag", _IDS, _none(_IDS)),
        ("operator", found("content", _OP, 1), found("content", _OP, 2)),
        ("task", _TASKS, _none(_TASKS)),
    ],
)
_CHAIN_LINES = f"""(SELECT path, line_no, {strip('line')} AS chain FROM (
  SELECT path, CAST(generate_subscripts(l, 1) AS BIGINT) AS line_no, unnest(l) AS line
  FROM (SELECT path, string_split(content, chr(10)) AS l FROM {_DAG} WHERE NOT {_BROKEN}))
  WHERE contains(line, '>>') AND NOT starts_with({strip('line')}, '#'))"""
SQL["dag_chains"] = f"SELECT * FROM {_CHAIN_LINES}"
SQL["dag_chain_edges"] = rf"""
WITH s AS (SELECT path, line_no, string_split(regexp_replace(chain, '#.*$', ''), '>>') AS s FROM {_CHAIN_LINES}),
p AS (SELECT path, line_no, generate_subscripts(s, 1) AS pos, unnest(s) AS step FROM s),
t AS (SELECT path, line_no, pos, unnest(string_split(regexp_replace(step, '[\[\]]', '', 'g'), ',')) AS raw FROM p),
u AS (SELECT path, line_no, pos, {strip('raw')} AS task FROM t WHERE {strip('raw')} <> '')
SELECT DISTINCT c.path, c.task AS child, p.task AS parent FROM u p JOIN u c ON p.path = c.path AND p.line_no = c.line_no AND c.pos = p.pos + 1"""
_SCHEDULE = r"nullif(regexp_extract(content, 'schedule(?:_interval)?\s*=\s*[\"'']([^\"'']+)[\"'']', 1), '')"
_DAG_RULES = findings(
    f"(SELECT * FROM {_DAG} WHERE NOT {_BROKEN})",
    "workflow",
    "path",
    [
        ("catchup_on", "WARNING", has("content", r"catchup\s*=\s*True"), "1", "'catchup=True'"),
        ("catchup_not_off", "NOTE", "NOT " + has("content", r"catchup\s*=\s*False"), "1", "'catchup not set to False'"),
        ("no_retries", "NOTE", has("content", r"retries[\"']?\s*[=:]\s*0"), "1", "'retries=0'"),
        (
            "schedule",
            "INFO",
            f"NOT contains(content, 'schedule_interval=None') AND NOT {has('content', r'schedule\s*=\s*None')} AND {_SCHEDULE} IS NOT NULL",
            "1",
            _SCHEDULE,
        ),
    ],
)
SQL["dag_rules"] = _DAG_RULES
_FLOW = f"(SELECT * FROM {C.FLOW_FILES.sql} WHERE NOT {_BROKEN})"


def _defined(name: str) -> str:
    return found("content", rf"@(?:{name}|prefect\.{name})\s*(?:\([^)]*\))?\s*\ndef\s+(\w+)\s*\(", 1)


_FLOW_KINDS = [
    ("flow", _defined("flow")),
    ("task", _defined("task")),
    ("retries", found("content", r"retries\s*=\s*(\d+)", 1)),
    ("schedule", found("content", r"(?:cron|interval|rrule)\s*=\s*[\"']?([^\"',\)]+)", 1)),
]
SQL["flow_inventory"] = (
    f"SELECT path, kind, pos, {strip('name')} AS name FROM ({_inventory(_FLOW, [(k, f, _none(f)) for k, f in _FLOW_KINDS])})"
)
SQL["flow_rules"] = findings(
    _FLOW,
    "workflow",
    "path",
    [
        ("submit_without_result", "NOTE", "contains(content, 'submit') AND NOT contains(content, '.result()')", "1", "'submit'"),
        ("nested_flow", "WARNING", has("content", r"@flow.*\n.*def\s+\w+.*\n(?s:.*)@flow"), "1", "'@flow'"),
        ("raise_on_failure", "NOTE", "contains(content, 'raise_on_failure')", "1", "'raise_on_failure'"),
    ],
)

# --- fixes and the union of findings ----------------------------------------------------------

_FLOW_AFTER = f"(SELECT path, content FROM ({SQL['fix_write_back']}))"
SQL["findings_updated"] = f"""
SELECT *, (SELECT count(*) FROM supplier) AS n_first, (SELECT count(*) FROM ({SQL['fix_write_back']}) WHERE status = 'applied') AS n_second
FROM ({SQL["flow_rules"].replace(C.FLOW_FILES.sql, _FLOW_AFTER)})"""


def _fixed(fixes: str, texts: str) -> str:
    """Fixes, of which a file has one here, met with the texts: their status and the text after them."""
    return f"""(SELECT f.path, original, replacement, content IS NULL AS missing, instr(content, original) AS pos,
      CASE WHEN content IS NULL THEN 'file_missing' WHEN instr(content, original) = 0 THEN 'not_found'
        WHEN original = replacement THEN 'identical' ELSE 'applied' END AS status,
      CASE WHEN content IS NULL OR instr(content, original) = 0 OR original = replacement THEN content
        ELSE concat(substr(content, 1, instr(content, original) - 1), replacement, substr(content, instr(content, original) + length(original))) END AS after
      FROM {fixes} f LEFT JOIN {texts} d ON f.path = d.path)"""


_FIRST = _fixed(C.FIXES.sql, C.DOC_FILES.sql)
_LATER = _fixed(C.LATER_FIXES.sql, f"(SELECT path, after AS content FROM {_FIRST})")
SQL["fix_apply"] = union(
    [
        f"SELECT path, CAST({k} AS BIGINT) AS position, original, replacement, status FROM {part}"
        for k, part in ((1, _FIRST), (2, _LATER))
    ]
)
SQL["fix_texts"] = f"""
SELECT a.path, md5(b.after) AS content_md5, CAST((a.status = 'applied')::INT + (b.status = 'applied')::INT AS BIGINT) AS n_applied
FROM {_FIRST} a JOIN {_LATER} b ON a.path = b.path WHERE a.status = 'applied' OR b.status = 'applied'"""
_RUN = f"""SELECT 'run' AS family, run_id AS artifact, CASE WHEN w THEN 'node_warned' ELSE 'node_failed' END AS rule_id,
  CASE WHEN w THEN 'WARN' ELSE 'ERROR' END AS severity, count(*) AS n, min(unique_id) AS evidence
  FROM (SELECT *, {_WARN} AS w FROM {C.RUN_RESULTS.sql} WHERE NOT {_OK}) GROUP BY run_id, w"""
_DRIFT = f"""SELECT 'drift', model, category, CASE WHEN category = 'undocumented' THEN 'WARNING' ELSE 'ERROR' END, count(*), min(column_name)
  FROM {_drift(False)} GROUP BY model, category"""
_PROFILED = f"SELECT 'model', path, flag, 'WARNING', CAST(1 AS BIGINT), flag FROM (WITH p AS (SELECT * FROM {_PROFILE}) {_FLAG_SQL})"
_CHAIN_FOUND = f"""SELECT 'log' AS family, path AS artifact, 'exception_chain' AS rule_id, 'ERROR' AS severity, CAST(sum(n_repeats) AS BIGINT) AS n,
  arg_min(chain_key, pos) AS evidence FROM ({_CHAINS}) GROUP BY path"""
_UNPARSED = union(
    [
        f"SELECT 'workflow' AS family, path AS artifact, 'syntax_error' AS rule_id, 'ERROR' AS severity, CAST(1 AS BIGINT) AS n, '' AS evidence FROM {c.sql} WHERE {_BROKEN}"
        for c in (C.DAG_FILES, C.FLOW_FILES)
    ]
)
_FAILED = f"""SELECT 'test' AS family, concat_ws('.', model, column_name) AS artifact, test AS rule_id, 'ERROR' AS severity, n_failed AS n, '' AS evidence
  FROM ({SQL['data_test_suite']}) WHERE n_failed > 0"""
_ALL = union(
    [
        f"SELECT * FROM ({part})"
        for part in (
            _issue_sql(), _RUN, _DRIFT, _PROFILED, SQL["sql_lint"], SQL["plan_lint_postgres"], SQL["plan_lint_snowflake"],
            _DAG_RULES, SQL["flow_rules"], _CHAIN_FOUND, _UNPARSED, _FAILED,
        )
    ]
)
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(R.SEVERITIES)) + " ELSE 99 END"
SQL["findings_by_artifact"] = f"""
SELECT family, artifact, count(*) AS n_findings, CAST(sum(n) AS BIGINT) AS n_hits, arg_min(severity, (r, rule_id)) AS worst_severity,
  arg_min(rule_id, (r, rule_id)) AS worst_rule FROM (SELECT *, {_RANK} AS r FROM ({_ALL})) GROUP BY family, artifact"""
SQL["findings_by_rule"] = f"""
SELECT family, rule_id, severity, count(*) AS n_findings, CAST(sum(n) AS BIGINT) AS n_hits FROM ({_ALL}) GROUP BY family, rule_id, severity"""
