"""Inventory and rules of workflow definitions: DAG and flow files as rows ``(path, content)``."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendline.functions import rules as R
from mendline.functions.text import first_hit, has, hits, strip

_SYNTAX = (
    T.StructType().add("ok", T.BooleanType()).add("lineno", T.IntegerType()).add("message", T.StringType()).add("text", T.StringType())
)


@F.pandas_udf(_SYNTAX)
def _check_syntax(sources: pd.Series) -> pd.DataFrame:
    def check(source: str) -> tuple:
        try:
            ast.parse(source or "")
            return True, None, None, None
        except SyntaxError as e:
            return False, e.lineno, e.msg, e.text
        except (ValueError, RecursionError, MemoryError) as e:  # a null character, or too deep for the parser
            return False, None, str(e), None

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        checked = [check(s) for s in sources]
    rows = pd.DataFrame(checked, columns=["ok", "lineno", "message", "text"])
    return rows.astype({"ok": bool, "lineno": "Int32"})


def syntax(files: DataFrame) -> DataFrame:
    """``(path, ok, lineno, message, text)``. Only the Python parser can tell, so this is a vectorised UDF."""
    return files.select("path", _check_syntax("content").alias("s")).select("path", "s.*")


def valid_files(files: DataFrame) -> DataFrame:
    """Files that parse; the others give their syntax finding and nothing else."""
    return files.withColumn("_s", _check_syntax("content")).filter("_s.ok").drop("_s")


def _rows(files: DataFrame, kinds: list[tuple[str, Column]]) -> DataFrame:
    """``(path, kind, pos, name, detail)`` from arrays of (name, detail) structs."""
    arrays = F.array(*[F.struct(F.lit(kind).alias("kind"), found.alias("found")) for kind, found in kinds])
    return (
        files.select("path", F.explode(arrays).alias("k"))
        .select("path", "k.kind", F.posexplode("k.found").alias("pos", "f"))
        .select("path", "kind", (F.col("pos") + 1).cast("bigint").alias("pos"), "f.name", "f.detail")
    )


def _plain(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x.alias("name"), F.lit(None).cast("string").alias("detail")))


def dag_inventory(files: DataFrame) -> DataFrame:
    """DAG ids, operator assignments (variable and type) and task ids of files that parse, in order of occurrence."""
    files, src = valid_files(files), F.col("content")
    operators = F.zip_with(
        hits(src, R.OPERATOR, 1), hits(src, R.OPERATOR, 2), lambda v, t: F.struct(v.alias("name"), t.alias("detail"))
    )
    return _rows(
        files,
        [
            ("dag", _plain(hits(src, R.DAG_ID, 1))),
            ("operator", operators),
            ("task", _plain(hits(src, R.TASK_ID, 1))),
        ],
    )


def dag_chains(files: DataFrame) -> DataFrame:
    """``(path, line_no, chain)``: lines with ``>>`` that are no comment, of files that parse."""
    lines = valid_files(files).select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("line_no", "line"))
    chain = strip(F.col("line"))
    return lines.filter(F.contains("line", F.lit(">>")) & ~F.startswith(chain, F.lit("#"))).select(
        "path", (F.col("line_no") + 1).cast("bigint").alias("line_no"), chain.alias("chain")
    )


def chain_edges(chains: DataFrame) -> DataFrame:
    """``(path, child, parent)``: neighbours in a chain; ``[a, b]`` stands for each of its tasks."""
    steps = F.transform(
        F.split(F.regexp_replace("chain", r"#.*$", ""), ">>"),
        lambda s: F.filter(F.transform(F.split(F.regexp_replace(s, r"[\[\]]", ""), ","), strip), lambda t: t != ""),
    )
    pairs = F.flatten(
        F.zip_with(
            F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))),
            F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))),
            lambda a, b: F.flatten(F.transform(a, lambda p: F.transform(b, lambda c: F.struct(c.alias("child"), p.alias("parent"))))),
        )
    )
    return (
        chains.select("path", steps.alias("steps")).select("path", F.explode(pairs).alias("e")).select("path", "e.*").distinct()
    )


def _raise(files: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    found = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), shown.alias("evidence")))
                for rule, severity, test, shown in rules
            ]
        )
    )
    return files.select("path", F.explode(found).alias("f")).select(
        F.lit("workflow").alias("family"),
        F.col("path").alias("artifact"),
        "f.rule_id",
        "f.severity",
        F.lit(1).cast("bigint").alias("n"),
        "f.evidence",
    )


def dag_rules(files: DataFrame, strict: bool = False) -> DataFrame:
    """Catch-up, retries and schedule notes of files that parse.

    ``strict`` sees ``retries`` only as a keyword argument, not in a dict. A file that does not parse has its syntax finding
    (``syntax_findings``) and no other.
    """
    return _raise(valid_files(files), _dag_rules(strict))


def dag_findings(files: DataFrame, strict: bool = False) -> DataFrame:
    """``dag_rules`` and ``syntax_findings`` together; every file is parsed once."""
    return _parsed_findings(files, _dag_rules(strict))


def _dag_rules(strict: bool) -> list[tuple[str, str, Column, Column]]:
    src = F.col("content")
    retries = R.NO_RETRIES_STRICT if strict else R.NO_RETRIES
    schedule = first_hit(src, R.SCHEDULE)
    scheduled = ~has(src, R.NO_SCHEDULE) & schedule.isNotNull()
    return [
        ("catchup_on", "WARNING", has(src, R.CATCHUP_ON), F.lit("catchup=True")),
        ("catchup_not_off", "NOTE", ~has(src, R.CATCHUP_OFF), F.lit("catchup not set to False")),
        ("no_retries", "NOTE", has(src, retries), F.lit("retries=0")),
        ("schedule", "INFO", scheduled, schedule),
    ]


def flow_inventory(files: DataFrame) -> DataFrame:
    """Flows, tasks, retry numbers and schedules of flow files that parse, in order of occurrence."""
    files, src = valid_files(files), F.col("content")
    return _rows(
        files,
        [
            ("flow", _plain(hits(src, R.FLOW_DEF, 1))),
            ("task", _plain(hits(src, R.TASK_DEF, 1))),
            ("retries", _plain(hits(src, R.FLOW_RETRIES, 1))),
            ("schedule", _plain(hits(src, R.FLOW_SCHEDULE, 1))),
        ],
    )


def flow_rules(files: DataFrame) -> DataFrame:
    """Unawaited submits, nested flows and raised failures of files that parse."""
    return _raise(valid_files(files), _flow_rules())


def flow_findings(files: DataFrame) -> DataFrame:
    """``flow_rules`` and ``syntax_findings`` together; every file is parsed once."""
    return _parsed_findings(files, _flow_rules())


def _flow_rules() -> list[tuple[str, str, Column, Column]]:
    src = F.col("content")
    unawaited = F.contains(src, F.lit("submit")) & ~F.contains(src, F.lit(".result()"))
    return [
        ("submit_without_result", "NOTE", unawaited, F.lit("submit")),
        ("nested_flow", "WARNING", has(src, R.NESTED_FLOW), F.lit("@flow")),
        ("raise_on_failure", "NOTE", F.contains(src, F.lit("raise_on_failure")), F.lit("raise_on_failure")),
    ]


def _parsed_findings(files: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """The rules of the files that parse, the syntax finding of the others."""
    ok = F.col("_s.ok")
    guarded = [(rule, severity, ok & test, shown) for rule, severity, test, shown in rules]
    return _raise(files.withColumn("_s", _check_syntax("content")), [*guarded, ("syntax_error", "ERROR", ~ok, _syntax_evidence("_s."))])


def syntax_findings(files: DataFrame) -> DataFrame:
    """Files that do not parse, as findings."""
    return (
        syntax(files)
        .filter("not ok")
        .select(
            F.lit("workflow").alias("family"),
            F.col("path").alias("artifact"),
            F.lit("syntax_error").alias("rule_id"),
            F.lit("ERROR").alias("severity"),
            F.lit(1).cast("bigint").alias("n"),
            _syntax_evidence().alias("evidence"),
        )
    )


def _syntax_evidence(of: str = "") -> Column:
    return F.concat_ws(": ", F.concat(F.lit("line "), F.col(f"{of}lineno").cast("string")), F.col(f"{of}message"))
