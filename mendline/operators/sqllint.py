"""Lint of a query log ``queries(query_id, sql)``, by token rules on text without comments and literals.

Approximations against a parser: comma joins are not counted as joins, a bracketed SELECT after AS, IN or EXISTS
is not a subquery, and only ``name(`` is a function call.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.text import FLAGS, count_needing, has, has_needing, hits, replace_all, strip
from mendline.operators.modelsql import mask_literals, strip_comments

# Words that may stand before a bracket without being a function.
NO_FUNCTIONS = ["IN", "AND", "OR", "NOT", "EXISTS", "SELECT", "ANY", "ALL", "SOME", "VALUES", "WHERE", "ON", "THEN", "WHEN", "ELSE", "AS"]


def statements(queries: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """``(query_id, stmt_no, stmt, kind)``: one row per statement.

    ``flags`` are columns over the whole query (``sql``, ``bare``, ``masked``), computed once before it is cut into statements.

    ``bare`` is the query without comments, ``masked`` also without the text of literals. ``kind`` is SELECT (also with CTEs), UNION for set operations, or the leading keyword.
    """
    return _statements(queries, flags).drop("folded")


def _statements(queries: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """``statements`` with ``folded``, the statement in lower case."""
    sql, bare = F.col("sql"), F.col("bare")
    commented = F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*"))
    uncommented = queries.select("query_id", "sql", F.when(commented, strip_comments(sql)).otherwise(sql).alias("bare"))
    masked = uncommented.select("*", F.when(F.contains(bare, F.lit("'")), mask_literals(bare)).otherwise(bare).alias("masked"))
    each = F.transform(F.split("masked", ";"), lambda s: F.struct(s.alias("raw"), strip(s).alias("stmt"), F.lower(s).alias("folded")))
    named = flags or {}
    whole = masked.select("query_id", F.filter(each, lambda s: s["stmt"] != "").alias("parts"), *[c.alias(n) for n, c in named.items()])
    # Of a plain column, Spark would test the size below the scan, and so take the texts apart twice.
    some = F.when(F.size("parts") > 0, F.col("parts"))
    rows = whole.select("query_id", *named, F.posexplode(some).alias("stmt_no", "s")).select("query_id", *named, "stmt_no", "s.*")
    rows = rows.withColumn("word", F.upper(F.nullif(F.regexp_extract("raw", FLAGS + r"^[\s(]*(\w+)", 1), F.lit(""))))
    word = F.col("word")
    set_op = has_needing(F.col("raw"), r"(?i)\b(?:UNION|INTERSECT|EXCEPT)\b", F.col("folded"), (("un",), ("nter",), ("except",)))
    kind = F.when(word.isin("SELECT", "WITH"), F.when(set_op, "UNION").otherwise("SELECT")).otherwise(word)
    return rows.select("query_id", *named, (F.col("stmt_no") + 1).cast("bigint").alias("stmt_no"), "stmt", kind.alias("kind"), "folded")


def statement_counts(queries: DataFrame) -> DataFrame:
    """Statements and their kinds per query."""
    s = statements(queries)
    return s.groupBy("query_id").agg(
        F.count("*").alias("n_statements"),
        F.count_if(F.col("kind") == "SELECT").alias("n_selects"),
        F.count_if(F.col("kind") == "UNION").alias("n_set_operations"),
    )


def lint(queries: DataFrame, strict: bool = False) -> DataFrame:
    """Hints per statement as findings; a statement without any gets ``no_issue``.

    Text rules look at the whole query and so repeat for each of its statements. ``strict`` applies them to
    the raw text, comments included, in their narrow wording.
    """
    stmt, folded = F.col("stmt"), F.col("folded")
    select = F.col("kind") == "SELECT"
    text = F.col("sql") if strict else F.col("masked")
    quoted = F.col("sql") if strict else F.col("bare")
    where = F.regexp_extract(
        stmt, r"(?Udis)\bWHERE\b(.*?)(?:\bGROUP\s+BY\b|\bORDER\s+BY\b|\bHAVING\b|\bLIMIT\b|\z)", 1
    )
    called = F.contains(folded, F.lit("where")) & F.contains(folded, F.lit("("))
    calls = F.filter(hits(where, r"\b([A-Za-z_]\w*)\s*\(", 1), lambda w: ~F.upper(w).isin(NO_FUNCTIONS))
    test = lambda pattern: has_needing(stmt, pattern, folded, R.SQL_NEEDS.get(pattern, ()))
    nested = lambda pattern: count_needing(stmt, pattern, folded, (("(", "elect"),))
    counts = {
        "joins": count_needing(stmt, R.COUNTED["join"], folded, R.SQL_NEEDS[R.COUNTED["join"]]),
        "subqueries": nested(r"(?i)\(\s*SELECT\b") - nested(r"(?i)\b(?:AS|IN|EXISTS)\s*\(\s*SELECT\b"),
    }
    joins, subqueries = F.col("joins"), F.col("subqueries")
    default = {
        "select_star": R.SELECT_STAR,
        "leading_wildcard": R.LINT_WILDCARD,
        "not_in_subquery": R.NOT_IN_SUBQUERY,
        "cross_join": R.CROSS_JOIN,
    }
    wording = R.LINT_STRICT if strict else default
    texts = {name: quoted if name == "leading_wildcard" else text for name in wording}
    # What a wildcard needs has no letters.
    lowered = {name: c if name == "leading_wildcard" else F.lower(c) for name, c in texts.items()}
    flags = {name: has_needing(texts[name], p, lowered[name], R.SQL_NEEDS.get(p, ())) for name, p in wording.items()}
    one = F.lit(1).cast("bigint")
    rules: list[tuple[str, str, Column, Column]] = [
        ("select_star", "WARNING", F.col("select_star"), one),
        ("no_where", "NOTE", select & ~test(R.WHERE), one),
        ("many_joins", "NOTE", select & (joins > R.LINT_MANY_JOINS), joins),
        ("subqueries", "NOTE", select & (subqueries > 0), subqueries),
        ("distinct", "NOTE", select & test(R.COUNTED["distinct"]), one),
        (
            "order_without_limit",
            "WARNING",
            select & test(R.ORDER_BY) & ~has(stmt, R.LIMIT),
            one,
        ),
        ("function_in_where", "WARNING", select & called & (F.size(calls) > 0), one),
        ("leading_wildcard", "WARNING", F.col("leading_wildcard"), one),
        ("not_in_subquery", "WARNING", F.col("not_in_subquery"), one),
        ("cross_join", "WARNING", F.col("cross_join"), one),
    ]
    # The tests are columns of their own: what a generator is given is not compiled.
    tests = [F.coalesce(met, F.lit(False)).alias(f"is_{rule}") for rule, _, met, _ in rules]
    hint = lambda rule, severity, n: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), n.alias("n"))
    found = [F.when(F.col(f"is_{rule}"), hint(rule, severity, n)) for rule, severity, _, n in rules]
    nothing = F.when(~reduce(or_, [F.col(f"is_{rule}") for rule, *_ in rules]), hint("no_issue", "INFO", one))
    return (
        _statements(queries, flags)
        .select("*", *[n.alias(name) for name, n in counts.items()])
        .select("query_id", "stmt_no", "kind", *counts, *tests)
        .select("query_id", "stmt_no", "kind", F.explode(F.array_compact(F.array(*found, nothing))).alias("f"))
        .select(
            F.lit("query").alias("family"),
            F.col("query_id").alias("artifact"),
            "f.rule_id",
            "f.severity",
            "f.n",
            F.concat(F.col("kind"), F.lit(" "), F.col("stmt_no").cast("string")).alias("evidence"),
        )
    )


def read_only(queries: DataFrame) -> DataFrame:
    """``(query_id, allowed)``: whether a query starts, after opening brackets, as a reading statement."""
    start = F.upper(replace_all(strip(F.col("sql")), r"^\(+"))
    allowed = F.lit(False)
    for word in R.READ_ONLY_STARTS:
        allowed = allowed | F.startswith(start, F.lit(word))
    return queries.select("query_id", allowed.alias("allowed"))
