"""Lint of a plan log ``plans(query_id, engine, plan_text)``. All rules are projections of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.text import FLAGS, first_hit, has, has_needing, hits, plain_decimal


def _observe(plans: DataFrame, rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    hint = lambda rule, severity, shown: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), shown.alias("evidence"))
    # The evidence is a column of its own, null for a rule that is not met: what a generator is given is not compiled.
    shown = [F.when(test, text(evidence)).alias(f"rule_{i}") for i, (_, _, test, evidence) in enumerate(rules)]
    met = [F.col(f"rule_{i}") for i in range(len(rules))]
    found = [F.when(c.isNotNull(), hint(rule, severity, c)) for c, (rule, severity, _, _) in zip(met, rules)]
    nothing = F.when(F.coalesce(*met).isNull(), hint("no_issue", "INFO", F.lit("")))
    return plans.select("query_id", *shown).select("query_id", F.explode(F.array_compact(F.array(*found, nothing))).alias("f")).select(
        F.lit("plan").alias("family"),
        F.col("query_id").alias("artifact"),
        "f.rule_id",
        "f.severity",
        F.lit(1).cast("bigint").alias("n"),
        "f.evidence",
    )


def lint_postgres(plans: DataFrame) -> DataFrame:
    """Scans, joins, spills, row estimates and times of Postgres plan texts."""
    return _observe(_read_postgres(plans), _postgres_rules())


def _read_postgres(plans: DataFrame, *keep: str) -> DataFrame:
    """What the rules of Postgres plans look at; each pattern runs only on texts that can match."""
    plan = F.col("plan_text")
    none = F.array().cast("array<string>")
    if_any = lambda fragment, found: F.when(~F.contains(plan, F.lit(fragment)), none).otherwise(found)
    seq = F.array_distinct(hits(plan, R.PLAN_SEQ_SCAN, 1))
    index = if_any("Index", F.array_distinct(hits(plan, R.PLAN_INDEX_SCAN, 1)))
    number = lambda s: s.cast("decimal(38,0)")
    # The text is searched once; the two numbers are the digits that a match begins and ends with.
    est = lambda m: number(F.regexp_extract(m, FLAGS + r"^rows=(\d+)", 1))
    act = lambda m: number(F.substring_index(m, "rows=", -1))
    pairs = F.transform(if_any("actual", hits(plan, R.PLAN_ROWS)), lambda m: F.struct(est(m).alias("est"), act(m).alias("act")))
    off = F.get(
        F.filter(
            pairs,
            lambda p: (p["est"] > 0)
            & (p["act"] > 0)
            & (F.greatest(p["est"], p["act"]) >= F.least(p["est"], p["act"]) * R.ESTIMATE_RATIO),
        ),
        F.lit(0),
    )
    run_ms = first_hit(plan, R.PLAN_RUN_TIME).try_cast("double")
    plan_ms = first_hit(plan, R.PLAN_PLANNING_TIME).try_cast("double")
    return plans.select(
        "query_id",
        "plan_text",
        *keep,
        F.lower(plan).alias("folded"),
        seq.alias("seq"),
        index.alias("index"),
        off.alias("off"),
        run_ms.alias("run_ms"),
        plan_ms.alias("plan_ms"),
    )


def _postgres_rules() -> list[tuple[str, str, Column, Column]]:
    c, plan = F.col, F.col("plan_text")
    speed = F.when(c("run_ms") < R.FAST_MS, "fast").when(c("run_ms") < R.MODERATE_MS, "moderate").otherwise("slow")
    estimate = F.concat(
        c("off.est").cast("string"), F.lit(" estimated, "), c("off.act").cast("string"), F.lit(" actual")
    )
    return [
        ("sequential_scan", "WARNING", F.size("seq") > 0, F.array_join("seq", ", ")),
        ("nested_loop", "WARNING", F.contains(plan, F.lit("Nested Loop")) & has(plan, R.PLAN_NESTED_LOOP), F.lit("")),
        ("hash_spill", "WARNING", has(plan, R.PLAN_HASH_SPILL), F.lit("")),
        ("sort_spill", "WARNING", has_needing(plan, R.PLAN_SORT_SPILL, c("folded"), (("ort method: external",),)), F.lit("")),
        ("row_estimate", "WARNING", c("off").isNotNull(), estimate),
        ("index_scan", "INFO", F.size("index") > 0, F.array_join("index", ", ")),
        ("execution_time", "INFO", c("run_ms").isNotNull(), F.concat(plain_decimal(c("run_ms")), F.lit(" ms "), speed)),
        ("planning_time", "WARNING", c("plan_ms") > R.PLANNING_MS, F.concat(plain_decimal(c("plan_ms")), F.lit(" ms"))),
    ]


def lint_snowflake(plans: DataFrame) -> DataFrame:
    """Full scans, Cartesian products, sorts and unions named in Snowflake plan texts, in any letter case."""
    return _observe(plans.select("query_id", F.upper("plan_text").alias("upper")), _snowflake_rules())


def _snowflake_rules() -> list[tuple[str, str, Column, Column]]:
    return [(rule, severity, F.contains("upper", F.lit(w)), F.lit(w)) for rule, severity, w in R.PLAN_WORDS]


def lint_plans(plans: DataFrame) -> DataFrame:
    """Plans of both engines, each by the rules of its ``engine`` (``postgres``, ``snowflake`` or ``snow``). The plans are read once."""
    engine, plan = F.lower(F.trim("engine")), F.col("plan_text")
    # No rule is met by a missing text, so each engine has its own texts only.
    of_one = plans.filter(engine.isin("postgres", "snowflake", "snow")).select(
        "query_id", F.when(engine == "postgres", plan).alias("plan_text"), F.when(engine != "postgres", F.upper(plan)).alias("upper")
    )
    return _observe(_read_postgres(of_one, "upper"), [*_postgres_rules(), *_snowflake_rules()])
