"""Profile of a corpus of model SQL: metrics, score, risk, flags, rank, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R
from mendline.functions.scale import global_rank
from mendline.functions.text import count_needing, has, has_needing, line_count, replace_all


def model_metrics(models: DataFrame) -> DataFrame:
    """Eleven metrics of each ``(path, sql)``; keywords in comments and literals count too."""
    sql = F.col("sql")
    c, folded = F.col("clean"), F.col("folded")
    # The stripped text is used by ten expressions: name it once.
    base = models.select("path", "sql", replace_all(replace_all(sql, R.TEMPLATE_BLOCK), R.TEMPLATE_STATEMENT).alias("clean"))
    base = base.select("*", F.lower("clean").alias("folded"))
    needs = lambda pattern: R.SQL_NEEDS.get(pattern, ())
    test = lambda pattern: has_needing(c, pattern, folded, needs(pattern))
    n = {name: count_needing(c, pattern, folded, needs(pattern)) for name, pattern in R.COUNTED.items()}
    return base.select(
        "path",
        line_count(sql).alias("lines"),
        (n["with"] + n["cte"]).alias("ctes"),
        n["join"].alias("joins"),
        F.greatest(n["select"] - 1, F.lit(0).cast("bigint")).alias("subqueries"),
        test(R.SELECT_STAR).alias("select_star"),
        n["distinct"].alias("distinct_count"),
        test(R.CROSS_JOIN).alias("cross_join"),
        has_needing(sql, R.LEADING_WILDCARD, sql, needs(R.LEADING_WILDCARD)).alias("leading_wildcard"),
        test(R.NOT_IN_SUBQUERY).alias("not_in_subquery"),
        (test(R.ORDER_BY) & ~has(c, R.LIMIT)).alias("order_without_limit"),
        (~test(R.WHERE)).alias("no_where"),
    )


def complexity_score() -> Column:
    """Points for capped counts, for length, for each DISTINCT and for raised flags."""
    points = F.least(F.floor(F.col("lines") / R.LINES_PER_POINT), F.lit(R.MOST_LINE_POINTS)) + F.col("distinct_count")
    for metric, most, weight in R.SCORED_COUNTS:
        points = points + F.least(F.col(metric), F.lit(most)) * weight
    for flag, weight in R.SCORED_FLAGS.items():
        points = points + F.when(F.col(flag), weight).otherwise(0)
    return points.cast("bigint")


def risk_label(score: Column) -> Column:
    label = F.when(F.lit(False), "")
    for least, name in R.RISK_LABELS:
        label = label.when(score >= least, name)
    return label.otherwise("LOW")


def profile(models: DataFrame) -> DataFrame:
    """Metrics with score and risk."""
    return model_metrics(models).withColumn("score", complexity_score()).withColumn("risk", risk_label(F.col("score")))


def flags(profiled: DataFrame) -> DataFrame:
    """``(path, flag)``, one row per flag raised. A missing WHERE counts only without joins."""
    c = F.col
    raised = [
        (c("select_star"), "select_star"),
        (c("no_where") & (c("joins") == 0), "no_where"),
        (c("order_without_limit"), "order_without_limit"),
        (c("leading_wildcard"), "leading_wildcard"),
        (c("not_in_subquery"), "not_in_subquery"),
        (c("cross_join"), "cross_join"),
        (c("joins") > R.MANY_JOINS, "many_joins"),
        (c("ctes") > R.MANY_CTES, "many_ctes"),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in raised]))
    return profiled.select("path", F.explode(found).alias("flag"))


def top_models(profiled: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest scores; ties in path order. A top-k per task, then of those."""
    return profiled.orderBy(F.desc("score"), "path").limit(n)


def ranked_models(profiled: DataFrame) -> DataFrame:
    """All models with their rank, by score and then path."""
    columns = profiled.select("path", "score", "risk", "ctes", "joins", "lines")
    return global_rank(columns, [F.desc("score"), F.asc("path")])


def project_summary(profiled: DataFrame) -> DataFrame:
    """Models, mean score to one decimal and number of high-risk models."""
    total = F.coalesce(F.sum("score"), F.lit(0)).cast("double")
    return profiled.agg(
        F.count("*").alias("n_models"),
        F.when(F.count("*") > 0, F.bround(total / F.count("*"), 1)).otherwise(0.0).alias("mean_score"),
        F.count_if(F.col("score") >= R.HIGH_RISK_SCORE).alias("n_high_risk"),
    )


def profile_findings(profiled: DataFrame) -> DataFrame:
    """Flags as findings."""
    return flags(profiled).select(
        F.lit("model").alias("family"),
        F.col("path").alias("artifact"),
        F.col("flag").alias("rule_id"),
        F.lit("WARNING").alias("severity"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("flag").alias("evidence"),
    )
