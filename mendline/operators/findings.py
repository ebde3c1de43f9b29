"""Findings of all families in one table: ``family, artifact, rule_id, severity, n, evidence``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendline.functions import rules as R

COLUMNS = ["family", "artifact", "rule_id", "severity", "n", "evidence"]


def severity_rank(severity: Column) -> Column:
    """Higher is more serious; unknown severities are 0."""
    rank = F.when(F.lit(False), 0)
    for i, name in enumerate(R.SEVERITIES):
        rank = rank.when(severity == name, len(R.SEVERITIES) - i)
    return rank.otherwise(0)


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def by_artifact(findings: DataFrame) -> DataFrame:
    """Per artifact: findings, hits and the most serious rule (first by name among equals)."""
    order = F.struct((-severity_rank(F.col("severity"))).alias("r"), F.col("rule_id").alias("rule"), F.col("severity").alias("s"))
    return (
        findings.groupBy("family", "artifact")
        .agg(F.count("*").alias("n_findings"), F.sum("n").alias("n_hits"), F.min(order).alias("worst"))
        .select("family", "artifact", "n_findings", "n_hits", F.col("worst.s").alias("worst_severity"), F.col("worst.rule").alias("worst_rule"))
    )


def by_rule(findings: DataFrame) -> DataFrame:
    """Per family, rule and severity: findings and hits."""
    return findings.groupBy("family", "rule_id", "severity").agg(
        F.count("*").alias("n_findings"), F.sum("n").alias("n_hits")
    )
