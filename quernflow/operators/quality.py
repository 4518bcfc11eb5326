"""Severity-based data quality: a rule passes only if it is true; NULL fails."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernflow.registry import Rule


def passes(rule: Rule, as_of: str | None = None) -> Column:
    """``{as_of}`` in a rule stands for a date literal, so results do not hang on the clock."""
    day = f"DATE'{as_of}'" if as_of else "current_date()"
    return F.coalesce(F.expr(rule.check.replace("{as_of}", day)), F.lit(False))


def _failed(rules: Sequence[Rule], severity: str, as_of: str | None) -> Column:
    names = [F.when(~passes(r, as_of), F.lit(r.name)) for r in rules if r.severity == severity]
    if not names:
        return F.array().cast("array<string>")
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def check(df: DataFrame, rules: Sequence[Rule], as_of: str | None = None) -> DataFrame:
    """Adds _dq_errors and _dq_warnings: names of the failed rules."""
    return df.select("*", _failed(rules, "ERROR", as_of).alias("_dq_errors"), _failed(rules, "WARN", as_of).alias("_dq_warnings"))


@dataclass(frozen=True)
class Split:
    valid: DataFrame
    quarantined: DataFrame
    checked: DataFrame


def split(df: DataFrame, rules: Sequence[Rule], as_of: str | None = None) -> Split:
    """Rows with an ERROR leave; rows with only warnings stay, flagged."""
    checked = check(df, rules, as_of)
    return Split(checked.where(F.size("_dq_errors") == 0), checked.where(F.size("_dq_errors") > 0), checked)


def rule_counts(checked: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_name, severity, failed_count of every rule, in one pass over the rows."""
    if not rules:
        return checked.sparkSession.createDataFrame([], "rule_name string, severity string, failed_count long")
    failed = F.concat("_dq_errors", "_dq_warnings")
    counts = checked.agg(*[F.count_if(F.array_contains(failed, r.name)).alias(r.name) for r in rules])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.col(r.name).alias("failed_count")) for r in rules])
    return counts.select(F.inline(pairs))


def failing_rules(checked: DataFrame, rules: Sequence[Rule], by: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Only the rules that at least ``least`` rows fail, by the given columns: a row per failure
    is counted and the groups are filtered by their count."""
    failed = checked.select(*by, F.explode(F.concat("_dq_errors", "_dq_warnings")).alias("rule_name"))
    counts = failed.groupBy(*by, "rule_name").agg(F.count(F.lit(1)).alias("failed_count")).where(F.col("failed_count") >= least)
    severity = F.lit(None).cast("string")
    for r in rules:
        severity = F.when(F.col("rule_name") == r.name, r.severity).otherwise(severity)
    return counts.withColumn("severity", severity)
