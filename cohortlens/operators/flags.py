"""A declarative rule engine: rules over a metrics table give one row for each flag raised."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"CRITICAL": 3, "WARNING": 2, "INFO": 1}


@dataclass(frozen=True)
class Rule:
    name: str
    when: Column
    severity: Column | str = "WARNING"
    details: dict[str, Column] = field(default_factory=dict)


def raise_flags(metrics: DataFrame, subject: list[str], rules: list[Rule]) -> DataFrame:
    """subject columns, flag, severity, details (JSON). All rules are tested in one pass over metrics, without a scan or a shuffle for each."""
    def one(r: Rule) -> Column:
        severity = r.severity if isinstance(r.severity, Column) else F.lit(r.severity)
        details = F.to_json(F.struct(*[v.alias(k) for k, v in r.details.items()])) if r.details else F.lit("{}")
        return F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(r.name).alias("flag"), severity.alias("severity"), details.alias("details")))

    raised = F.filter(F.array(*[one(r) for r in rules]), lambda f: f.isNotNull())
    return metrics.select(*subject, F.explode(raised).alias("f")).select(*subject, "f.flag", "f.severity", "f.details")


def severity_rank(severity: Column) -> Column:
    return reduce(lambda c, s: c.when(severity == s, SEVERITY[s]), list(SEVERITY)[1:], F.when(severity == "CRITICAL", 3)).otherwise(0)


def at_least(flags: DataFrame, floor: str) -> DataFrame:
    return flags.filter(severity_rank(F.col("severity")) >= SEVERITY[floor])
