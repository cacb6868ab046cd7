"""Severities, device profiles and the rule detector, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From most to least severe.
LEVELS = ("critical", "high", "medium", "low", "informational")
TERMINAL = ("resolved", "false_positive")


def assess(prediction: Column, confidence: Column, behaves_oddly: Column) -> Column:
    """Severity of a scored flow; `behaves_oddly`: whether its device profile is violated."""
    quiet = (prediction == "normal") & ~behaves_oddly
    return F.when(quiet, "informational").when((confidence >= 0.9) | behaves_oddly, "critical").when(confidence >= 0.75, "high").otherwise("medium")


def reasons(prediction: Column, confidence: Column, more: Column) -> Column:
    """An array: how sure the model is, then the reasons that others gave. What is normal to the
    model and to them has no reasons."""
    said = F.concat(F.lit("model predicted "), prediction, F.format_string(" with %.1f%% confidence", F.round(confidence * 100, 1)))
    quiet = (prediction == "normal") & (F.size(more) == 0)
    return F.when(quiet, F.array().cast("array<string>")).otherwise(F.concat(F.array(said), more))


def sensor_severity(priority: Column) -> Column:
    return F.when(priority == 1, "critical").when(priority == 2, "high").when(priority == 3, "medium").otherwise("low")


def rank(severity: Column) -> Column:
    """4 for critical down to 0; null for what isn't a severity."""
    out = F.lit(None).cast("int")
    for i, level in enumerate(LEVELS):
        out = F.when(severity == level, len(LEVELS) - 1 - i).otherwise(out)
    return out


def from_rank(rank_: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in reversed(LEVELS)]), rank_)


def rule_score(syn: Column, rst: Column, packets_per_second: Column) -> Column:
    """The attack score of the rule detector."""
    part = lambda c, scale, most: F.least(c / scale, F.lit(most))
    return F.least(F.lit(0.99), 0.02 + part(syn, 100, 0.55) + part(rst, 100, 0.2) + part(packets_per_second, 100_000, 0.2))


def rule_label(score: Column) -> Column:
    return F.when(score >= 0.5, "attack").otherwise("normal")
