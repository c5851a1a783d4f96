"""Severity of free text and its rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SEVERITIES

# Fixed keyword list; the first keyword found in the message decides.
KEYWORD_SEVERITY = (
    ("error", "medium"),
    ("fail", "medium"),
    ("critical", "high"),
    ("panic", "critical"),
    ("segfault", "high"),
    ("oom-killer", "high"),
    ("killed process", "high"),
    ("out of memory", "high"),
)


def severity_from_text(message: Column) -> Column:
    """Severity of a syslog message by keyword, ``info`` when none occurs."""
    lowered = F.lower(message)
    keyword, severity = KEYWORD_SEVERITY[0]
    expr = F.when(lowered.contains(keyword), severity)
    for keyword, severity in KEYWORD_SEVERITY[1:]:
        expr = expr.when(lowered.contains(keyword), severity)
    return expr.otherwise("info")


def severity_rank(severity: Column) -> Column:
    """info 0 up to critical 4; null for anything else."""
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    position = F.array_position(ranks, severity)
    return F.when(position > 0, (position - 1).cast("int"))
