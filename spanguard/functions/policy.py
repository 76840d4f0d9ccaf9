"""Helpers that turn findings into a decision. String arguments are SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanguard.functions.text import fixed2_sql
from spanguard.schema import FINDING, SEVERITY

_LEVELS = "array(" + ", ".join(f"'{s}'" for s in SEVERITY) + ")"


def severity_sql(action: str) -> str:
    """1 for ALLOW, 2 for MASK, 3 for BLOCK; unknown and null count as ALLOW."""
    return f"greatest(1, cast(array_position({_LEVELS}, {action}) as int))"


def severity(action: str) -> Column:
    return F.expr(severity_sql(action))


def action_of(rank: str) -> Column:
    return F.expr(f"element_at({_LEVELS}, coalesce({rank}, 1))")


def actionable(
    spans: str,
    rules: str,
    is_output: bool = False,
    output_scanning: bool = True,
    secret_action: str = "MASK",
) -> Column:
    """Findings whose type has a rule and whose confidence reaches it, each with
    the rule's action. On output a BLOCK rule acts as `secret_action`.
    """
    rule = f"try_element_at({rules}, f.entity_type)"
    action = f"{rule}.action"
    if is_output and output_scanning:
        action = f"if({action} = 'BLOCK', '{secret_action}', {action})"
    fields = ", ".join(f"f.{n} as {n}" for n in FINDING.fieldNames())
    return F.expr(
        f"transform(filter({spans}, f -> coalesce(f.confidence >= {rule}.min_confidence, false)),"
        f" f -> struct({fields}, {action} as action))"
    )


def max_severity(acts: str) -> Column:
    ranks = f"transform({acts}, a -> {severity_sql('a.action')})"
    return F.expr(f"coalesce(array_max({ranks}), 1)")


def decide(acts: str) -> Column:
    ranks = f"transform({acts}, a -> {severity_sql('a.action')})"
    return action_of(f"array_max({ranks})")


def reasons(acts: str) -> Column:
    return F.expr(
        f"transform({acts}, a -> concat(a.action, ': ', a.entity_type,"
        f" ' detected (confidence=', {fixed2_sql('a.confidence')},"
        " ', detector=', a.detector, ')'))"
    )


def effective_decision(
    input_decision: str = "input_decision", output_decision: str = "output_decision"
) -> Column:
    """The worse of both decisions, lower-cased; null counts as ALLOW."""
    worst = f"greatest({severity_sql(input_decision)}, {severity_sql(output_decision)})"
    return F.lower(action_of(worst))
