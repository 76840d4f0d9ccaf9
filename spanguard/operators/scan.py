"""Scan of texts: detect, merge, decide, redact - one stage, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanguard.functions import policy as P
from spanguard.functions.spans import (
    merge_overlaps,
    needs_semantic,
    redact,
    redaction_counts,
)
from spanguard.functions.text import empty, regex_findings, round_exact_sql
from spanguard.operators.models import Detector
from spanguard.operators.rules import Policy, overlay_rule, resolve_rules
from spanguard.schema import COUNTS, FINDING, FINDINGS


TEXT = "_text"  # the scanned column under a name no lambda variable shadows


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds `value` as the one element of a generator.

    A filter on a plain computed column is pushed below it with the expression
    inlined, so the scan would run again for every mention. It stays above a
    generator, while filters on the other columns still reach the source.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def find_pattern(df: DataFrame, entity_type: str, text_col: str = "text") -> DataFrame:
    """`findings` of one built-in pattern."""
    found = F.coalesce(regex_findings(TEXT, [entity_type]), empty(FINDINGS))
    return once(df.withColumn(TEXT, F.col(text_col)), "findings", found).drop(TEXT)


def detect(
    df: DataFrame, text_col: str = "text", detectors: Sequence[Detector] = ()
) -> DataFrame:
    """Adds `raw_findings` of all passes, `detector_errors` (how many passes
    failed on the row) and `detectors_used`.

    Slow passes get a null text where the fast ones were conclusive: a Python
    step runs for every row it is given, so the saving has to be in its input.
    """
    text = F.col(TEXT)
    df = once(df.withColumn(TEXT, F.col(text_col)), "raw_findings", regex_findings(TEXT))
    errors = F.lit(0)
    for d in sorted(detectors, key=lambda d: d.slow):
        out, given = f"_{d.name}", TEXT
        if d.slow:
            given = "_unsure_text"
            df = df.withColumn(given, F.when(needs_semantic("raw_findings"), text))
        df = d.run(df, given, out).withColumn(
            "raw_findings", F.concat("raw_findings", d.findings(TEXT, out))
        )
        errors = errors + F.col(f"{out}.error").isNotNull().cast("int")
    return (
        df.withColumn("detector_errors", errors)
        .withColumn("detectors_used", active_detectors(detectors))
        .drop(TEXT, "_unsure_text", *[f"_{d.name}" for d in detectors])
    )


def active_detectors(detectors: Sequence[Detector] = ()) -> Column:
    return F.array(F.lit("regex"), *[F.lit(d.name) for d in detectors])


def scan(
    df: DataFrame,
    policy: Policy | None = None,
    text_col: str = "text",
    is_output: bool = False,
    detectors: Sequence[Detector] = (),
) -> DataFrame:
    """Adds `findings` (all, merged), `actionable` (those a rule applies to,
    with its action), `decision`, `reasons`, `redacted_text` and
    `redaction_counts` (of the actionable findings).
    """
    policy = policy or Policy()
    extra = {d.name: d.priority for d in detectors}
    df = detect(df, text_col, detectors)
    df = once(df, "findings", merge_overlaps("raw_findings", extra))
    df = df.drop("raw_findings")
    return evaluate(df, policy, text_col, is_output)


def evaluate(
    df: DataFrame, policy: Policy, text_col: str = "text", is_output: bool = False
) -> DataFrame:
    """The policy and redaction half of `scan` on a `findings` column."""
    acts = P.actionable(
        "findings",
        "_rules",
        is_output,
        policy.output_scanning,
        policy.secret_action,
    )
    hit, text = F.col("decision") != "ALLOW", F.col(TEXT)
    redacted, counts = redact(TEXT, "actionable"), redaction_counts("actionable")
    no_counts = F.create_map().cast(COUNTS)
    df = df.withColumns({TEXT: F.col(text_col), "_rules": policy.rule_map()})
    return (
        once(df, "actionable", acts)
        .withColumns({"decision": P.decide("actionable"), "reasons": P.reasons("actionable")})
        .withColumns(
            {
                "redacted_text": F.when(hit, redacted).otherwise(text),
                "redaction_counts": F.when(hit, counts).otherwise(no_counts),
            }
        )
        .drop("_rules", TEXT)
    )


def reported(spans: str = "findings") -> Column:
    """Findings as a scan reports them: confidence to three decimals."""
    fields = [
        f"{round_exact_sql('f.confidence', 3)} as confidence"
        if n == "confidence"
        else f"f.{n} as {n}"
        for n in FINDING.fieldNames()
    ]
    return F.expr(f"transform({spans}, f -> struct({', '.join(fields)}))")


def long_findings(df: DataFrame, *keys: str, column: str = "findings") -> DataFrame:
    """One row per finding. Rows without findings are dropped after the
    generator, so that no size filter evaluates the scan a second time.
    """
    return (
        df.select(*keys, F.explode_outer(column).alias("f"))
        .filter(F.col("f.entity_type").isNotNull())
        .select(*keys, "f.*")
    )


def dry_run(
    df: DataFrame, rules: DataFrame, candidate: DataFrame, text_col: str = "text"
) -> DataFrame:
    """Scan under the live rules with a candidate rule laid over them, next to
    the decision under the live rules alone. Findings are computed once.
    """
    live = resolve_rules(rules)
    base = Policy(rules=live, resolved=True)
    trial = Policy(rules=overlay_rule(live, candidate), resolved=True)
    df = once(detect(df, text_col), "findings", merge_overlaps("raw_findings"))
    df = df.drop("raw_findings", "detector_errors")
    df = evaluate(df, base, text_col).withColumn("baseline", F.col("decision"))
    df = df.drop("actionable", "decision", "reasons", "redacted_text", "redaction_counts")
    df = evaluate(df, trial, text_col)
    return df.withColumn("changed", F.col("decision") != F.col("baseline"))
