"""The rule table: seed, validation, resolution, changes and paging."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanguard.functions.spans import category_of
from spanguard.operators.paging import keyset_page
from spanguard.schema import (
    CATEGORY_OF,
    DEFAULT_MIN_CONFIDENCE,
    DEFAULT_RULES,
    ENTITY_TYPES,
    POLICY_ID,
    RULE_MAP,
    SEVERITY,
)
from spanguard.sources.versions import newest_version, read_version, write_version

EPOCH = datetime(2024, 1, 1)
RULE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "name", "description", "entity_type", "category", "action")]
    + [T.StructField("min_confidence", T.DoubleType()), T.StructField("enabled", T.BooleanType())]
    + [T.StructField(n, T.TimestampType()) for n in ("created_at", "updated_at")]
)
POLICY_BYTES = 1 << 20  # read on the driver


def rules_frame(spark: SparkSession, rules, created_at: datetime = EPOCH) -> DataFrame:
    """Rule rows from (entity_type, action, min_confidence) triples."""
    rows = [(e, CATEGORY_OF[e], a, float(c), created_at) for e, a, c in rules]
    return spark.createDataFrame(
        rows,
        "entity_type string, category string, action string, "
        "min_confidence double, created_at timestamp",
    ).select(
        F.md5(F.concat(F.lit("rule|"), "entity_type")).alias("id"),
        F.concat("entity_type", F.lit(" default")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        "entity_type",
        "category",
        "action",
        "min_confidence",
        F.lit(True).alias("enabled"),
        "created_at",
        F.col("created_at").alias("updated_at"),
    )


def default_rules(spark: SparkSession, created_at: datetime = EPOCH) -> DataFrame:
    return rules_frame(spark, DEFAULT_RULES, created_at)


def read_rules(
    spark: SparkSession, path: str, created_at: datetime = EPOCH
) -> tuple[DataFrame, Policy]:
    """Rules and globals of a policy file (YAML: policy_id, rules, output_scanning)."""
    import yaml

    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > POLICY_BYTES:
        raise ValueError(f"a policy file may have {POLICY_BYTES} bytes, not {size}")
    config = yaml.safe_load(b"\n".join(bytes(r.content) for r in files.orderBy("path").collect()))
    rules = rules_frame(
        spark,
        [
            (
                r["entity_type"],
                r["action"],
                r.get("min_confidence", DEFAULT_MIN_CONFIDENCE),
            )
            for r in config["rules"]
        ],
        created_at,
    )
    scanning = config.get("output_scanning") or {}
    return rules, Policy(
        rules=rules,
        policy_id=config["policy_id"],
        output_scanning=scanning.get("enabled", True),
        secret_action=scanning.get("secret_action", "MASK"),
    )


def seed_rules(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """The seed rows when the table is empty, the table itself otherwise."""
    return seed if rules.limit(1).isEmpty() else rules


def validate_rules(df: DataFrame) -> DataFrame:
    """Adds `errors` (names of broken checks) and `valid`."""
    checks = {
        "name": F.length("name") >= 1,
        "entity_type": F.col("entity_type").isin(ENTITY_TYPES),
        "action": F.upper("action").isin(SEVERITY),
        "min_confidence": F.col("min_confidence").between(0.0, 1.0),
    }
    broken = F.array(
        *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]
    )
    return df.withColumn("errors", F.array_compact(broken)).withColumn(
        "valid", F.size("errors") == 0
    )


def resolve_rules(rules: DataFrame) -> DataFrame:
    """One enabled rule per known entity type: the one updated last."""
    return (
        rules.filter(F.col("enabled") & F.col("entity_type").isin(ENTITY_TYPES))
        .groupBy("entity_type")
        .agg(
            F.max_by(
                F.struct("action", "min_confidence"), F.struct("updated_at", "id")
            ).alias("rule")
        )
        .select("entity_type", "rule.action", "rule.min_confidence")
    )


def overlay_rule(resolved: DataFrame, candidate: DataFrame) -> DataFrame:
    """Resolved rules with the candidate's types replaced, enabled or not."""
    change = candidate.select("entity_type", "action", "min_confidence")
    return resolved.join(change, "entity_type", "left_anti").unionByName(change)


def rule_map(resolved: DataFrame) -> Column:
    """The resolved table (at most one row per entity type, so 11) as a single
    map value that every scan task reads; no join is needed.
    """
    entry = F.struct("entity_type", F.struct("action", "min_confidence"))
    return (
        resolved.filter(F.col("entity_type").isin(ENTITY_TYPES))
        .agg(F.map_from_entries(F.collect_list(entry)).cast(RULE_MAP).alias("rules"))
        .scalar()
    )


def default_rule_map() -> Column:
    entries = ", ".join(
        f"'{e}', struct('{a}' as action, {float(c)!r}D as min_confidence)"
        for e, a, c in DEFAULT_RULES
    )
    return F.expr(f"map({entries})")


@dataclass
class Policy:
    """Settings of a scan. `rules` is a rule table; None means the defaults."""

    rules: DataFrame | None = None
    policy_id: str = POLICY_ID
    output_scanning: bool = True
    secret_action: str = "MASK"
    resolved: bool = False

    def rule_map(self) -> Column:
        if self.rules is None:
            return default_rule_map()
        return rule_map(self.rules if self.resolved else resolve_rules(self.rules))


_COLUMNS = ["name", "description", "entity_type", "action", "min_confidence", "enabled"]


def upsert_rules(rules: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The next version of the rule table.

    `changes` holds `op` (create, patch or delete) and the rule columns; a patch
    leaves a column alone where its value is null. Changes of one id apply in the
    order of `seq`, if there is such a column: what came before a delete is gone,
    and a patch of an id that isn't there changes nothing. A new type brings its
    category along, and actions are stored upper-case.
    """
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    folded = changes.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(seq.alias("seq"), "op", *_COLUMNS))).alias("c")
    )
    old = rules.select("id", F.struct("*").alias("o"))
    steps = {
        "gone": "coalesce(array_max(transform(c, (x, i) -> if(x.op = 'delete', i + 1, 0))), 0)",
        "base": "o is not null and gone = 0",
        "after": "slice(c, gone + 1, size(c))",
        "start": "if(base, 1, coalesce(array_position(transform(after, x -> x.op), 'create'), 0))",
        "live": "if(start > 0, slice(after, cast(start as int), size(after)), null)",
    }
    joined = old.join(folded, "id", "full_outer")
    for name, expression in steps.items():
        joined = joined.withColumn(name, F.expr(expression))

    def changed(column: str) -> Column:
        return F.expr(f"try_element_at(filter(transform(live, x -> x.{column}), v -> v is not null), -1)")

    def pick(column: str) -> Column:
        return F.coalesce(changed(column), F.when(F.col("base"), F.col("o")[column]))

    kept = joined.filter(F.col("base") | (F.col("start") > 0))
    created = F.when(F.col("base"), F.col("o.created_at"))
    untouched = F.col("base") & (F.coalesce(F.size("live"), F.lit(0)) <= 0)
    return kept.select(
        "id",
        pick("name").alias("name"),
        pick("description").alias("description"),
        pick("entity_type").alias("entity_type"),
        F.when(changed("entity_type").isNotNull(), category_of(changed("entity_type")))
        .otherwise(F.col("o.category"))
        .alias("category"),
        F.upper(pick("action")).alias("action"),
        F.coalesce(pick("min_confidence"), F.lit(DEFAULT_MIN_CONFIDENCE)).alias("min_confidence"),
        F.coalesce(pick("enabled"), F.lit(True)).alias("enabled"),
        F.coalesce(created, as_of).alias("created_at"),
        F.when(untouched, F.col("o.updated_at")).otherwise(as_of).alias("updated_at"),
    )


def write_rule_version(rules: DataFrame, path: str, base: int = 0) -> int:
    """Write a rule table as the version after `base`; VersionConflict if there is one already."""
    return write_version(rules.select(RULE.fieldNames()), path, base)


def read_rule_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rule table as of a version, by default the newest; empty if there is none."""
    return read_version(spark, path, RULE, version)


def commit_rules(spark: SparkSession, path: str, changes: DataFrame, as_of: Column, base: int | None = None) -> int:
    """Apply changes (see `upsert_rules`) to the newest version, or to `base`, and write the next one.

    If another writer was faster, VersionConflict is raised and nothing has changed.
    """
    base = newest_version(spark, path) if base is None else base
    return write_rule_version(upsert_rules(read_rule_version(spark, path, base), changes, as_of), path, base)


def list_rules(rules: DataFrame, enabled: bool | None = None, limit: int = 50, cursor=None):
    if enabled is not None:
        rules = rules.filter(F.col("enabled") == F.lit(enabled))
    return keyset_page(rules, limit, cursor)


