"""Auditable predictor exclusion: which features may not predict which target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark import config as C


def candidates(spark: SparkSession, tiers: dict[str, tuple[str, ...]] = C.TIERS) -> DataFrame:
    """(tier_name, position, feature_name)."""
    return spark.createDataFrame([(t, list(f)) for t, f in tiers.items()], "tier_name string, features array<string>").select("tier_name", F.posexplode("features").alias("position", "feature_name"))


def rules_frame(spark: SparkSession, rules: C.LeakageRules) -> DataFrame:
    """One row per target and variant (null: none), with the patterns that apply."""
    rows = []
    for name, r in rules.targets.items():
        for variant, (_, exact) in [(None, ((), ())), *r.variants.items()]:
            rows.append((name, variant, list(rules.global_forbidden_patterns), list(r.forbidden_exact), list(r.forbidden_contains), list(exact)))
    return spark.createDataFrame(rows, "target_contaminant string, variant string, anywhere array<string>, exact array<string>, contains array<string>, variant_exact array<string>")


def reason(feature: str = "feature_name") -> F.Column:
    """The first rule that forbids a feature, or null.

    Global patterns and a target's substrings ignore case, exact names don't.  A variant's allowances come after
    the target's rules and so never undo one; only its own exclusions act.
    """
    f = F.col(feature)
    inside = lambda p: F.contains(F.lower(f), F.lower(p))
    return (
        F.when(F.exists("anywhere", inside), F.lit("global_pattern"))
        .when(F.array_contains("exact", f), F.lit("exact_name"))
        .when(F.exists("contains", inside), F.lit("name_pattern"))
        .when(F.array_contains("variant_exact", f), F.lit("variant_exclusion"))
    )


def audit(features: DataFrame, rules: DataFrame) -> DataFrame:
    """leakage_rules_applied: each candidate of each tier for each target and variant; rules is one row each."""
    grid = features.join(F.broadcast(rules)).withColumn("reason", reason())
    return grid.select("target_contaminant", "variant", "tier_name", "feature_name", F.when(F.col("reason").isNull(), "included").otherwise("excluded").alias("action"), "reason")


def stored(audited: DataFrame, variant_tier: str = C.VARIANT_TIER) -> DataFrame:
    """leakage_rules_applied of an audit: a target's variants only in the middle tier, under the names of both."""
    own = audited.where(F.col("variant").isNull() | (F.col("tier_name") == variant_tier)).withColumn("tier_name", F.concat_ws("_", "tier_name", "variant"))
    return own.select("target_contaminant", "tier_name", "feature_name", "action", "reason", F.lit("leakage_rules").alias("rule_source"))


def counts(audited: DataFrame) -> DataFrame:
    """Retained features per target, variant and tier."""
    return audited.where("action = 'included'").groupBy("target_contaminant", "variant", "tier_name").agg(F.countDistinct("feature_name").alias("n_features"))
