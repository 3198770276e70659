"""What a candidate rule set changes against the default one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF_COLUMNS = (
    "path", "enabled", "kind", "feature", "minimum", "maximum",
    "model", "threshold", "change", "difference",
)
_DETAIL_SCHEMA = (
    "path string, kind string, feature string, minimum double, maximum double, "
    "model string, threshold double"
)


def path_details(spark, rules: DataFrame, model_paths: Iterable = (), opaque: Iterable[str] = ()) -> DataFrame:
    """Default path table: range rules, model paths, and evaluator-only paths."""
    ranges = rules.select(
        "path",
        F.lit("Range").alias("kind"),
        "feature",
        "minimum",
        "maximum",
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("double").alias("threshold"),
    )
    extra = [
        (p.path, "ML", ", ".join(p.model.features), None, None, p.model.name, float(p.threshold))
        for p in model_paths
    ] + [
        (name, "Python evaluator", "Defined by evaluator", None, None, None, None)
        for name in opaque
    ]
    return ranges.unionByName(spark.createDataFrame(extra, _DETAIL_SCHEMA)) if extra else ranges


def default_listing(details: DataFrame, baseline: Iterable[str]) -> DataFrame:
    """Loaded default paths with their enabled state."""
    return details.select(
        "*",
        F.col("path").isin(list(baseline)).alias("enabled"),
        F.lit("Unchanged").alias("change"),
        F.lit("").alias("difference"),
    ).select(*DIFF_COLUMNS)


def candidate_listing(
    details: DataFrame,
    rules: DataFrame,
    *,
    baseline: Iterable[str],
    enabled: Iterable[str],
    model_paths: Iterable = (),
) -> DataFrame:
    """Candidate paths: enabled defaults, then overriding and added rules."""
    old = details.select(
        "path",
        "feature",
        F.col("minimum").alias("old_min"),
        F.col("maximum").alias("old_max"),
        F.lit(True).alias("known"),
    )
    proposed = (
        rules.join(old, ["path", "feature"], "left")
        .withColumn(
            "change",
            F.when(F.col("known"), F.lit("Modified")).otherwise(F.lit("Added")),
        )
        .withColumn(
            "difference",
            F.when(
                F.col("known"),
                F.concat_ws(
                    "; ",
                    _moved("min", F.col("old_min"), F.col("minimum")),
                    _moved("max", F.col("old_max"), F.col("maximum")),
                ),
            ).otherwise(F.lit("")),
        )
        .select(
            "path",
            F.lit(True).alias("enabled"),
            F.lit("Range").alias("kind"),
            "feature",
            "minimum",
            "maximum",
            F.lit(None).cast("string").alias("model"),
            F.lit(None).cast("double").alias("threshold"),
            "change",
            "difference",
        )
    )
    inherited = (
        details.filter(F.col("path").isin(list(enabled)))
        .join(rules.select("path", "feature"), ["path", "feature"], "left_anti")
        .select(
            "*",
            F.lit(True).alias("enabled"),
            F.when(F.col("path").isin(list(baseline)), F.lit("Unchanged"))
            .otherwise(F.lit("Added"))
            .alias("change"),
            F.lit("").alias("difference"),
        )
        .select(*DIFF_COLUMNS)
    )
    listing = inherited.unionByName(proposed)
    added = [
        (p.path, "ML", ", ".join(p.model.features), None, None, p.model.name, float(p.threshold))
        for p in model_paths
    ]
    if added:
        models = details.sparkSession.createDataFrame(added, _DETAIL_SCHEMA)
        listing = listing.unionByName(
            models.select(
                "*",
                F.lit(True).alias("enabled"),
                F.lit("Added").alias("change"),
                F.lit("").alias("difference"),
            )
        )
    return listing


def rule_set_diff(
    details: DataFrame,
    rules: DataFrame,
    *,
    baseline: Iterable[str],
    enabled: Iterable[str],
    model_paths: Iterable = (),
) -> DataFrame:
    """Removed, Added and Modified rows; unchanged ones are left out."""
    baseline, enabled = list(baseline), list(enabled)
    removed = default_listing(details, baseline).filter(
        F.col("enabled") & ~F.col("path").isin(enabled)
    )
    removed = removed.withColumn("change", F.lit("Removed")).withColumn(
        "difference", F.lit("path disabled")
    )
    listing = candidate_listing(
        details, rules, baseline=baseline, enabled=enabled, model_paths=model_paths
    )
    return removed.unionByName(listing.filter(F.col("change") != "Unchanged"))


def change_counts(diff: DataFrame) -> DataFrame:
    """How many paths changed, and how many in each way."""

    def paths(change: str) -> Column:
        return F.count_distinct(F.when(F.col("change") == change, F.col("path")))

    return diff.agg(
        F.count_distinct("path").alias("changed_paths"),
        paths("Added").alias("added_paths"),
        paths("Modified").alias("modified_paths"),
        paths("Removed").alias("removed_paths"),
    )


def _moved(side: str, old: Column, new: Column) -> Column:
    """``min: 9.0 → 11.0`` when the bound moved, NULL when it did not."""

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("None"))

    return F.when(
        ~old.eqNullSafe(new),
        F.concat(F.lit(f"{side}: "), shown(old), F.lit(" → "), shown(new)),
    )
