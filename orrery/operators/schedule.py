"""Replaying budgeted check schedules over known outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def schedules(spark: SparkSession, scenarios: DataFrame, trials: int, budget: int, scores: DataFrame | None = None) -> DataFrame:
    """seed, position, id: for each seed the ``budget`` scenarios (id, path) with the highest score of their path, ties by a hash of seed and id."""
    if trials < 1:
        raise ValueError("trials must be at least one")
    if not 1 <= budget <= scenarios.count():
        raise ValueError("budget must be between one and the number of scenarios")
    rated = scenarios.select("id", "path").withColumn("score", F.lit(0.0)) if scores is None else scenarios.select("id", "path").join(scores.select("path", "score"), "path", "left").fillna(0.0, ["score"])
    # Every scenario is replayed under every seed.
    rows = rated.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)).cast("array<long>"))).withColumn("_key", F.sha2(F.concat_ws(":", F.col("seed").cast("string"), "id"), 256))
    window = W.partitionBy("seed").orderBy(F.desc("score"), "_key")
    return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= budget).select("seed", "position", "id")


def replay(chosen: DataFrame, outcomes: DataFrame, budget: int) -> DataFrame:
    """One row: trials, detection_rate, mean_checks (until the first introduced failure, else the budget) and yield_rate, 6 places.

    outcomes: id, introduced_failure.
    """
    hits = chosen.join(outcomes.select("id", "introduced_failure"), "id")
    per_seed = hits.groupBy("seed").agg(F.min(F.when(F.col("introduced_failure"), F.col("position"))).alias("_first"), F.count_if("introduced_failure").alias("_found"))
    return per_seed.agg(
        F.count(F.lit(1)).alias("trials"),
        F.round(F.count("_first") / F.count(F.lit(1)), 6).alias("detection_rate"),
        F.round(F.avg(F.coalesce("_first", F.lit(budget))), 6).alias("mean_checks"),
        F.round(F.sum("_found") / (F.count(F.lit(1)) * budget), 6).alias("yield_rate"),
    )


def selection_counts(chosen: DataFrame, scenarios: DataFrame) -> DataFrame:
    return scenarios.select("id").join(chosen.groupBy("id").agg(F.count(F.lit(1)).alias("selected")), "id", "left").fillna(0, ["selected"])
