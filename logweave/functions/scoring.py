"""Risk score and the noise filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logweave import constants as C
from logweave.functions.parsing import lookup

THRESHOLD = 50


def severity_score(severity: Column) -> Column:
    return lookup(C.SEVERITY_SCORES, F.upper(severity), F.lit(10)).cast("int")


def velocity_score(severity: Column, count: Column) -> Column:
    raw = F.when(count >= 500, 50).when(count >= 100, 30).when(count >= 25, 15).otherwise(0)
    level = F.upper(severity)
    part = F.when(level.isin("DEBUG", "INFO"), raw * 2 / 10).when(level.isin("NOTICE", "WARNING"), raw * 6 / 10).otherwise(raw)
    return F.floor(part).cast("int")


def entropy_penalty(entropy: Column) -> Column:
    return F.when(entropy > 6.0, 20).otherwise(0)


def confidence_penalty(confidence: Column) -> Column:
    return F.when(confidence < 0.4, 15).otherwise(0)


def score(rows: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """rows (severity, window_count_1m, entropy, confidence) with the four parts, risk_score and is_actionable."""
    level = F.upper("severity")
    rows = rows.withColumns(
        {
            "severity_score": severity_score(F.col("severity")), "velocity_score": velocity_score(F.col("severity"), F.coalesce("window_count_1m", F.lit(1))),
            "entropy_penalty": entropy_penalty(F.coalesce("entropy", F.lit(0.0))), "confidence_penalty": confidence_penalty(F.coalesce("confidence", F.lit(1.0))),
        }
    )
    total = F.least(F.lit(100), F.col("severity_score") + F.col("velocity_score") + F.col("entropy_penalty") + F.col("confidence_penalty"))
    urgent = level.isin(*C.ALWAYS_ACTIONABLE)
    rows = rows.withColumn("risk_score", F.when(urgent, F.greatest(total, F.lit(threshold))).otherwise(total).cast("int"))
    return rows.withColumn("is_actionable", urgent | (F.col("risk_score") >= threshold))


def actionable(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Only actionable rows; an observation gets the number of rows and of those filtered out, without a job of its own."""
    if observation is not None:
        rows = rows.observe(observation, F.count(F.lit(1)).alias("scored"), F.count_if(~F.col("is_actionable")).alias("filtered_out"))
    return rows.where("is_actionable")
