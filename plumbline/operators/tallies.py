"""Scores of many simulated streams: alarm rates, delays, misattribution, run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tally(outcomes: DataFrame, keys: list[str], change_at: int = 0) -> DataFrame:
    """outcomes: keys, truth, alarm_at, verdict. Rates and delays per group; one aggregation."""
    hit = F.col("alarm_at").isNotNull()
    delay = F.when(hit & (F.col("truth") != "stable") & (F.col("alarm_at") >= change_at), F.col("alarm_at") - change_at)
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(hit).alias("alarms"),
        F.avg(F.when(F.col("truth") == "stable", hit.cast("double"))).alias("false_alarm_rate"),
        F.avg(F.when(F.col("truth") != "stable", hit.cast("double"))).alias("detection_rate"),
        F.percentile(delay, 0.5).alias("median_delay"),
        F.avg(delay).alias("mean_delay"),
    )


def verdict_counts(outcomes: DataFrame, keys: list[str], verdicts: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).pivot("verdict", verdicts).count().na.fill(0)


def misattribution(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Share of streams whose cause was named wrongly, by direction, and of undecided ones."""
    def share(truth: str, said: str):
        return F.avg(F.when(F.col("truth") == truth, (F.col("verdict") == said).cast("double")))

    return outcomes.groupBy(*keys).agg(share("judge", "system").alias("judge_as_system"), share("system", "judge").alias("system_as_judge"), F.avg((F.col("verdict") == "indeterminate").cast("double")).alias("indeterminate_rate"), F.avg((F.col("verdict") == F.col("truth")).cast("double")).alias("accuracy"))


def arl0(outcomes: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """Mean time to a false alarm, censored at the horizon."""
    return outcomes.where("truth = 'stable'").groupBy(*keys).agg(F.avg(F.coalesce("alarm_at", F.lit(horizon))).alias("arl0"))


def modal_verdict(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent verdict; ties go to the alphabetically first."""
    counts = outcomes.groupBy(*keys, "verdict").agg(F.count(F.lit(1)).alias("votes"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "verdict"))
    return counts.withColumn("rank", rank).where("rank = 1").drop("rank")


def worst_cell(rates: DataFrame, cell: str, rate: str) -> DataFrame:
    return rates.agg(F.avg(rate).alias("mean_rate"), F.max(F.struct(F.col(rate), F.col(cell))).alias("w")).select("mean_rate", F.col(f"w.{rate}").alias("worst_rate"), F.col(f"w.{cell}").alias("worst_cell"))


def refusal_rates(calls: DataFrame, reference: str) -> DataFrame:
    """Refused share per configuration, and as a multiple of the reference configuration's."""
    rates = calls.groupBy("config").agg(F.avg(F.col("refused").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    base = F.max(F.when(F.col("config") == reference, F.col("rate"))).over(Window.partitionBy())
    return rates.withColumn("multiple", F.col("rate") / base)
