"""Observations -> runs -> baselines -> deviations.

observations: stream_id, kind ('system' or 'anchor'), epoch, run_index, item_id, score; rows are in [0, 1].
A run's place is its rank by run_index within stream and kind, so gaps don't matter. Everything is keyed by
stream_id first, so one exchange by stream serves many streams; within one huge stream the aggregations are
partial and spread by run or by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import MIN_SD, id_set_hash

STREAM = ["stream_id", "kind"]


def current_epoch(obs: DataFrame) -> DataFrame:
    """Rows of each stream's latest epoch, over both kinds."""
    latest = obs.groupBy("stream_id").agg(F.max("epoch").alias("latest"))
    return obs.join(latest, "stream_id").where(F.col("epoch") == F.col("latest")).drop("latest")


def run_table(obs: DataFrame) -> DataFrame:
    """One row per run: size, mean, hash of the item set, place (from 0)."""
    runs = obs.groupBy(*STREAM, "run_index").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), id_set_hash(F.collect_list("item_id")).alias("suite_hash"))
    place = F.row_number().over(Window.partitionBy(*STREAM).orderBy("run_index")) - 1
    return runs.withColumn("place", place)


def item_baseline(obs: DataFrame, runs: DataFrame, first: Column) -> DataFrame:
    """Mean score per item over the runs whose place is below `first` (a column of runs)."""
    frozen = runs.where(F.col("place") < first).select(*STREAM, "run_index")
    return obs.join(frozen, [*STREAM, "run_index"], "left_semi").groupBy(*STREAM, "item_id").agg(F.avg("score").alias("base"))


def deviations(obs: DataFrame, runs: DataFrame, base: DataFrame) -> DataFrame:
    """runs with dev: mean deviation of its items from the baseline; items without one are left out, 0 if none has."""
    dev = obs.join(base, [*STREAM, "item_id"]).groupBy(*STREAM, "run_index").agg(F.avg(F.col("score") - F.col("base")).alias("dev"))
    return runs.join(dev, [*STREAM, "run_index"], "left").withColumn("dev", F.coalesce("dev", F.lit(0.0)))


def floored_sd(x: Column) -> Column:
    return F.greatest(F.coalesce(F.stddev_samp(x), F.lit(MIN_SD)), F.lit(MIN_SD))


def nested(obs: DataFrame) -> DataFrame:
    """Runs with an array of observations; `flat` is its inverse."""
    return obs.groupBy(*STREAM, "epoch", "run_index").agg(F.array_sort(F.collect_list(F.struct("item_id", "score"))).alias("observations"))


def flat(runs: DataFrame) -> DataFrame:
    return runs.select(*STREAM, "epoch", "run_index", F.explode("observations").alias("o")).select(*STREAM, "epoch", "run_index", "o.item_id", "o.score")
