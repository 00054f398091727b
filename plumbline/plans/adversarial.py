"""Attacks on the attribution: each a table of streams with a level, decided in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import VERDICTS
from ..operators import tallies
from ..sources import generator
from . import attribution

CONFIG = attribution.Config(backend="kernel")


def _base(spark: SparkSession, seeds: int, levels: list[float], **own) -> tuple[DataFrame, DataFrame]:
    """specs and a table (stream_id, level)."""
    rows = [{"name": f"{level:g}#{s}", "seed": 1000 + s, **own} for level in levels for s in range(seeds)]
    specs = generator.specs(spark, rows)
    return specs, specs.select(F.col("name").alias("stream_id"), F.split("name", "#")[0].cast("double").alias("level"))


def evasion(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0, 0.5, 1.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The instrument moves only items the control set covers to `level`: at 0 it can't be seen."""
    specs, level = _base(spark, seeds, list(levels))
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    place = F.regexp_extract("item_id", r"(\d+)$", 1).cast("int") / 200.0
    hit = (F.col("run_index") >= 20) & ((F.col("kind") == "system") | (place < F.col("level")))
    return obs.withColumn("score", F.when(hit, F.greatest(F.col("score") - 0.12, F.lit(0.0))).otherwise(F.col("score"))).drop("level"), generator.floors(specs), level


def slow_ramp(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0002, 0.002, 0.01)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The system loses `level` a run."""
    specs, level = _base(spark, seeds, list(levels))
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    drop = F.when(F.col("kind") == "system", F.greatest(F.col("run_index") - 20, F.lit(0)) * F.col("level")).otherwise(0.0)
    return obs.withColumn("score", F.greatest(F.col("score") - drop, F.lit(0.0))).drop("level"), generator.floors(specs), level


def cancellation(spark: SparkSession, seeds: int = 2, levels: tuple = (0.03, 0.06, 0.1)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Instrument and system move by `level` in opposite directions, so the raw score stays."""
    rows = [{"name": f"{x:g}#{s}", "seed": 1000 + s, "judge_shift": x, "system_shift": -x} for x in levels for s in range(seeds)]
    specs = generator.specs(spark, rows)
    return generator.observations(specs), generator.floors(specs), specs.select(F.col("name").alias("stream_id"), F.split("name", "#")[0].cast("double").alias("level"))


def input_shift(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0, 1.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The suite gets harder from run 20 on; at level 1 its ids change with it, which must be refused."""
    specs, level = _base(spark, seeds, list(levels), system_shift=-0.1)
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    renamed = (F.col("level") == 1) & (F.col("kind") == "system") & (F.col("run_index") >= 20)
    return obs.withColumn("item_id", F.when(renamed, F.concat(F.lit("new-"), "item_id")).otherwise(F.col("item_id"))).drop("level"), generator.floors(specs), level


def staleness(spark: SparkSession, seeds: int = 2, levels: tuple = (1.0, 5.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The control set is scored at every `level`th run only."""
    specs, level = _base(spark, seeds, list(levels), judge_shift=-0.1)
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    return obs.where((F.col("kind") == "system") | (F.col("run_index") % F.col("level") == 0) | (F.col("run_index") < 5)).drop("level"), generator.floors(specs), level


def cached_scorer(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0, 1.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A provider that answers the control set from a cache hides its drift (level 0); a nonce shows it (level 1)."""
    specs, level = _base(spark, seeds, list(levels), judge_shift=-0.12)
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    frozen = obs.where("kind = 'anchor' and run_index = 5").select("stream_id", "item_id", F.col("score").alias("old"))
    joined = obs.join(frozen, ["stream_id", "item_id"], "left")
    stale = (F.col("level") == 0) & (F.col("kind") == "anchor") & (F.col("run_index") > 5)
    return joined.withColumn("score", F.when(stale, F.col("old")).otherwise(F.col("score"))).drop("old", "level"), generator.floors(specs), level


def ordering(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0, 1.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """At level 1 each run's best scores come first: runs are sets, so nothing may change."""
    rows = [{"name": f"{x:g}#{s}", "seed": 1000 + s, "system_shift": -0.08} for x in levels for s in range(seeds)]
    specs = generator.specs(spark, rows)
    level = specs.select(F.col("name").alias("stream_id"), F.split("name", "#")[0].cast("double").alias("level"))
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    obs = obs.repartition("stream_id").sortWithinPartitions("stream_id", "run_index", F.when(F.col("level") == 1, -F.col("score")))
    return obs.drop("level"), generator.floors(specs), level


def bounds(spark: SparkSession, seeds: int = 2, levels: tuple = (0.0, 1.0, 2.0)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores at their limits: 0 is a system near the ceiling that falls a little, 1 one whose scores are all equal, 2 such a one that steps down.

    Scores outside the declared range never get here: ingest refuses them.
    """
    rows = [{"name": f"{x:g}#{s}", "seed": 1000 + s} | ({"system_level": 0.99, "anchor_level": 0.99, "per_item_sd": 0.01, "system_shift": -0.05} if x == 0 else {}) for x in levels for s in range(seeds)]
    specs = generator.specs(spark, rows)
    level = specs.select(F.col("name").alias("stream_id"), F.split("name", "#")[0].cast("double").alias("level"))
    obs = generator.observations(specs).join(F.broadcast(level), "stream_id")
    flat = (F.col("level") > 0) & (F.col("kind") == "system")
    step = F.when((F.col("level") == 2) & (F.col("run_index") >= 20), 0.55).otherwise(0.75)
    return obs.withColumn("score", F.when(flat, step).otherwise(F.col("score"))).drop("level"), generator.floors(specs), level


ATTACKS = {"ordering": ordering, "bounds": bounds, "evasion": evasion, "slow_ramp": slow_ramp, "cancellation": cancellation, "input_shift": input_shift, "staleness": staleness, "cached_scorer": cached_scorer}


def outcomes(spark: SparkSession, attack: str, seeds: int = 2) -> DataFrame:
    """level and how often each verdict (or a refusal) came out."""
    obs, floors, level = ATTACKS[attack](spark, seeds)
    decided = attribution.decide(obs, floors, CONFIG).select("stream_id", F.coalesce("verdict", F.lit("refused")).alias("verdict"))
    return tallies.verdict_counts(decided.join(level, "stream_id"), ["level"], [*VERDICTS, "refused"])


def failure_rates(spark: SparkSession, attack: str, right: list[str], seeds: int = 2) -> DataFrame:
    """level, n, failure_rate: how often a verdict that is not among the right ones (or no refusal, where that is right) came out."""
    counts = outcomes(spark, attack, seeds)
    n = sum((F.col(v) for v in VERDICTS), F.col("refused"))
    return counts.select("level", n.alias("n"), (1.0 - sum((F.col(v) for v in right), F.lit(0)) / n).alias("failure_rate"))
