"""Simulated score streams with a known cause, deterministic in each stream's seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "name": "stream", "seed": 0, "n_runs": 60, "change_at": 20, "system_items": 200, "anchor_items": 200, "per_item_sd": 0.08, "shared_sd": 0.0,
    "judge_shift": 0.0, "system_shift": 0.0, "system_level": 0.75, "anchor_level": 0.70, "score_type": "continuous", "replicates": 5,
    "judge_model": "judge-a", "judge_model_after": None,
}
SPEC = "name string, seed long, n_runs int, change_at int, system_items int, anchor_items int, per_item_sd double, shared_sd double, judge_shift double, system_shift double, system_level double, anchor_level double, score_type string, replicates int, judge_model string, judge_model_after string"
OBSERVATIONS = "stream_id string, kind string, epoch int, run_index long, item_id string, score double"


def spec(**own) -> dict:
    unknown = set(own) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
    return DEFAULTS | own


def specs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in SPEC.split(", ")]
    return spark.createDataFrame([tuple(spec(**r)[n] for n in names) for r in rows], SPEC)


def grid(spark: SparkSession, seeds: int, **factors: list) -> DataFrame:
    """Every combination of the factors, `seeds` streams of each, as explosions of literal lists."""
    base = DEFAULTS | {k: v[0] for k, v in factors.items()}
    df = spark.range(seeds).withColumnRenamed("id", "seed")
    for name, values in factors.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    cell = F.concat_ws("/", *(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in factors))
    df = df.withColumn("cell", cell).withColumn("name", F.concat(F.col("cell"), F.lit("#"), F.col("seed").cast("string")))
    for c in SPEC.split(", "):
        name, kind = c.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit(base[name]).cast(kind))
    return df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SPEC.split(", ")), "cell")


def scores_of(rng: np.random.Generator, level: float, n: int, s) -> np.ndarray:
    shared = rng.normal(0.0, s.shared_sd) if s.shared_sd > 0 else 0.0
    x = np.clip(level + shared + rng.normal(0.0, s.per_item_sd, n), 0.0, 1.0)
    return {"continuous": x, "binary": (x >= 0.5) * 1.0, "likert5": np.round(x * 4.0) / 4.0}[s.score_type]


def observations(specs_df: DataFrame) -> DataFrame:
    """All observations of all streams; each stream is made whole by one task, from its own generator."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                rng = np.random.default_rng(s.seed)
                ids = {prefix: [f"{prefix}-{i}" for i in range(n)] for prefix, n in (("item", s.system_items), ("anchor", s.anchor_items))}
                parts = []
                for t in range(s.n_runs):
                    judge, system = (s.judge_shift, s.system_shift) if t >= s.change_at else (0.0, 0.0)
                    for kind, level, n, prefix in (("system", s.system_level + judge + system, s.system_items, "item"), ("anchor", s.anchor_level + judge, s.anchor_items, "anchor")):
                        x = scores_of(rng, level, n, s)
                        parts.append((np.full(n, kind, object), np.full(n, t), np.array(ids[prefix], object), x))
                kinds, runs, items, x = (np.concatenate(c) for c in zip(*parts))
                yield pd.DataFrame({"stream_id": s.name, "kind": kinds, "epoch": 0, "run_index": runs, "item_id": items, "score": x})

    n = max(1, specs_df.count())
    return specs_df.repartition(min(n, 4 * specs_df.sparkSession.sparkContext.defaultParallelism), "name").mapInPandas(make, OBSERVATIONS)


def floors(specs_df: DataFrame) -> DataFrame:
    """The noise floor that repeated scoring of each stream's control set would measure."""
    run_sd = F.sqrt(F.col("shared_sd") * F.col("shared_sd") + F.col("per_item_sd") * F.col("per_item_sd") / F.col("anchor_items"))
    return specs_df.select(F.col("name").alias("stream_id"), "per_item_sd", run_sd.alias("run_mean_sd"), "replicates", F.col("anchor_items").alias("n_items"))


def pins(specs_df: DataFrame) -> DataFrame:
    """stream_id, kind, run_index, judge_pin of every run."""
    rows = specs_df.withColumn("run_index", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_runs").cast("long") - 1)))
    rows = rows.withColumn("kind", F.explode(F.array(F.lit("system"), F.lit("anchor"))))
    model = F.when(F.col("run_index") >= F.col("change_at"), F.coalesce("judge_model_after", "judge_model")).otherwise(F.col("judge_model"))
    pin = F.struct(F.lit("simulated").alias("provider"), model.alias("model"), F.lit("rubric").alias("rubric_hash"), F.lit("params").alias("params_hash"), F.lit("1..5").alias("scale"))
    return rows.select(F.col("name").alias("stream_id"), "kind", "run_index", pin.alias("judge_pin"))


def truth(specs_df: DataFrame) -> DataFrame:
    judge, system = F.col("judge_shift") != 0, F.col("system_shift") != 0
    cause = F.when(judge & system, "both").when(judge, "judge").when(system, "system").otherwise("stable")
    return specs_df.select(F.col("name").alias("stream_id"), cause.alias("truth"), "change_at")


def latent_level(item_id: Column) -> Column:
    """A scorer's opinion of an item before noise: a fixed function of its id, in [0.25, 0.75]."""
    return F.lit(0.25) + F.lit(0.5) * F.conv(F.substring(F.sha2(item_id, 256), 1, 8), 16, 10).cast("double") / float(2**32 - 1)


def retag(obs: DataFrame, shifts: DataFrame, since: int) -> DataFrame:
    """obs with per-item shifts (item_id, shift) from run `since` on, clipped."""
    moved = obs.join(shifts, "item_id", "left")
    value = F.least(F.greatest(F.col("score") + F.coalesce("shift", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return moved.withColumn("score", F.when(F.col("run_index") >= since, value).otherwise(F.col("score"))).select(*obs.columns)


def splice(before: DataFrame, after: DataFrame, at: int) -> DataFrame:
    return before.where(F.col("run_index") < at).unionByName(after.where(F.col("run_index") >= at))
