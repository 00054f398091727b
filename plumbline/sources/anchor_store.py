"""The frozen control set as JSON lines: written whole, read strictly."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

SCHEMA = "item_id string, prompt_input string, output string, stratum string, base double"
MODES = ["frozen-self", "gold", "replicate"]


def save(items: DataFrame, path: str) -> None:
    """item_id, prompt_input, output, stratum, base; replaces what was there."""
    items.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The items; a line that is no item is named by its number and stops the reading."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id()).where("trim(value) <> ''")
    rows = lines.select("place", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("item"))
    bad = rows.where("item is null or item.item_id is null").agg(F.min("place").alias("place")).first()["place"]
    if bad is not None:
        number = lines.where(F.col("place") <= bad).count()
        raise ValueError(f"{path}: line {number} is not an item of a control set")
    return rows.select("item.*")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pairs (item_id, prompt_input, output) from JSON lines; a row without an id raises."""
    rows = spark.read.schema("item_id string, prompt_input string, output string").json(path)
    named = F.when(F.col("item_id").isNull() | (F.trim("item_id") == ""), F.raise_error(F.lit("a pair without item_id"))).otherwise(F.col("item_id"))
    return rows.withColumn("item_id", named)


def check_mode(mode: str, pinned_snapshots: bool) -> None:
    """Replicating a scorer needs one whose snapshots can be pinned."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    if mode == "replicate" and not pinned_snapshots:
        raise ValueError("mode replicate needs a scorer with pinned snapshots; frozen-self needs none")


SCORED = "item_id string, score double, cost double, calls int, error string"


def scored_or_failed(items: DataFrame, score: Callable, raises: type[Exception] | tuple = Exception, workers: int = 8, retries: int = 0, pause: float = 0.1, own: bool = False) -> DataFrame:
    """The columns of SCORED for each item, a failure of one being its row and no more.

    score(prompt_input, output) gives a number, or a number and what the call cost. A task has `workers` calls under way
    at a time and holds one Arrow batch. A failing call is tried `retries` times more, each after twice the pause. own:
    score() is called without arguments once in every thread and makes that thread's scorer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = threading.local()

        def one(row: tuple) -> tuple:
            i, a, b = row
            for call in range(retries + 1):
                try:
                    if not hasattr(local, "score"):
                        local.score = score() if own else score
                    got = local.score(a, b)
                    value, cost = got if isinstance(got, tuple) else (got, 0.0)
                    return i, float(value), float(cost), call + 1, None
                except raises as e:
                    error = f"{type(e).__name__}: {e}"
                    if call < retries:
                        time.sleep(pause * 2**call)
            return i, None, 0.0, retries + 1, error

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                rows = zip(batch["item_id"], batch["prompt_input"], batch["output"])
                yield pd.DataFrame(list(pool.map(one, rows)), columns=[c.split()[0] for c in SCORED.split(", ")])

    return items.select("item_id", "prompt_input", "output").mapInPandas(run, SCORED)


def wave_of(item_id: Column, waves: int) -> Column:
    return F.conv(F.substring(F.sha2(item_id, 256), 1, 8), 16, 10).cast("long") % waves


def score_within(items: DataFrame, score: Callable, limit: float, waves: int = 16, **options) -> DataFrame:
    """The columns of SCORED and wave for every item, until `limit` is spent: items are scored in waves by the hash of their ids.

    A wave's rows are written before the next begins, so nothing paid for is lost with an executor, and what it cost is
    known. No wave begins once the limit is reached: its items come out unscored, with the error "spend limit". A wave
    in which every call fails ends the scoring with an error.
    """
    items = items.withColumn("wave", wave_of(F.col("item_id"), waves).cast("int"))
    done, spent = [], 0.0
    for wave in range(waves):
        if spent >= limit:
            break
        rows = written(scored_or_failed(items.where(F.col("wave") == wave), score, **options), f"wave-{wave}")
        seen = rows.agg(F.sum("cost").alias("cost"), F.count("score").alias("scored"), F.min("error").alias("error")).first()
        if not seen["scored"] and seen["error"]:
            raise ValueError(f"every call of a wave failed, nothing more is spent: {seen['error']}")
        spent += seen["cost"] or 0.0
        done.append(rows.withColumn("wave", F.lit(wave)))
    left = items.where(F.col("wave") >= len(done)).select("item_id", F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("cost"), F.lit(0).alias("calls"), F.lit("spend limit").alias("error"), "wave")
    out = left
    for rows in done:
        out = out.unionByName(rows)
    return out
