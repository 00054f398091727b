"""The star-schema and event tables as score streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import normalise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly_discounts(spark: SparkSession, sf_dir: str, shift: float = 0.0, since: int = 40) -> DataFrame:
    """Observations: run = ship month, item = supplier mod 20, score = mean discount on the range [0, 0.1].

    Items 0-9 are the system under test, 10-19 its control set; scores of the system's runs from `since` on
    move by `shift`. Two columns and a date are read.
    """
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    item = (F.col("l_suppkey") % 20).cast("int")
    rows = read(spark, sf_dir, "lineitem").groupBy(month.cast("long").alias("run_index"), item.alias("item")).agg(F.avg("l_discount").alias("raw"))
    score = normalise(F.col("raw"), 0.0, 0.1)
    moved = F.when((F.col("item") < 10) & (F.col("run_index") >= since), F.least(F.greatest(score + shift, F.lit(0.0)), F.lit(1.0))).otherwise(score)
    kind = F.when(F.col("item") < 10, "system").otherwise("anchor")
    return rows.select(F.lit("discounts").alias("stream_id"), kind.alias("kind"), F.lit(0).alias("epoch"), "run_index", F.col("item").cast("string").alias("item_id"), moved.alias("score"), F.col("raw"))


def daily_values(spark: SparkSession, sf_dir: str, items: int = 30, hours: int = 24) -> DataFrame:
    """Observations from events: run = day (or `hours`), item = user mod items, score = mean value on [0, 1000]."""
    start = F.lit(hours * 3600)
    run = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / start).cast("long")
    rows = read(spark, sf_dir, "events").groupBy(run.alias("run_index"), (F.col("user_id") % items).cast("string").alias("item_id")).agg(F.avg("value").alias("raw"))
    return rows.select(F.lit("events").alias("stream_id"), F.lit("system").alias("kind"), F.lit(0).alias("epoch"), "run_index", "item_id", normalise(F.col("raw"), 0.0, 1000.0).alias("score"), "raw")


def replicates(spark: SparkSession, sf_dir: str, k: int = 5, items: int = 20) -> DataFrame:
    """replicate, item_id, score: events dealt into k scorings of the same items."""
    rows = read(spark, sf_dir, "events").groupBy((F.col("event_id") % k).cast("int").alias("replicate"), (F.col("user_id") % items).cast("string").alias("item_id"))
    return rows.agg((F.avg("value") / 1000.0).alias("score"))


def discount_legs(spark: SparkSession, sf_dir: str, baseline: int = 8) -> DataFrame:
    """stream_id, leg, t, dev, z and the null of the whole monthly series as one monitored leg: the detector's plain input."""
    from ..functions.student import dead_zone_factor
    from ..operators import runs

    obs = monthly_discounts(spark, sf_dir).withColumn("kind", F.lit("system"))
    every = runs.run_table(obs)
    devs = runs.deviations(obs, every, runs.item_baseline(obs, every, F.lit(baseline)))
    sd = devs.where(F.col("place") < baseline).groupBy("stream_id").agg(runs.floored_sd(F.col("dev")).alias("sd"))
    width = F.greatest(F.lit(0.05), F.col("sd") * 4.0)
    half = F.col("sd") * dead_zone_factor(baseline, 0.05) / (2.0 * width)
    rows = devs.where(F.col("place") >= baseline).join(sd, "stream_id")
    z = F.least(F.greatest(0.5 + F.col("dev") / (2.0 * width), F.lit(0.0)), F.lit(1.0))
    return rows.select("stream_id", F.lit("system").alias("leg"), (F.col("place") - baseline).cast("long").alias("t"), "run_index", "dev", z.alias("z"), F.greatest(F.lit(0.0), 0.5 - half).alias("null_lo"), F.least(F.lit(1.0), 0.5 + half).alias("null_hi"))


def moved_discounts(spark: SparkSession, sf_dir: str, cells: int = 12, baseline: int = 12, since: int = 24, shifts: tuple[float, ...] = (0.1, 0.2, 0.4)) -> DataFrame:
    """cell, truth, shift, t, system, anchor: monthly discounts of parts mod `cells` under every cause and size of a change.

    Sides are those of monthly_discounts, a month without either is left out, and t is 0 after `baseline` months. From
    `since` on a change of the judge lowers both sides by the shift, one of the system its own side.
    """
    month = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("long")
    side = lambda hit: F.avg(F.when(hit, F.col("l_discount"))) / 0.1
    ours = F.col("l_suppkey") % 20 < 10
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % cells).cast("long").alias("cell"), month.alias("month")).agg(side(ours).alias("s"), side(~ours).alias("a"))
    place = F.row_number().over(Window.partitionBy("cell").orderBy("month"))
    rows = rows.where("s is not null and a is not null").withColumn("t", (place - 1 - baseline).cast("long"))
    cases = [F.struct(F.lit(truth).alias("truth"), F.lit(x).alias("shift")) for truth in ("stable", "judge", "system", "both") for x in shifts]
    rows = rows.select("cell", "t", "s", "a", F.inline(F.array(*cases)))
    moved = lambda *causes: F.when((F.col("t") >= since) & F.col("truth").isin(*causes), F.col("shift")).otherwise(0.0)
    return rows.select("cell", "truth", "shift", "t", (F.col("s") - moved("judge", "both") - moved("system", "both")).alias("system"), (F.col("a") - moved("judge", "both")).alias("anchor"))
