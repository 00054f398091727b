"""Studies over a pool of scores: streams composed by splicing configurations, and all methods on many streams.

A pool is long: config, item_id, score; and replicate, item_id, score for repeated scorings by the first one.
Composition is a product of small tables (scenarios, seeds, runs) with the chosen items, and its noise is a
function of the row's names alone, so any task can make any row, and SQL can make them too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rivals, tallies
from ..operators.anchors import noise_floor
from . import attribution

WORSE = "-degraded"
DEGRADED_BY = 0.10

# Scenario, cause, the system's configuration before and after, the control set's before and after.
SCENARIOS = [
    ("judge-version-bump", "judge", "a-baseline", "b-other-snapshot", "a-baseline", "b-other-snapshot"),
    ("judge-rubric-change", "judge", "a-baseline", "c-strict-rubric", "a-baseline", "c-strict-rubric"),
    ("judge-parameter-change", "judge", "a-baseline", "d-effort", "a-baseline", "d-effort"),
    ("system-regression", "system", "a-baseline", "a-baseline-degraded", "a-baseline", "a-baseline"),
    ("both-moved", "both", "a-baseline", "b-other-snapshot-degraded", "a-baseline", "b-other-snapshot"),
    ("drift-free-control", "stable", "a-baseline", "a-baseline", "a-baseline", "a-baseline"),
]
SCENARIO = "scenario string, truth string, system_before string, system_after string, anchor_before string, anchor_after string"
METHODS = ["threshold", "peeking_t", "bonferroni_t", "cusum", "adwin", "ddm", "system_only", "full"]


def load_pool(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A pool file (scores: config -> item -> score; replicate_scores: a list of item -> score) in the long form."""
    raw = spark.read.schema("scores map<string,map<string,double>>, replicate_scores array<map<string,double>>").option("multiLine", "true").json(path)
    scores = raw.select(F.explode("scores").alias("config", "items")).select("config", F.explode("items").alias("item_id", "score"))
    repeats = raw.select(F.posexplode("replicate_scores").alias("replicate", "items")).select("replicate", F.explode("items").alias("item_id", "score"))
    return scores, repeats


def common_items(pool: DataFrame) -> DataFrame:
    """item_id of the items that every configuration scored: no score is ever made up for a missing one."""
    n = pool.select("config").distinct().agg(F.count(F.lit(1)).alias("configs"))
    per_item = pool.groupBy("item_id").agg(F.count_distinct("config").alias("have"))
    return per_item.crossJoin(F.broadcast(n)).where("have = configs").select("item_id")


def halves(items: DataFrame, anchor_n: int, system_n: int) -> DataFrame:
    """item_id, kind: the first items by id are the control set, the next ones the system's suite, never both."""
    first = items.select("item_id").orderBy("item_id").limit(anchor_n + system_n)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy("item_id")))
    short = F.raise_error(F.lit(f"a control set of {anchor_n} and a suite of {system_n} need {anchor_n + system_n} items")).cast("boolean")
    enough = first.agg((F.count(F.lit(1)) == anchor_n + system_n).alias("enough"))
    rows = placed.crossJoin(F.broadcast(enough)).where(F.when(F.col("enough"), True).otherwise(short))
    return rows.select("item_id", F.when(F.col("place") <= anchor_n, "anchor").otherwise("system").alias("kind"))


def degraded(score: Column, by: float = DEGRADED_BY) -> Column:
    """A regression by construction: every score lower by so much, not below 0."""
    return F.greatest(F.lit(0.0), score - by)


def noise(*names: Column) -> Column:
    """A standard normal number that is a function of the names (Box and Muller over two parts of their MD5)."""
    digest = F.md5(F.concat_ws("/", *names))
    u = [(F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for at in (1, 9)]
    return F.sqrt(-2.0 * F.ln(u[0])) * F.cos(2.0 * math.pi * u[1])


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, SCENARIO)


def pool_floor(repeats: DataFrame, sides: DataFrame) -> DataFrame:
    """The control set's noise floor from the pool's repeated scorings."""
    return noise_floor(repeats.join(sides.where("kind = 'anchor'").select("item_id"), "item_id"))


def compose(spark: SparkSession, pool: DataFrame, repeats: DataFrame, seeds: int = 1, n_runs: int = 60, change_at: int = 20, anchor_n: int = 150, system_n: int = 150) -> tuple[DataFrame, DataFrame]:
    """(observations, floors) of every scenario and seed; streams are named scenario#seed."""
    sides = halves(common_items(pool), anchor_n, system_n)
    floor = pool_floor(repeats, sides)
    worse = pool.select(F.concat("config", F.lit(WORSE)).alias("config"), "item_id", degraded(F.col("score")).alias("score"))
    known = pool.select("config", "item_id", "score").unionByName(worse)
    streams = scenarios(spark).crossJoin(spark.range(seeds).select(F.col("id").alias("seed"))).withColumn("stream_id", F.concat_ws("#", "scenario", "seed"))
    spread = streams.crossJoin(spark.range(n_runs).select(F.col("id").alias("run_index"))).crossJoin(F.broadcast(floor.select("per_item_sd")))
    after = F.col("run_index") >= change_at
    config = F.when(F.col("kind") == "system", F.when(after, F.col("system_after")).otherwise(F.col("system_before"))).otherwise(F.when(after, F.col("anchor_after")).otherwise(F.col("anchor_before")))
    rows = sides.crossJoin(F.broadcast(spread)).withColumn("config", config).join(known, ["config", "item_id"])
    jitter = noise(F.col("stream_id"), F.col("kind"), F.col("run_index").cast("string"), F.col("item_id")) * F.col("per_item_sd") / 4.0
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + jitter))
    obs = rows.select("stream_id", "kind", F.lit(0).alias("epoch"), "run_index", "item_id", score.alias("score"))
    floors = streams.select("stream_id").crossJoin(F.broadcast(floor.select("per_item_sd", "run_mean_sd", "replicates", "n_items")))
    return obs, floors


def scenario_verdicts(obs: DataFrame, floors: DataFrame, config: attribution.Config) -> DataFrame:
    """scenario, verdict, votes: what the full method says most often, and whether that is the cause."""
    said = attribution.decide(obs, floors, config).select(F.split("stream_id", "#")[0].alias("scenario"), F.coalesce("verdict", F.lit("refused")).alias("verdict"))
    modal = tallies.modal_verdict(said, ["scenario"])
    truth = scenarios(obs.sparkSession).select("scenario", "truth")
    return modal.join(truth, "scenario").withColumn("correct", F.col("verdict") == F.col("truth"))


def monitored(obs: DataFrame, baseline: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The system's runs as the single-stream methods see them: runs after the baseline, item sums per run, the baseline's items."""
    rows = obs.where("kind = 'system'")
    per = rows.groupBy("stream_id", "run_index").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    per = per.withColumn("t", (F.row_number().over(Window.partitionBy("stream_id").orderBy("run_index")) - 1 - baseline).cast("long"))
    early = F.col("t") < 0
    means = F.when(early, F.col("s") / F.col("n"))
    total, items, squares = (F.sum(F.when(early, F.col(c))) for c in ("s", "n", "ss"))
    base = per.groupBy("stream_id").agg(F.avg(means).alias("base_mean"), F.stddev_samp(means).alias("base_sd"), items.alias("n0"), (total / items).alias("mean0"), ((squares - total * total / items) / (items - 1)).alias("var0"))
    late = per.where("t >= 0")
    every = per.join(base, "stream_id").withColumn("mean", F.col("s") / F.col("n"))
    return every, late, base


def alarms(obs: DataFrame, floors: DataFrame, config: attribution.Config, target: float = 0.05) -> DataFrame:
    """stream_id, method, alarm_at, verdict of every stream under every method: one union of eight results.

    A method without a control set can only blame the system. alarm_at counts monitored runs from 0.
    """
    every, late, base = monitored(obs, config.baseline_runs)
    mon = every.where("t >= 0")
    fails = every.select("stream_id", "t", F.col("t").alias("i"), (F.col("mean") < F.col("base_mean") - 2.0 * F.col("base_sd")).cast("int").alias("fail"))
    place = F.col("run_index") * (1 << 20) + F.pmod(F.xxhash64("item_id"), F.lit(1 << 20))
    series = obs.where("kind = 'system'").join(every.select("stream_id", "run_index", "t"), ["stream_id", "run_index"]).select("stream_id", "t", place.alias("i"), "score")
    items = base.select("stream_id", "n0", "mean0", "var0")
    single = {
        "threshold": rivals.threshold(mon, target),
        "peeking_t": rivals.t_test(late, items, config.alpha),
        "bonferroni_t": rivals.t_test(late, items, config.alpha, bonferroni=True),
        "cusum": rivals.cusum(mon, target),
        "adwin": rivals.adwin(series, config.alpha),
        "ddm": rivals.ddm(fails),
    }
    decided = attribution.decide(obs, floors, config)
    alone = decided.select("stream_id", F.col("system_crossed_at").cast("long").alias("alarm_at"))
    out = None
    for name, found in [*single.items(), ("system_only", alone)]:
        found = found.select("stream_id", F.lit(name).alias("method"), F.col("alarm_at").cast("long").alias("alarm_at"))
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("verdict", F.when(F.col("alarm_at").isNotNull(), "system").otherwise("stable"))
    full = decided.select("stream_id", F.lit("full").alias("method"), F.col("system_crossed_at").cast("long").alias("alarm_at"), F.coalesce("verdict", F.lit("refused")).alias("verdict"))
    return out.unionByName(full)


def leg_outcomes(runs: DataFrame, keys: list[str], methods: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """keys, method, alarm_at, verdict: what single-leg detectors say when each leg is watched on its own.

    runs: keys, t (negative in the baseline), system and anchor means. The corrected leg is their difference. An alarm
    of the control set is the judge's, one of the corrected leg the system's, one of the system's leg alone undecided.
    alarm_at is the system leg's. The baseline's moments and the detectors' sums are windows of one partitioning.
    """
    legs = F.array(*(F.struct(F.lit(name).alias("leg"), x.alias("mean")) for name, x in [("system", F.col("system")), ("anchor", F.col("anchor")), ("corrected", F.col("system") - F.col("anchor"))]))
    rows = runs.select(*keys, "t", F.inline(legs)).select(F.struct(*keys, "leg").alias("stream_id"), "t", "mean")
    early = F.when(F.col("t") < 0, F.col("mean"))
    whole = Window.partitionBy("stream_id")
    late = rows.withColumn("base_mean", F.avg(early).over(whole)).withColumn("base_sd", F.stddev_samp(early).over(whole)).where("t >= 0")
    found = [detector(late).select("stream_id.*", F.lit(name).alias("method"), "alarm_at") for name, detector in methods.items()]
    at = lambda leg: F.min(F.when(F.col("leg") == leg, F.col("alarm_at")))
    wide = reduce(DataFrame.unionByName, found).groupBy(*keys, "method").agg(at("system").alias("alarm_at"), at("anchor").isNotNull().alias("judge"), at("corrected").isNotNull().alias("system"))
    verdict = F.when(F.col("judge") & F.col("system"), "both").when(F.col("judge"), "judge").when(F.col("system"), "system").when(F.col("alarm_at").isNotNull(), "indeterminate").otherwise("stable")
    return wide.select(*keys, "method", "alarm_at", verdict.alias("verdict"))


def delay_by_shift(outcomes: DataFrame, change_at: int = 0) -> DataFrame:
    """method, shift, median and mean delay of the alarms that came after the change, and how many. outcomes: method, shift, alarm_at."""
    delay = F.when(F.col("alarm_at") >= change_at, F.col("alarm_at") - change_at)
    return outcomes.groupBy("method", "shift").agg(F.percentile(delay, 0.5).alias("median_delay"), F.avg(delay).alias("mean_delay"), F.count(delay).alias("n"))


def delay_ratio(delays: DataFrame, method: str, against: str) -> DataFrame:
    """The mean of a method's median delays over another's. Over no delay at all it is infinite, and of two such means no number."""
    mean = lambda m: F.avg(F.when(F.col("method") == m, F.col("median_delay")))
    a, b = F.col("mean_delay"), F.col("mean_delay_against")
    ratio = F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)  # in ANSI mode, Spark's own quotient is an error there
    return delays.agg(mean(method).alias("mean_delay"), mean(against).alias("mean_delay_against")).withColumn("ratio", ratio)


def guard(rates: DataFrame, most_false_alarms: float = 0.05, least_correct: float = 0.9, most_wrong: float = 0.01) -> DataFrame:
    """failure, value, bound of every headline figure that is out of bounds. rates: one row, false_alarm_rate, judge_correct, judge_as_system."""
    checks = [
        ("false alarms above alpha", "false_alarm_rate", F.col("false_alarm_rate") > most_false_alarms, most_false_alarms),
        ("correct causes under a silent change below the floor", "judge_correct", F.col("judge_correct") < least_correct, least_correct),
        ("instrument changes blamed on the system", "judge_as_system", F.col("judge_as_system") > most_wrong, most_wrong),
    ]
    each = F.array(*(F.when(bad, F.struct(F.lit(text).alias("failure"), F.col(c).alias("value"), F.lit(bound).alias("bound"))) for text, c, bad, bound in checks))
    return rates.select(F.explode(F.array_compact(each)).alias("f")).select("f.*")


def point_null(legs: DataFrame, keys: list[str], order: str, x: str, null: Column, alpha: float) -> DataFrame:
    """The foil: betting against a baseline mean taken as if it were exact. Never used for verdicts."""
    from ..operators.wealth import wealth_trajectory

    rows = wealth_trajectory(legs, keys, order, x, null, "agrapa")
    return rows.withColumn("alarm", F.col("log_wealth") >= math.log(1.0 / alpha))
