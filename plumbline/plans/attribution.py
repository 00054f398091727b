"""Who moved: the system, the instrument, both, or can't be told. One plan for all streams at once.

observations -> runs -> frozen baselines -> deviations -> three legs (system, anchor, their difference at
equal run_index) -> detector and confidence sequence per leg -> evidence -> eight ordered rules.

Everything is keyed by stream. The trace has the evidence of every prefix, so `evidence_at` serves one
verdict, a gate after each run, and the replay of all recorded verdicts alike.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.power import min_shift_column
from ..functions.student import dead_factor
from ..operators import confseq, kernel, runs, wealth
from ..sources.shared import written

LEGS = ["system", "anchor", "corrected"]


@dataclass(frozen=True)
class Config:
    alpha: float | Column = 0.05  # columns where every case has its own
    target: float | Column = 0.05
    baseline_runs: int = 8
    replicates: int = 5
    min_runs: int = 8
    min_obs: int = 30
    most_starts: int = wealth.MOST_STARTS
    backend: str = "kernel"  # or "windows": the same on legs of up to most_starts, refused beyond

    @property
    def monitor_alpha(self) -> float | Column:
        return self.alpha - self.alpha / 2.0


def leg_table(obs: DataFrame, floors: DataFrame, config: Config, cases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, legs): legs has stream_id, leg, t, run_index, dev, sd, k, factor of every monitored run.

    cases: stream_id, case, alpha, target; the legs of a stream are repeated for each of its cases, under the case's name.

    floors: stream_id, per_item_sd, run_mean_sd, replicates, n_items of streams with a control set.
    """
    obs = runs.current_epoch(obs)
    every = runs.run_table(obs)
    known = floors.select("stream_id", "replicates", F.greatest("run_mean_sd", F.lit(scores.MIN_SD)).alias("floor_sd"))
    first = F.when(F.col("kind") == "anchor", F.coalesce("replicates", F.lit(2))).otherwise(F.lit(config.baseline_runs))
    every = every.join(known, "stream_id", "left").withColumn("first", first)
    # the last step that reads observations; what follows reads this table of runs, several times
    devs = every = written(runs.deviations(obs, every, runs.item_baseline(obs, every, F.col("first"))), "runs")
    held = devs.where(F.col("place") < F.col("first")).groupBy(*runs.STREAM).agg(runs.floored_sd(F.col("dev")).alias("held_sd"), F.count(F.lit(1)).alias("held"), F.max("first").cast("long").alias("k"))
    case = []
    if cases is not None:
        held, case = held.join(cases, "stream_id"), ["alpha", "target"]
    # a row a stream, kind and case: the quantile is searched for here, not at every run
    held = held.withColumn("factor", dead_factor(F.col("k"), config.alpha))
    devs = devs.join(held, runs.STREAM)
    if cases is not None:
        devs = devs.drop("stream_id").withColumnRenamed("case", "stream_id")
    watched = devs.where(F.col("place") >= F.col("first"))
    sd = F.when(F.col("kind") == "anchor", F.coalesce("floor_sd", F.lit(scores.MIN_SD))).otherwise(F.col("held_sd"))
    own = watched.select("stream_id", F.col("kind").alias("leg"), (F.col("place") - F.col("first")).cast("long").alias("t"), "run_index", "dev", sd.alias("sd"), "k", "factor", *case)
    return every, own.unionByName(corrected(own, config))


def corrected(own: DataFrame, config: Config) -> DataFrame:
    """The difference leg: system minus anchor deviation at equal run_index, numbered anew; none with fewer than two pairs."""
    side = lambda c, leg: F.max(F.when(F.col("leg") == leg, F.col(c)))
    case = [c for c in ("alpha", "target") if c in own.columns]
    pairs = own.groupBy("stream_id", "run_index", *case).agg(*(side(c, leg).alias(f"{c}_{leg[0]}") for c in ("dev", "sd", "k", "factor") for leg in ("system", "anchor")))
    w = Window.partitionBy("stream_id")
    pairs = pairs.where("dev_s is not null and dev_a is not null").withColumn("pairs", F.count(F.lit(1)).over(w)).where("pairs >= 2")
    t = F.row_number().over(w.orderBy("run_index")) - 1
    sd = F.greatest(F.sqrt(F.col("sd_s") * F.col("sd_s") + F.col("sd_a") * F.col("sd_a")), F.lit(scores.MIN_SD))
    k, factor = F.least("k_a", "k_s"), F.when(F.col("k_a") <= F.col("k_s"), F.col("factor_a")).otherwise(F.col("factor_s"))
    return pairs.select("stream_id", F.lit("corrected").alias("leg"), t.cast("long").alias("t"), "run_index", (F.col("dev_s") - F.col("dev_a")).alias("dev"), sd.alias("sd"), k.alias("k"), factor.alias("factor"), *case)


def scaled(legs: DataFrame, config: Config) -> DataFrame:
    """legs with z (for detection), y (for estimation), their half widths, and the null interval."""
    width, wide = scores.detection_width(config.target, F.col("sd")), scores.estimation_width(config.target, F.col("sd"))
    half = F.col("sd") * F.col("factor") / (2.0 * F.col("width"))
    legs = legs.withColumn("width", width).withColumn("wide", wide).withColumn("half", half)
    return legs.select(
        "stream_id", "leg", "t", "run_index", "dev", "wide",
        scores.to_unit(F.col("dev"), F.col("width")).alias("z"),
        scores.to_unit(F.col("dev"), F.col("wide")).alias("y"),
        F.greatest(F.lit(0.0), 0.5 - F.col("half")).alias("null_lo"),
        F.least(F.lit(1.0), 0.5 + F.col("half")).alias("null_hi"),
        *(c for c in ("alpha", "target") if c in legs.columns),
    )


def trace(legs: DataFrame, config: Config) -> DataFrame:
    """Of every leg and t: e-value so far, first alarm, shift interval, saturation.

    Legs are short and many, so they are dealt by stream once; all windows and groups below include the
    stream in their keys and need no further exchange.
    """
    rows = scaled(legs, config).repartition("stream_id")
    if config.backend == "windows":
        long = F.raise_error(F.concat(F.lit("leg too long for the windows backend: "), "stream_id")).cast("long")
        found = wealth.detector_trace(rows.withColumn("t", F.when(F.col("t") < config.most_starts, F.col("t")).otherwise(long)), 1.0)
    else:
        found = kernel.detector_trace(rows, 1.0, config.most_starts)
    found = found.select(*wealth.LEG, "t", "log_e", "peak_log_e", "best_start", "direction")
    cs = confseq.empirical_bernstein(rows, wealth.LEG, "t", "y", config.monitor_alpha)
    w = Window.partitionBy(*wealth.LEG).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cs = cs.withColumn("saturated", F.max((F.col("y") <= 0) | (F.col("y") >= 1)).over(w))
    out = cs.join(found, [*wealth.LEG, "t"]).withColumn("alarm", F.col("peak_log_e") >= F.ln(1.0 / F.lit(config.monitor_alpha)))
    back = lambda c: scores.from_unit(F.col(c), F.col("wide"))
    return out.select(*wealth.LEG, "t", "run_index", "log_e", "peak_log_e", "alarm", F.min(F.when(F.col("alarm"), F.col("t"))).over(w).alias("crossed_at"), back("cs_lo").alias("shift_lo"), back("cs_hi").alias("shift_hi"), "saturated", "best_start", "direction")


def _known_at(traced: DataFrame, every: DataFrame, points: DataFrame) -> DataFrame:
    """stream_id, at: each leg's last trace row and the runs so far, carried forward along every stream in one pass."""
    key = ["stream_id", "run_index"]
    cols = ["t", "peak_log_e", "alarm", "crossed_at", "shift_lo", "shift_hi", "saturated"]
    legs = traced.groupBy(*key).agg(*(F.max(F.when(F.col("leg") == leg, F.struct(*cols))).alias(leg) for leg in LEGS))
    pinned = "judge_pin" in every.columns
    system = F.col("kind") == "system"
    facts = [F.max(F.when(system, F.struct("suite_hash", "n"))).alias("run")]
    if pinned:
        first = Window.partitionBy("stream_id", "kind").orderBy("run_index")
        every = every.withColumn("delta", scores.differing_fields(F.col("judge_pin"), F.first("judge_pin").over(first)))
        facts += [F.max(F.array_contains("delta", f)).alias(f"pin_{f}") for f in scores.PIN_FIELDS] + [F.max(system & (F.size("delta") > 0)).alias("pin_moved")]
    runs_ = every.groupBy(*key).agg(*facts)
    marks = points.select("stream_id", F.col("at").alias("run_index"), F.lit(True).alias("asked")).distinct()
    rows = runs_.join(legs, key, "full").join(marks, key, "full")
    w = Window.partitionBy("stream_id").orderBy("run_index").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(leg, ignorenulls=True).over(w).alias(leg) for leg in LEGS]
    seen = F.count("run").over(w)
    suite = [seen.alias("n_runs"), (F.coalesce(F.min("run.suite_hash").over(w) == F.max("run.suite_hash").over(w), F.lit(True))).alias("suite_agrees"), F.last("run", ignorenulls=True).over(w)["n"].alias("last_n")]
    pins = []
    if pinned:
        ever = [F.when(F.max(f"pin_{f}").over(w), F.lit(f)) for f in scores.PIN_FIELDS]
        pins = [F.array_sort(F.array_compact(F.array(*ever))).alias("pin_delta"), F.min(F.when(F.col("pin_moved"), F.col("run_index"))).over(w).alias("pin_changed_at")]
    rows = rows.select("stream_id", F.col("run_index").alias("at"), "asked", *last, *suite, *pins).where("asked")
    return rows.select("stream_id", "at", *(F.col(f"{leg}.{c}").alias(f"{leg}_{c}") for leg in LEGS for c in cols), "n_runs", "suite_agrees", "last_n", *(["pin_delta", "pin_changed_at"] if pinned else []))


def evidence_at(traced: DataFrame, every: DataFrame, floors: DataFrame, points: DataFrame, config: Config) -> DataFrame:
    """Evidence, rule and verdict of each (stream_id, at): what was known when run_index `at` was the last.

    every: the run table, with judge_pin where pins are known. points: stream_id, at, and alpha and target where
    config has them as columns.
    """
    out = _known_at(traced, every, points)
    if {"alpha", "target"} <= set(points.columns):
        out = out.join(points.select("stream_id", "alpha", "target").distinct(), "stream_id")
    changed = F.coalesce(F.size("pin_delta") > 0, F.lit(False)) if "judge_pin" in every.columns else F.lit(False)
    known = floors.select("stream_id", "per_item_sd", F.greatest("run_mean_sd", F.lit(scores.MIN_SD)).alias("floor_sd"), "replicates", "n_items", *(c for c in ("alpha", "target") if c in points.columns))
    out = out.join(known.withColumn("floor_factor", dead_factor(F.col("replicates"), config.alpha)).drop("alpha", "target"), "stream_id", "left")
    n_anchor = F.coalesce(F.col("anchor_t") + 1, F.lit(0))
    mds = min_shift_column(F.col("n_items"), F.col("per_item_sd"), F.col("floor_sd"), F.col("n_items"), F.col("floor_factor"), F.greatest(n_anchor, F.lit(1)), config.alpha, config.target)
    shift = (F.coalesce("system_shift_lo", F.lit(0.0)) + F.coalesce("system_shift_hi", F.lit(0.0))) / 2.0
    out = out.withColumn("n_anchor_runs", n_anchor).withColumn("min_shift", F.when(n_anchor > 0, mds)).withColumn("system_shift", shift)
    out = out.withColumn("corrected_lo", F.coalesce("corrected_shift_lo", F.col("system_shift_lo") - F.col("anchor_shift_hi"))).withColumn("corrected_hi", F.coalesce("corrected_shift_hi", F.col("system_shift_hi") - F.col("anchor_shift_lo")))
    facts = {"pin_changed": changed, "suite_agrees": F.coalesce("suite_agrees", F.lit(True)), "n_runs": F.coalesce("n_runs", F.lit(0)), "last_n": F.coalesce("last_n", F.lit(0))}
    facts |= {f"{leg}_crossed": F.coalesce(f"{leg}_alarm", F.lit(False)) for leg in LEGS}
    facts["adequate"] = F.coalesce(F.col("min_shift") < F.abs("system_shift"), F.lit(False))
    out = out.withColumn("adequate", facts["adequate"]).withColumn("rule_id", scores.rule(facts, config.min_runs, config.min_obs))
    return out.withColumn("verdict", scores.verdict_of(F.col("rule_id"))).withColumn("refused", F.col("verdict").isNull())


def decide(obs: DataFrame, floors: DataFrame, config: Config = Config(), pins: DataFrame | None = None) -> DataFrame:
    """One row per stream: evidence, rule, verdict; refusals are rows too. pins: stream_id, kind, run_index, judge_pin."""
    every, legs = leg_table(obs, floors, config)
    if pins is not None:
        every = every.join(pins, [*runs.STREAM, "run_index"], "left")
    points = every.groupBy("stream_id").agg(F.max("run_index").alias("at"))
    return evidence_at(trace(legs, config), every, floors, points, config)


def every_prefix(obs: DataFrame, floors: DataFrame, config: Config = Config(), pins: DataFrame | None = None) -> DataFrame:
    """The verdict after each run of each stream, from one trace."""
    every, legs = leg_table(obs, floors, config)
    if pins is not None:
        every = every.join(pins, [*runs.STREAM, "run_index"], "left")
    points = every.where("kind = 'system'").select("stream_id", F.col("run_index").alias("at"))
    return evidence_at(trace(legs, config), every, floors, points, config)


def by_settings(obs: DataFrame, floors: DataFrame, asked: DataFrame, config: Config = Config(), pins: DataFrame | None = None) -> DataFrame:
    """The verdict of each (stream_id, at, alpha, target) of asked by its own settings, all from one trace.

    A stream is traced once for each pair of alpha and target that it is asked for, however many verdicts that is.
    """
    case = F.concat_ws("\x01", "stream_id", F.col("alpha").cast("string"), F.col("target").cast("string"))
    asked = asked.select("stream_id", "at", "alpha", "target").distinct().withColumn("case", case)
    cases = asked.select("stream_id", "case", "alpha", "target").distinct()
    config = replace(config, alpha=F.col("alpha"), target=F.col("target"))
    every, legs = leg_table(obs, floors, config, cases)
    if pins is not None:
        every = every.join(pins, [*runs.STREAM, "run_index"], "left")

    def named(df: DataFrame) -> DataFrame:
        """df for every case, under the case's name."""
        return df.join(cases, "stream_id").drop("stream_id").withColumnRenamed("case", "stream_id")

    points = asked.drop("stream_id").withColumnRenamed("case", "stream_id")
    out = evidence_at(trace(legs, config), named(every).drop("alpha", "target"), named(floors), points, config)
    back = cases.select(F.col("case").alias("stream_id"), F.col("stream_id").alias("stream"))
    return out.join(back, "stream_id").drop("stream_id").withColumnRenamed("stream", "stream_id")


def strict(decisions: DataFrame) -> DataFrame:
    """Raises on the first refusal, for callers that want an error instead of a row."""
    text = F.concat(F.lit("cannot attribute stream "), "stream_id", F.lit(": "), "rule_id")
    return decisions.withColumn("verdict", F.when(F.col("refused"), F.raise_error(text)).otherwise(F.col("verdict")))
