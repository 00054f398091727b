"""Betting wealth, composite e-processes and the change-point detector as stacked windows.

With one pseudo-observation (n 1, sum 1/2, squares 1/4) the bet at a step depends on sums over the strict
past, and the running squares on sums so far; so the recursion unrolls into four windows over one ordering.
The detector opens a wealth process at every step j <= t: each row of a leg explodes into its live starts,
windows run per (leg, start), and a log-sum-exp per (leg, t) combines them with weights 1 / ((j+1)(j+2)).
All windows of a leg share the leg's keys as the prefix of their partitioning.

The window form keeps all starts; `kernel` is the same statistic for legs longer than the M starts that may
live at once, where the smallest are dropped for good.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import log_mix

CUT = 0.5  # a bet can't lose more than this share of the wealth at one step
EDGE = 1e-6
LEG = ["stream_id", "leg"]
MOST_STARTS = 256

Bet = Callable[[Column, Column, Column, Column], Column]


def agrapa(mean: Column, var: Column, mu: Column, k: Column) -> Column:
    gap = mean - mu
    return gap / (var + gap * gap)


def predmix(alpha: float = 0.05) -> Bet:
    def bet(mean: Column, var: Column, mu: Column, k: Column) -> Column:
        t = k + 1
        return F.least(F.sqrt(2.0 * F.ln(F.lit(1.0 / alpha)) / (t * F.ln(1.0 + t) * var)), F.lit(CUT))

    return bet


def fixed(value: float = 0.5) -> Bet:
    return lambda mean, var, mu, k: F.lit(value)


BETS: dict[str, Bet] = {"agrapa": agrapa, "predmix": predmix(), "fixed": fixed()}


def inside(mu: Column) -> Column:
    return F.least(F.greatest(mu, F.lit(EDGE)), F.lit(1.0 - EDGE))


def with_wealth(df: DataFrame, keys: list[str], order: str, x: str, mu_up: Column, mu_down: Column, bet: Bet = agrapa) -> DataFrame:
    """df with bet_up, bet_down, up, down: bets and log wealth of both sides after each row."""
    w = Window.partitionBy(*keys).orderBy(order)
    past, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(x)
    df = df.withColumn("k", F.row_number().over(w) - 1).withColumn("mean", (0.5 + F.coalesce(F.sum(value).over(past), F.lit(0.0))) / (F.col("k") + 1))
    df = df.withColumn("dv", F.pow(value - (0.5 + F.sum(value).over(so_far)) / (F.col("k") + 2), 2))
    df = df.withColumn("var", (0.25 + F.coalesce(F.sum("dv").over(past), F.lit(0.0))) / (F.col("k") + 1))
    raw = lambda mu: bet(F.col("mean"), F.col("var"), mu, F.col("k"))
    df = df.withColumn("bet_up", F.least(F.greatest(raw(mu_up), F.lit(0.0)), CUT / mu_up))
    df = df.withColumn("bet_down", F.least(F.greatest(raw(mu_down), -CUT / (1.0 - mu_down)), F.lit(0.0)))
    df = df.withColumn("up", F.sum(F.ln(1.0 + F.col("bet_up") * (value - mu_up))).over(so_far))
    df = df.withColumn("down", F.sum(F.ln(1.0 + F.col("bet_down") * (value - mu_down))).over(so_far))
    return df.drop("mean", "dv", "var")


def hedged(up: Column, down: Column, theta: float = 0.5, combine: str = "max") -> Column:
    if combine == "convex":
        return log_mix(up, down, theta)
    return F.greatest(up + F.ln(F.lit(theta)), down + F.ln(F.lit(1.0 - theta)))


def wealth_trajectory(df: DataFrame, keys: list[str], order: str, x: str, mu: float | Column, strategy: str = "agrapa", combine: str = "max") -> DataFrame:
    """Log wealth of the two-sided process against a point null."""
    mu = F.lit(mu) if not isinstance(mu, Column) else mu
    out = with_wealth(df, keys, order, x, mu, mu, BETS[strategy])
    return out.withColumn("log_wealth", hedged(F.col("up"), F.col("down"), combine=combine))


def composite_trajectory(df: DataFrame, keys: list[str], order: str, x: str, lo: Column, hi: Column, strategy: str = "agrapa") -> DataFrame:
    """Log e-value against all means in [lo, hi]: the up side tests the top, the down side the bottom."""
    out = with_wealth(df, keys, order, x, inside(hi), inside(lo), BETS[strategy])
    return out.withColumn("log_e", hedged(F.col("up"), F.col("down")))


def starts(legs: DataFrame, strategy: str = "agrapa") -> DataFrame:
    """stream_id, leg, t, j, log_e, up, down: every process that is live at t. legs: keys, t, z, null_lo, null_hi."""
    live = legs.select(*LEG, "t", "z", "null_lo", "null_hi", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t"))).alias("j"))
    return composite_trajectory(live, [*LEG, "j"], "t", "z", F.col("null_lo"), F.col("null_hi"), strategy)


def detector_trace(legs: DataFrame, alpha: float, strategy: str = "agrapa") -> DataFrame:
    """stream_id, leg, t, log_e, peak_log_e, alarm (whether the peak has reached 1 / alpha), best_start, direction."""
    live = starts(legs, strategy).withColumn("v", F.col("log_e") - F.ln(F.col("j") + 1.0) - F.ln(F.col("j") + 2.0))
    top = live.withColumn("top", F.max("v").over(Window.partitionBy(*LEG, "t")))
    best = F.max(F.struct("log_e", (-F.col("j")).alias("back"), (F.col("up") >= F.col("down")).alias("rising")))
    at = top.groupBy(*LEG, "t").agg((F.first("top") + F.ln(F.sum(F.exp(F.col("v") - F.col("top"))))).alias("log_e"), best.alias("b"))
    w = Window.partitionBy(*LEG).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = at.withColumn("peak_log_e", F.max("log_e").over(w))
    return out.select(*LEG, "t", "log_e", "peak_log_e", (F.col("peak_log_e") >= F.ln(F.lit(1.0 / alpha))).alias("alarm"), (-F.col("b.back")).alias("best_start"), F.when(F.col("b.rising"), "up").otherwise("down").alias("direction"))


def alarm_times(trace: DataFrame) -> DataFrame:
    return trace.groupBy(*LEG).agg(F.min(F.when(F.col("alarm"), F.col("t"))).alias("alarm_at"), F.max("peak_log_e").alias("peak_log_e"))
