"""Confidence sequences for a bounded mean: empirical-Bernstein in closed form, hedged capital by grid inversion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wealth import CUT


def _windows(keys: list[str], order: str):
    w = Window.partitionBy(*keys).orderBy(order)
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def with_bets(df: DataFrame, keys: list[str], order: str, x: str, alpha: float, name: str, cut: float | None = CUT) -> DataFrame:
    """df with the predictable-mixture bet `name` of each row, from the rows before it."""
    w, so_far = _windows(keys, order)
    n, sums = F.row_number().over(w), F.sum(x).over(so_far)
    df = df.withColumn("_n", n).withColumn("_mu", F.least((0.5 + sums) / (F.col("_n") + 1), F.lit(1.0)))
    df = df.withColumn("_s2", (0.25 + F.sum(F.pow(F.col(x) - F.col("_mu"), 2)).over(so_far)) / (F.col("_n") + 1))
    raw = F.sqrt(2.0 * F.ln(F.lit(1.0 / alpha)) / (F.col("_n") * F.ln(1.0 + F.col("_n")) * F.lag("_s2", 1, 0.25).over(w)))
    return df.withColumn(name, raw if cut is None else F.least(raw, F.lit(cut))).drop("_n", "_mu", "_s2")


def _lower(df: DataFrame, keys: list[str], order: str, x: str, alpha: float, name: str) -> DataFrame:
    w, so_far = _windows(keys, order)
    df = with_bets(df, keys, order, x, alpha, "_bet")
    df = df.withColumn("_run", F.least(F.avg(x).over(so_far), F.lit(1.0)))
    df = df.withColumn("_v", F.pow(F.col(x) - F.lag("_run", 1, 0.0).over(w), 2))
    bet = F.col("_bet")
    margin = (F.ln(F.lit(1.0 / alpha)) + F.sum(F.col("_v") * (-F.ln(1.0 - bet) - bet)).over(so_far)) / F.sum(bet).over(so_far)
    df = df.withColumn("_bound", F.greatest(F.sum(bet * F.col(x)).over(so_far) / F.sum(bet).over(so_far) - margin, F.lit(0.0)))
    return df.withColumn(name, F.max("_bound").over(so_far)).drop("_bet", "_run", "_v", "_bound")


def empirical_bernstein(df: DataFrame, keys: list[str], order: str, x: str, alpha: float) -> DataFrame:
    """df with cs_lo, cs_hi: a running intersection that holds at all times at once."""
    df = _lower(df, keys, order, x, alpha / 2.0, "cs_lo")
    df = _lower(df.withColumn("_y", 1.0 - F.col(x)), keys, order, "_y", alpha / 2.0, "_up")
    return df.withColumn("cs_hi", 1.0 - F.col("_up")).drop("_y", "_up")


def hedged(df: DataFrame, keys: list[str], order: str, x: str, alpha: float, breaks: int = 1000, theta: float = 0.5) -> DataFrame:
    """keys, order, cs_lo, cs_hi by inverting the capital over a grid of means, widened by one grid step on both sides.

    One row an observation: a sequence's bets are collected in order and folded, and the fold's state is the two arrays
    of log capitals against every mean inside the grid (its ends are never excluded by a finite capital and never in).
    """
    df = with_bets(df, keys, order, x, alpha * theta, "_a", None)
    df = with_bets(df, keys, order, x, alpha * (1.0 - theta), "_b", None)
    bets = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col("_a").alias("a"), F.col("_b").alias("b")))).alias("bets"))
    grid = F.transform(F.sequence(F.lit(1), F.lit(breaks - 1)), lambda i: i / F.lit(float(breaks)))
    none = F.transform(F.sequence(F.lit(1), F.lit(breaks - 1)), lambda _: F.lit(0.0))
    found = f"array<struct<o:{dict(df.dtypes)[order]},lo:double,hi:double>>"
    most, ln = F.ln(F.lit(1.0 / alpha)) + 1e-10, math.log

    def inverted(means: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            up = F.zip_with(acc["up"], means, lambda c, m: c + F.ln(1.0 + F.least(r["a"], CUT / m) * (r["x"] - m)))
            down = F.zip_with(acc["down"], means, lambda c, m: c + F.ln(1.0 - F.least(r["b"], CUT / (1.0 - m)) * (r["x"] - m)))

            def after(c: Column) -> Column:
                capital = F.zip_with(c["up"], c["down"], lambda u, d: F.greatest(ln(theta) + u, ln(1.0 - theta) + d))
                inside = F.filter(F.zip_with(capital, means, lambda v, m: F.when(v <= most, m)), lambda m: m.isNotNull())
                at = F.transform(F.array(inside), lambda i: F.struct(r["o"].alias("o"), F.array_min(i).alias("lo"), F.array_max(i).alias("hi")))
                return F.struct(c["up"].alias("up"), c["down"].alias("down"), F.concat(acc["out"], at).cast(found).alias("out"))

            return F.element_at(F.transform(F.array(F.struct(up.alias("up"), down.alias("down"))), after), 1)

        start = F.struct(none.alias("up"), none.alias("down"), F.array().cast(found).alias("out"))
        return F.aggregate("bets", start, step, lambda acc: acc["out"])

    steps = F.element_at(F.transform(F.array(grid), inverted), 1)
    at = bets.select(*keys, F.explode(steps).alias("s")).select(*keys, F.col("s.o").alias(order), "s.lo", "s.hi")
    one = 1.0 / breaks
    lo = F.coalesce(F.greatest(F.col("lo") - one, F.lit(0.0)), F.lit(0.0))
    hi = F.coalesce(F.least(F.col("hi") + one, F.lit(1.0)), F.lit(1.0))
    _, so_far = _windows(keys, order)
    out = at.withColumn("cs_lo", F.max(lo).over(so_far)).withColumn("cs_hi", F.min(hi).over(so_far))
    middle, crossed = (F.col("cs_lo") + F.col("cs_hi")) / 2.0, F.col("cs_hi") < F.col("cs_lo")
    return out.select(*keys, order, F.when(crossed, middle).otherwise(F.col("cs_lo")).alias("cs_lo"), F.when(crossed, middle).otherwise(F.col("cs_hi")).alias("cs_hi"))


def final(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each sequence."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("last")).select(*keys, *(F.col(f"last.{c}") for c in cols))


def estimated_null(baseline: DataFrame, keys: list[str], order: str, x: str, alpha: float, breaks: int = 200) -> DataFrame:
    """null_lo, null_hi, point: the baseline period's own hedged sequence at half of alpha."""
    at = final(hedged(baseline, keys, order, x, alpha / 2.0, breaks), keys, order)
    return at.select(*keys, F.col("cs_lo").alias("null_lo"), F.col("cs_hi").alias("null_hi")).join(baseline.groupBy(*keys).agg(F.avg(x).alias("point")), keys)


