"""Competing change detectors over the same runs: threshold, t-test, CUSUM, DDM, ADWIN.

runs: stream_id, t (monitored place from 0), mean, and base_mean / base_sd of the stream's baseline runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student import two_sided_p_column

KEY = ["stream_id"]


def _so_far():
    return Window.partitionBy(*KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)


def first_time(rows: DataFrame, hit: Column) -> DataFrame:
    """stream_id, alarm_at: null where it never happens."""
    return rows.groupBy(*KEY).agg(F.min(F.when(hit, F.col("t"))).alias("alarm_at"))


def threshold(runs: DataFrame, drop: float = 0.05) -> DataFrame:
    return first_time(runs, F.col("base_mean") - F.col("mean") > drop)


def cusum_trace(runs: DataFrame, target: float = 0.05) -> DataFrame:
    """high, low: Page's sums as a walk minus its running minimum (at most 0), so no recursion is left."""
    dev = F.col("mean") - F.col("base_mean")
    w = _so_far()
    walks = runs.withColumn("a", F.sum(dev - target / 2).over(w)).withColumn("b", F.sum(-dev - target / 2).over(w))
    floor = lambda c: F.least(F.lit(0.0), F.min(c).over(w))
    return walks.withColumn("high", F.col("a") - floor("a")).withColumn("low", F.col("b") - floor("b")).drop("a", "b")


def cusum(runs: DataFrame, target: float = 0.05, sds: float = 5.0) -> DataFrame:
    limit = sds * F.greatest(F.coalesce("base_sd", F.lit(1e-6)), F.lit(1e-9))
    return first_time(cusum_trace(runs, target), (F.col("high") > limit) | (F.col("low") > limit))


def welch_trace(items: DataFrame, base: DataFrame) -> DataFrame:
    """t_stat and df of the pooled baseline items against all monitored items so far.

    items: stream_id, t, n, s, ss (count, sum and sum of squares per monitored run); base: stream_id, n0, mean0, var0.
    """
    w = _so_far()
    rows = items.select(*KEY, "t", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"), F.sum("ss").over(w).alias("ss")).join(base, KEY)
    rows = rows.withColumn("m", F.col("s") / F.col("n")).withColumn("v", (F.col("ss") - F.col("n") * F.col("m") * F.col("m")) / (F.col("n") - 1))
    a, b = F.col("var0") / F.col("n0"), F.col("v") / F.col("n")
    ok = (F.col("n") >= 2) & (F.col("n0") >= 2) & (a + b > 0)
    t = F.when(ok, (F.col("mean0") - F.col("m")) / F.sqrt(a + b))
    df = F.when(ok, F.pow(a + b, 2) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n") - 1)))
    return rows.select(*KEY, "t", t.alias("t_stat"), df.alias("df"))


def t_test(items: DataFrame, base: DataFrame, alpha: float = 0.05, bonferroni: bool = False) -> DataFrame:
    """Alarm of the t-test repeated at every look, at alpha or alpha / look."""
    rows = welch_trace(items, base).withColumn("p", two_sided_p_column(F.col("t_stat"), F.col("df")))
    return first_time(rows, F.col("p") < (F.lit(alpha) / (F.col("t") + 1) if bonferroni else F.lit(alpha)))


def ddm_trace(outcomes: DataFrame) -> DataFrame:
    """outcomes: stream_id, t, i (place), fail (0 or 1). rate, sd, and the smallest rate + sd so far with its parts."""
    w = Window.partitionBy(*KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = outcomes.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("i"))).withColumn("rate", F.avg("fail").over(w))
    rows = rows.withColumn("sd", F.sqrt(F.col("rate") * (1.0 - F.col("rate")) / F.col("n")))
    best = F.min(F.when(F.col("n") >= 30, F.struct((F.col("rate") + F.col("sd")).alias("level"), F.col("rate").alias("p"), F.col("sd").alias("s")))).over(w)
    return rows.withColumn("best", best)


def ddm(outcomes: DataFrame, drift: float = 3.0) -> DataFrame:
    """Drift when the error rate stands `drift` SDs above its lowest point (Gama and others, 2004)."""
    rows = ddm_trace(outcomes)
    return first_time(rows.where("t >= 0"), F.col("rate") + F.col("sd") > F.col("best.p") + drift * F.col("best.s"))


def adwin_cut(window: np.ndarray, delta: float) -> int:
    """Where an adaptive window splits (Bifet and Gavalda, 2007): the first cut whose means differ too much, or 0."""
    n = len(window)
    if n < 10:
        return 0
    sums = np.cumsum(window)
    left = np.arange(5, n - 4)
    right = n - left
    gap = np.abs(sums[left - 1] / left - (sums[-1] - sums[left - 1]) / right)
    harmonic = 1.0 / (1.0 / left + 1.0 / right)
    log_term = np.log(2.0 * np.log(n) / delta)
    bound = np.sqrt(2.0 / harmonic * window.var() * log_term) + 2.0 / (3.0 * harmonic) * log_term
    hits = np.flatnonzero(gap > bound)
    return int(left[hits[-1]]) if len(hits) else 0


def adwin(scores: DataFrame, delta: float = 0.05, every: int = 32) -> DataFrame:
    """scores: stream_id, t (below 0 in the baseline), i, score. The window's cuts depend on the data, so this runs per stream in Arrow batches."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, t = pdf["score"].to_numpy(), pdf["t"].to_numpy()
        lo, alarm = 0, None
        for end in range(every, len(x) + every, every):
            end = min(end, len(x))
            cut = adwin_cut(x[lo:end], delta)
            while cut:
                lo += cut
                if t[end - 1] >= 0 and alarm is None:
                    alarm = int(t[end - 1])
                cut = adwin_cut(x[lo:end], delta)
        return pd.DataFrame({"stream_id": [key[0]], "alarm_at": pd.array([alarm], "Int64")})

    return scores.groupBy(*KEY).applyInPandas(run, "stream_id string, alarm_at long")


class Buckets:
    """An adaptive window kept as an exponential histogram (Bifet and Gavalda, 2007): O(log n) numbers for n scores.

    A bucket is a count (a power of two), a sum and a sum of squares. Of each count there are at most `per_size`
    buckets; one more, and the two oldest of it become one of twice the count. After every score the window is tested
    at every boundary between buckets, and its oldest bucket goes while any test finds the two sides apart.
    """

    def __init__(self, delta: float = 0.05, per_size: int = 5):
        self.delta, self.per_size = delta, per_size
        self.sizes: list[list[tuple[float, float, float]]] = []  # of each power of two, the oldest bucket first

    def add(self, score: float) -> bool:
        """Takes a score in; whether the window then lost its oldest scores."""
        new = (1.0, score, score * score)
        for size in self.sizes:
            size.append(new)
            if len(size) <= self.per_size:
                break
            a, b = size[:2]
            del size[:2]
            new = (a[0] + b[0], a[1] + b[1], a[2] + b[2])
        else:
            self.sizes.append([new])
        shrunk = False
        while self._apart():
            while not self.sizes[-1]:
                self.sizes.pop()
            self.sizes[-1].pop(0)
            shrunk = True
        return shrunk

    def buckets(self) -> np.ndarray:
        """Count, sum and squares of every bucket, the oldest first."""
        return np.array([b for size in reversed(self.sizes) for b in size]).reshape(-1, 3)

    def _apart(self) -> bool:
        sums = np.cumsum(self.buckets(), axis=0)
        n, total, squares = sums[-1] if len(sums) else (0.0, 0.0, 0.0)
        if n < 10:
            return False
        left, s = sums[:-1, 0], sums[:-1, 1]
        fine = (left >= 5) & (n - left >= 5)
        left, s = left[fine], s[fine]
        share = 1.0 / left + 1.0 / (n - left)
        log_term = np.log(2.0 * np.log(n) / self.delta)
        spread = max(squares / n - (total / n) ** 2, 0.0)
        return bool((np.abs(s / left - (total - s) / (n - left)) > np.sqrt(2.0 * share * spread * log_term) + 2.0 / 3.0 * share * log_term).any())


def adwin_buckets(scores: DataFrame, delta: float = 0.05) -> DataFrame:
    """As adwin(), tested at every score, from an exponential histogram: a task reads its streams score by score and holds one histogram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, window, alarm = None, None, None
        for batch in batches:
            done = []
            for name, t, score in zip(batch["stream_id"], batch["t"], batch["score"]):
                if name != stream or window is None:
                    if window is not None:
                        done.append((stream, alarm))
                    stream, window, alarm = name, Buckets(delta), None
                if window.add(score) and t >= 0 and alarm is None:
                    alarm = t
            yield pd.DataFrame(done, columns=["stream_id", "alarm_at"]).astype({"stream_id": "object", "alarm_at": "Int64"})
        if window is not None:
            yield pd.DataFrame({"stream_id": [stream], "alarm_at": pd.array([alarm], "Int64")})

    rows = scores.select(*KEY, "t", "i", "score").repartition(*KEY).sortWithinPartitions(*KEY, "i")
    return rows.mapInPandas(run, "stream_id string, alarm_at long")
