"""How small a shift a control set of n items can prove within a horizon, and how many items a target needs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .student import dead_zone_factor

SAFETY = 2.6
BAND_SDS = 4.0
HALVINGS = 80
MOST_ITEMS = 100_000


@dataclass(frozen=True)
class Floor:
    """A measured noise floor: item SD, run-mean SD, of K scorings of n items."""

    per_item_sd: float
    run_mean_sd: float
    replicates: int = 5
    n_items: int = 200

    @property
    def shared_variance(self) -> float:
        return max(0.0, self.run_mean_sd**2 - self.per_item_sd**2 / self.n_items)

    def sigma(self, n: int) -> float:
        return math.sqrt(self.shared_variance + self.per_item_sd**2 / n)


def needed_evidence(alpha: float) -> float:
    return SAFETY * (math.log(2.0 / alpha) + math.log(2.0))


def min_horizon(alpha: float) -> int:
    """Runs below which nothing is provable: one run gains at most ln(1.5)."""
    return math.ceil(needed_evidence(alpha) / math.log(1.5))


def growth(drift: float, sigma: float) -> float:
    """Log wealth a run gains at this drift, both in units of the band; the bet is capped at 1."""
    if drift <= 0.0:
        return 0.0
    bet = min(drift / (sigma**2 + drift**2), 1.0)
    return math.log1p(bet * drift) - (bet * sigma / (1.0 + bet * drift)) ** 2 / 2.0


def min_shift(n: int, floor: Floor, alpha: float, horizon: int, band_sds: float = BAND_SDS) -> float:
    """The smallest provable shift, rounded up; infinite if even one that fills the band is not provable."""
    if n < 1 or horizon < 1:
        raise ValueError("a control set and a horizon of at least 1 are needed")
    sigma = floor.sigma(n)
    dead, band = sigma * dead_zone_factor(floor.replicates, alpha), band_sds * sigma
    need, unit = needed_evidence(alpha), 2.0 * band

    def enough(shift: float) -> bool:
        return horizon * growth(min((shift - dead) / unit, 0.5), sigma / unit) >= need

    lo, hi = dead, dead + unit
    if not enough(hi):
        return math.inf
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2.0
        lo, hi = (lo, mid) if enough(mid) else (mid, hi)
    return hi


def min_items(target: float, floor: Floor, alpha: float, horizon: int, obs_per_run: int) -> int:
    """The fewest items that prove the target and are no noisier than a run; ValueError if none do."""

    def first(ok) -> int:
        hi = 1
        while not ok(hi):
            hi *= 2
            if hi > 2 * MOST_ITEMS:
                raise ValueError(f"no control set of up to {MOST_ITEMS} items proves a shift of {target:g} within {horizon} runs at alpha {alpha:g}; nothing is provable in fewer than {min_horizon(alpha)}")
        lo = hi // 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if ok(mid) else (mid, hi)
        if hi > MOST_ITEMS:
            raise ValueError(f"more than {MOST_ITEMS} items would be needed for a shift of {target:g}")
        return hi

    return max(first(lambda n: min_shift(n, floor, alpha, horizon) <= target), first(lambda n: floor.sigma(n) <= floor.sigma(obs_per_run)))


def plan(floor: Floor, target: float = 0.05, alpha: float = 0.05, horizon: int = 50, obs_per_run: int = 40) -> dict:
    """The recommended size, what it proves, and what four times as many items would."""
    n = min_items(target, floor, alpha, horizon, obs_per_run)
    now = min_shift(n, floor, alpha, horizon)
    return {"n": n, "min_shift": now, "min_shift_at_4n": min_shift(4 * n, floor, alpha, horizon), "shared_sd": math.sqrt(floor.shared_variance), "min_horizon": min_horizon(alpha), "target": target, "horizon": horizon, "alpha": alpha}


def min_shift_column(n: Column, per_item_sd: Column, run_mean_sd: Column, n_items: Column, dead_factor: Column, horizon: Column, alpha: float | Column, target: float | Column) -> Column:
    """min_shift for a column of control sets, with the band the running detector has. Null: nothing is provable.

    The bisection is one aggregate() over its 80 steps, so it stays in the JVM.
    """
    sigma = F.sqrt(F.greatest(F.lit(0.0), run_mean_sd * run_mean_sd - per_item_sd * per_item_sd / n_items) + per_item_sd * per_item_sd / n)
    need = SAFETY * (F.ln(2.0 / alpha) + math.log(2.0)) if isinstance(alpha, Column) else needed_evidence(alpha)

    def enough(shift: Column, g: Column) -> Column:
        drift, s = F.least((shift - g["dead"]) / g["unit"], F.lit(0.5)), g["sigma"] / g["unit"]
        bet = F.least(drift / (s * s + drift * drift), F.lit(1.0))
        gain = F.ln(1.0 + bet * drift) - F.pow(bet * s / (1.0 + bet * drift), 2) / 2.0
        return g["runs"] * F.when(drift <= 0.0, 0.0).otherwise(gain) >= need

    def search(g: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2.0
            ok = enough(mid, g)
            return F.struct(F.when(ok, acc["lo"]).otherwise(mid).alias("lo"), F.when(ok, mid).otherwise(acc["hi"]).alias("hi"))

        top = g["dead"] + g["unit"]
        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(g["dead"].alias("lo"), top.alias("hi")), halve, lambda acc: acc["hi"])
        return F.when(enough(top, g), found)

    def geometry(s: Column) -> Column:
        band = F.when(s <= 0.0, BAND_SDS).otherwise(F.greatest(F.lit(BAND_SDS), target / s)) * s
        return F.struct(s.alias("sigma"), (s * dead_factor).alias("dead"), (band * 2.0).alias("unit"), horizon.alias("runs"))

    # one-element arrays bind what is used many times to a name
    return F.transform(F.transform(F.array(sigma), geometry), search)[0]
