"""Quota sampling against plain sorting, and verdicts of legs watched on their own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import anchors, rivals
from plumbline.plans import study


def by_sorting(items, n, seed):
    strata = {}
    for item, stratum in items:
        strata.setdefault(stratum, []).append((hashlib.sha256(f"{seed}:{item}".encode()).hexdigest(), item))
    quota = {s: min(len(v), max(len(v) * n // len(items), int(n >= len(strata)))) for s, v in strata.items()}
    ranked = [(quota[s], rank, turn, item) for s, v in strata.items() for rank, (turn, item) in enumerate(sorted(v), 1)]
    chosen = sorted(r for r in ranked if r[1] <= r[0])[:n]
    rest = sorted((r for r in ranked if r[1] > r[0]), key=lambda r: r[2])
    return {r[3] for r in chosen + rest[: n - len(chosen)]}


@pytest.fixture(scope="module")
def strata(spark):
    """A stratum of most items, some of a few, and five of one."""
    rows = [(f"i{k}", "big" if k % 10 < 7 else f"s{k % 7}") for k in range(6000)] + [(f"lone{k}", f"lone{k}") for k in range(5)]
    return rows, spark.createDataFrame(rows, "item_id string, stratum string").repartition(5).cache()


@pytest.mark.parametrize("n", [1, 5, 12, 13, 40, 500, 5999, 6005])  # fewer than strata, trimmed, filled, all
def test_quotas_by_histogram_equal_sorting(strata, n):
    rows, df = strata
    got = [r["item_id"] for r in anchors.stratified_sample(df, n, 7).collect()]
    assert len(got) == n and set(got) == by_sorting(rows, n, 7)


def test_quota_bounds(spark, strata):
    for n in (0, 6006):
        with pytest.raises(ValueError, match="of 6005"):
            anchors.stratified_sample(strata[1], n)
    with pytest.raises(ValueError, match="of 0"):
        anchors.stratified_sample(strata[1].limit(0), 1)


@pytest.mark.parametrize("n", [3, 13, 60, 4500, 7000])
def test_first_of_each_stratum(strata, n):
    rows, df = strata
    groups = {}
    for item, s in sorted(rows):
        groups.setdefault(s, []).append(item)
    quota = n // len(groups)
    want = [i for v in groups.values() for i in v[:quota]]
    rest = [(-len(v), s, k, i) for s, v in groups.items() for k, i in enumerate(v) if k >= quota]
    want += [r[3] for r in sorted(rest)[: n - len(want)]]
    assert sorted(r["item_id"] for r in anchors.head_per_stratum(df, n).collect()) == sorted(want)


def test_tasks_keep_only_what_a_stratum_can_give(strata):
    plan = anchors.head_per_stratum(strata[1], 60)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_verdicts_of_single_legs(spark):
    """Sides that drop by half at t = 5, in every way; one stream without a baseline never alarms."""
    cases = [("none", 0.0, 0.0, -4), ("judge", 0.5, 0.5, -4), ("system", 0.5, 0.0, -4), ("both", 0.9, 0.4, -4), ("slight", 0.3, 0.1, -4), ("young", 0.5, 0.0, 0)]
    rows = [(name, t, 0.8 - (down if t >= 5 else 0.0), 0.7 - (also if t >= 5 else 0.0)) for name, down, also, begin in cases for t in range(begin, 10)]
    runs = spark.createDataFrame(rows, "name string, t long, system double, anchor double")
    out = study.leg_outcomes(runs, ["name"], {"threshold": lambda r: rivals.threshold(r, 0.25)})
    got = {r["name"]: (r["alarm_at"], r["verdict"]) for r in out.collect()}
    assert got == {"none": (None, "stable"), "judge": (5, "judge"), "system": (5, "system"), "both": (5, "both"), "slight": (5, "indeterminate"), "young": (None, "stable")}
    assert study.leg_outcomes(runs.where(F.lit(False)), ["name"], {"threshold": rivals.threshold}).count() == 0
