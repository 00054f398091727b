import json
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import student
from plumbline.operators import anchors, kernel, rivals
from plumbline.plans import adversarial, attribution, study
from plumbline.sources import anchor_store, files, generator, ledger


def test_legs_stepped_together_equal_one_by_one():
    rng = np.random.default_rng(0)
    legs, keys = kernel.Legs(), [("a", "x"), ("b", "x"), ("c", "y")]
    single = [kernel.fresh() for _ in keys]
    for t in range(60):
        live = [i for i in range(3) if i < 2 or t < 30]
        x = rng.random(3) * 0.3 + (0.4 if t < 30 else 0.6)
        lo, hi = np.full(3, 0.48), np.full(3, 0.52)
        log_e, start, rising = legs.step(legs.place([keys[i] for i in live]), x[live], lo[live], hi[live], 16)
        for j, i in enumerate(live):
            single[i], want, best, up = kernel.step(single[i], x[i], lo[i], hi[i], 16)
            assert abs(log_e[j] - want) < 1e-9 and start[j] == best and rising[j] == up
            assert abs(legs.peak[i] - single[i]["peak"]) < 1e-9


def test_tail_probabilities_are_expressions(spark):
    rng = np.random.default_rng(1)
    t, df = rng.normal(size=300) * 3, rng.random(300) * 300 + 1
    want = np.array([student.two_sided_p(a, b) for a, b in zip(t, df)])
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, df))] + [(-1, 0.0, 1.0), (-2, None, 1.0)], "i int, t double, df double")
    got = {r["i"]: r["p"] for r in rows.select("i", student.two_sided_p_column(F.col("t"), F.col("df")).alias("p")).collect()}
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-11 and got[-1] == 1.0 and got[-2] is None


def test_dead_zone_is_an_expression(spark):
    rows = spark.createDataFrame([(k,) for k in (2, 3, 5, 64, 65, 500, 100000)], "k long").select("k", student.dead_factor(F.col("k"), 0.05).alias("f")).collect()
    assert all(abs(r["f"] - student.dead_zone_factor(r["k"], 0.05)) < 1e-10 for r in rows)


def test_windows_backend_refuses_long_legs(spark):
    specs = generator.specs(spark, [{"name": "a", "seed": 1, "n_runs": 30, "system_items": 40, "anchor_items": 40}])
    with pytest.raises(Exception, match="too long"):
        attribution.decide(generator.observations(specs), generator.floors(specs), attribution.Config(backend="windows", most_starts=10)).collect()


def test_ledger_names_gaps_and_repeats(spark):
    lines = ledger.chain(spark, [("run", f'{{"i":{i}}}') for i in range(6)])
    whole = ledger.verify(lines).where("hash_ok and link_ok and seq_ok").count()
    gap = {r["seq"]: (r["link_ok"], r["seq_ok"]) for r in ledger.verify(lines.where("seq <> 2")).collect()}
    twice = {r["seq"]: r["seq_ok"] for r in ledger.verify(lines.unionByName(lines.where("seq = 4"))).collect()}
    assert whole == 6 and gap[3] == (False, False) and gap[4] == (True, True)
    assert not twice[4] and not twice[5] and twice[3]


def test_log_sections_carry_over_stretches(spark):
    text = ["== a", "ok 1", "x", "x", "x", "ok 2", "== b", "bad 3", "x", "x", "bad 4"]
    lines = spark.createDataFrame(list(enumerate(text)), "seq long, value string")
    for stretch in (2, 100):
        got = files.log_sections(lines, r"^== ([a-z]+)", r"^(ok|bad) ", stretch).orderBy("seq").collect()
        assert [tuple(r) for r in got] == [(1, "a", "ok"), (5, "a", "ok"), (7, "b", "bad"), (10, "b", "bad")]


def test_listing_is_whole_or_refused(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.json").write_text("{}")
    assert files.listing(spark, str(tmp_path)).count() == 5
    with pytest.raises(ValueError, match="more than 3"):
        files.listing(spark, str(tmp_path), most=3)


def test_control_set_store(spark, tmp_path):
    items = spark.createDataFrame([("a", "q", "r", "d1", 0.5), ("b", "q2", "r2", "d2", 0.25)], anchor_store.SCHEMA)
    anchor_store.save(items, f"{tmp_path}/set")
    anchor_store.save(items, f"{tmp_path}/set")
    assert sorted(map(tuple, anchor_store.load(spark, f"{tmp_path}/set").collect())) == sorted(map(tuple, items.collect()))
    (tmp_path / "bad.json").write_text('{"item_id":"a"}\n\n{"item_id":"b"}\nnot json\n')
    with pytest.raises(ValueError, match="line 3"):
        anchor_store.load(spark, f"{tmp_path}/bad.json")
    (tmp_path / "pairs.json").write_text('{"item_id":"a","prompt_input":"p","output":"o"}\n{"prompt_input":"p"}\n')
    with pytest.raises(Exception, match="without item_id"):
        anchor_store.pairs(spark, f"{tmp_path}/pairs.json").collect()
    anchor_store.check_mode("frozen-self", False)
    for mode, pinned in (("replicate", False), ("other", True)):
        with pytest.raises(ValueError):
            anchor_store.check_mode(mode, pinned)


def test_failed_scorings_are_rows(spark):
    items = spark.createDataFrame([("a", "1", ""), ("b", "x", ""), ("c", "3", "")], "item_id string, prompt_input string, output string")
    got = {r["item_id"]: (r["score"], r["error"]) for r in anchor_store.scored_or_failed(items, lambda a, b: float(a)).collect()}
    assert got["a"] == (1.0, None) and got["c"] == (3.0, None) and got["b"][0] is None and got["b"][1].startswith("ValueError")


def pool_file(path, items=90):
    rng = np.random.default_rng(3)
    level = {f"i{i:03d}": float(rng.uniform(0.4, 0.9)) for i in range(items)}
    moved = lambda d: {k: min(1.0, max(0.0, v + d)) for k, v in level.items()}
    scores = {"a-baseline": level, "b-other-snapshot": moved(-0.15), "c-strict-rubric": moved(-0.2), "d-effort": moved(0.1)}
    scores["d-effort"].pop("i000")
    repeats = [{k: v + float(rng.normal(0, 0.02)) for k, v in level.items()} for _ in range(5)]
    path.write_text(json.dumps({"scores": scores, "replicate_scores": repeats}))


def test_scenarios_composed_from_a_pool(spark, tmp_path):
    pool_file(tmp_path / "pool.json")
    pool, repeats = study.load_pool(spark, str(tmp_path / "pool.json"))
    items = study.common_items(pool)
    assert items.count() == 89 and items.where("item_id = 'i000'").count() == 0
    with pytest.raises(Exception, match="need 100 items"):
        study.halves(items, 50, 50).collect()
    obs, floors = study.compose(spark, pool, repeats, anchor_n=40, system_n=40)
    assert obs.count() == 6 * 60 * 80
    assert obs.groupBy("item_id").agg(F.count_distinct("kind").alias("k")).where("k > 1").count() == 0
    said = {r["scenario"]: r["verdict"] for r in study.scenario_verdicts(obs, floors, attribution.Config()).collect()}
    assert said["drift-free-control"] == "stable" and said["judge-version-bump"] == "judge" and said["system-regression"] == "system"


def test_every_method_on_simulated_streams(spark):
    specs = generator.grid(spark, 1, judge_shift=[0.0, -0.1], system_shift=[0.0, -0.1], n_runs=[60], system_items=[40], anchor_items=[100])
    rows = study.alarms(generator.observations(specs), generator.floors(specs), attribution.Config()).join(generator.truth(specs), "stream_id").collect()
    assert len(rows) == 4 * len(study.METHODS) and {r["method"] for r in rows} == set(study.METHODS)
    by = {(r["method"], r["truth"]): r for r in rows}
    assert by["full", "judge"]["verdict"] == "judge" and by["full", "stable"]["verdict"] == "stable"
    for m in ("threshold", "cusum", "adwin", "system_only"):
        assert by[m, "stable"]["verdict"] == "stable" and by[m, "judge"]["verdict"] == "system" and by[m, "system"]["alarm_at"] is not None, m


def test_order_within_runs_changes_nothing_and_bounds_hold(spark):
    order = {r["level"]: tuple(r)[1:] for r in adversarial.outcomes(spark, "ordering", 1).collect()}
    assert order[0.0] == order[1.0]
    bounds = {r["level"]: r for r in adversarial.outcomes(spark, "bounds", 1).collect()}
    assert bounds[1.0]["stable"] == 1 and bounds[2.0]["system"] == 1


def test_guard_and_warnings(spark):
    good = spark.createDataFrame([(0.0, 1.0, 0.0)], "false_alarm_rate double, judge_correct double, judge_as_system double")
    assert study.guard(good).count() == 0
    assert study.guard(good.withColumn("judge_as_system", F.lit(0.02))).count() == 1
    floor = spark.createDataFrame([(True, 2)], "degenerate boolean, replicates long")
    assert len(anchors.floor_warnings(floor).first()["warnings"]) == 2


def test_bucket_window_equals_lists_of_scores(spark):
    """The exponential histogram against buckets that hold their scores, over streams with and without a change."""

    def brute(xs, delta=0.05):
        window, hits = [], []
        for at, x in enumerate(xs):
            window.append([x])
            while True:
                sizes = [len(b) for b in window]
                full = [n for n in set(sizes) if sizes.count(n) > 5]
                if not full:
                    break
                i = sizes.index(min(full))
                window[i : i + 2] = [window[i] + window[i + 1]]
            while (n := sum(map(len, window))) >= 10:
                flat = np.concatenate(window)
                bounds = np.cumsum([len(b) for b in window])[:-1]
                log_term = np.log(2 * np.log(n) / delta)
                apart = any(
                    abs(flat[:c].mean() - flat[c:].mean()) > np.sqrt(2 * (1 / c + 1 / (n - c)) * flat.var() * log_term) + 2 / 3 * (1 / c + 1 / (n - c)) * log_term for c in bounds if c >= 5 and n - c >= 5
                )
                if not apart:
                    break
                window.pop(0)
                hits.append(at)
        return sorted(set(hits)), [(len(b), sum(b)) for b in window]

    rng = np.random.default_rng(4)
    streams = {f"s{i}": np.clip(rng.normal(0.7 - (0.08 * (i % 4)) * (np.arange(400) >= 250), 0.05 * (1 + i % 3)), 0, 1) for i in range(8)} | {"flat": np.full(300, 0.5), "one": np.array([0.3])}
    rows, want = [], {}
    for name, xs in streams.items():
        window, hits = rivals.Buckets(), []
        for at, x in enumerate(xs):
            if window.add(float(x)):
                hits.append(at)
            held = len(window.buckets())
            assert held <= 6 * (np.log2(at + 1) + 1)
        expected, left = brute(xs)
        assert hits == expected, name
        assert [(int(n), round(s, 6)) for n, s, _ in window.buckets()] == [(n, round(s, 6)) for n, s in left]
        rows += [(name, int(i) // 10 - 5, int(i), float(x)) for i, x in enumerate(xs)]
        late = [h // 10 - 5 for h in hits if h >= 50]
        want[name] = late[0] if late else None
    got = rivals.adwin_buckets(spark.createDataFrame(rows, "stream_id string, t long, i long, score double")).collect()
    assert {r["stream_id"]: r["alarm_at"] for r in got} == want and sum(v is not None for v in want.values()) >= 3


def test_scoring_runs_side_by_side_retries_and_stops_at_a_limit(spark):
    items = spark.createDataFrame([(f"i{n}", str(n), "o") for n in range(160)], "item_id string, prompt_input string, output string").coalesce(1)

    def make():  # each thread has a scorer of its own
        tried = {}

        def score(a, _):
            tried[a] = tried.get(a, 0) + 1
            time.sleep(0.05)
            if int(a) % 10 == 0:
                raise ValueError("no")
            if int(a) % 10 == 1 and tried[a] == 1:
                raise ValueError("once")
            return float(a), 0.5

        return score

    began = time.time()
    rows = {r["item_id"]: r for r in anchor_store.scored_or_failed(items, make, ValueError, workers=16, retries=1, pause=0.0, own=True).collect()}
    assert time.time() - began < 0.05 * 192 * 0.9  # one after the other they take longer
    assert len(rows) == 160 and all(r["score"] == int(i[1:]) and r["calls"] == 1 + (int(i[1:]) % 10 == 1) and r["cost"] == 0.5 for i, r in rows.items() if int(i[1:]) % 10)
    assert all((rows[f"i{n}"]["score"], rows[f"i{n}"]["error"], rows[f"i{n}"]["calls"]) == (None, "ValueError: no", 2) for n in range(0, 160, 10))
    part = anchor_store.score_within(items, lambda a, _: (1.0, 1.0), 30.0, waves=8).collect()
    waves = sorted({r["wave"] for r in part if r["error"] is None})
    cost = [sum(r["cost"] for r in part if r["wave"] == w) for w in range(8)]
    assert len(part) == 160 and waves == list(range(len(waves))) and sum(cost[: len(waves) - 1]) < 30 <= sum(cost)
    assert {r["error"] for r in part if r["wave"] not in waves} == {"spend limit"}

    def broken(a, b):
        raise ValueError("down")

    with pytest.raises(ValueError, match="every call of a wave failed.*down"):
        anchor_store.score_within(items, broken, 30.0, waves=2)


def test_pairs_by_ranks_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(g, f"i{i}", k, float(rng.integers(0, 5)) / 4) for g in ("x", "y") for i in range(9) for k in range(1 + i)]
    got = {r["g"]: r for r in anchors.pairwise_agreement(spark.createDataFrame(rows, "g string, item_id string, replicate int, score double"), ["g"]).collect()}
    for g in ("x", "y"):
        d = [abs(a[3] - b[3]) for a in rows for b in rows if a[0] == b[0] == g and a[1] == b[1] and a[2] < b[2]]
        assert (got[g]["comparisons"], got[g]["max_diff"]) == (len(d), max(d)) and abs(got[g]["mean_abs_diff"] - np.mean(d)) < 1e-12 and abs(got[g]["agreement"] - np.mean(np.array(d) == 0)) < 1e-12


def test_ratio_over_no_delay_is_as_in_sql(spark):
    def ratio(threshold, cusum):
        rows = [("threshold", x) for x in threshold] + [("cusum", x) for x in cusum] + [("cusum_tight", 0.0)]
        return study.delay_ratio(spark.createDataFrame(rows, "method string, median_delay double"), "threshold", "cusum").first()["ratio"]

    con = duckdb.connect()
    for a, b in [(3.0, 0.0), (0.0, 0.0), (None, 0.0), (0.0, 2.0), (3.0, 2.0), (3.0, None)]:
        want = con.execute("SELECT ?::DOUBLE / ?::DOUBLE", [a, b]).fetchall()[0][0]
        got = ratio([a, None], [b, b])
        assert got == want or want != want and got != got, (a, b)
