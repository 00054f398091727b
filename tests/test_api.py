import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.api import Bench
from plumbline.config import Settings
from plumbline.plans import adversarial
from plumbline.sources import files

PIN = {"provider": "p", "model": "m", "rubric_hash": "r", "params_hash": "x", "scale": "0..1"}


def test_settings_are_strict():
    assert Settings.parse(Settings(alpha=0.1).dump()).alpha == 0.1
    for bad in ('{"alpha": 0.9}', '{"adapter": "x"}', '{"nope": 1}', '{"fail_on": ["stable"]}', '{"fail_on": ["judge"]}', '{"scale": [1, 0]}'):
        with pytest.raises(ValueError):
            Settings.parse(bad)


def test_verbs_end_to_end(spark, tmp_path):
    settings = Settings(min_runs=2, min_obs=10, baseline_runs=2, anchor_n=20, replicates=2)
    bench = Bench(spark, str(tmp_path / "ledger"), settings)
    rng = np.random.default_rng(0)

    def scorer(items, nonce):
        noise = (F.pmod(F.xxhash64("item_id", F.lit(nonce)), F.lit(1000)) / 1000.0 - 0.5) * 0.1
        return items.select("item_id", (F.lit(0.6) + noise).alias("score"))

    control = bench.baseline(spark.createDataFrame([(f"c{i}", f"s{i % 3}") for i in range(50)], "item_id string, stratum string"), "s", PIN, scorer)
    assert control.count() == 20
    for t in range(4):
        path = tmp_path / f"run{t}.jsonl"
        path.write_text("\n".join(json.dumps({"item_id": f"i{i}", "score": float(np.clip(rng.normal(0.7, 0.05), 0, 1))}) for i in range(12)))
        assert bench.observe(str(path), "s", PIN, scorer=scorer, control=control) == t
    gate = bench.gate().collect()
    assert [(r["verdict"], r["exit_code"]) for r in gate] == [("stable", 0)]
    assert bench.replay().count() == 0
    Bench(spark, bench.path, replace(settings, alpha=0.2, target=0.1)).verdict()  # each is derived again by its own settings
    assert bench.replay().count() == 0
    text = bench.report()
    assert "stable" in text and "no_crossing" in text and bench.report(markdown=True).startswith("## ")
    with pytest.raises(ValueError, match="nothing is provable"):  # two replicates leave too wide a dead zone
        bench.plan("s")
    swapped = tmp_path / "run4.jsonl"
    swapped.write_text("\n".join(json.dumps({"item_id": f"i{i}", "score": 0.7}) for i in range(12)))
    bench.observe(str(swapped), "s", PIN | {"model": "other"})
    assert [r["rule_id"] for r in bench.verdict(record=False).collect()] == ["pin_violation"]


def test_attacks(spark):
    seen = {r["level"]: r.asDict() for r in adversarial.outcomes(spark, "input_shift", 1).collect()}
    assert seen[1.0]["refused"] == 1 and seen[0.0]["refused"] == 0
    seen = {r["level"]: r.asDict() for r in adversarial.outcomes(spark, "evasion", 1).collect()}
    assert seen[1.0]["judge"] == 1 and seen[0.0]["judge"] == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"samples": []}))
    assert files.detect_framework(spark, str(tmp_path)) == "inspect"
    (tmp_path / "b.json").write_text(json.dumps({"results": {"results": []}}))
    assert files.detect_framework(spark, str(tmp_path)) == "promptfoo"
    (tmp_path / "s.jsonl").write_text('{"item_id": "a", "score": 1}\n')
    assert files.looks_like_scores(spark, str(tmp_path / "s.jsonl")) and not files.looks_like_scores(spark, str(tmp_path / "a.json"))
    lines = spark.createDataFrame(list(enumerate(["== one", "refused: a", "ok", "== two", "refused: b"])), "seq long, value string")
    assert [(r["config"], r["kind"]) for r in files.log_sections(lines, "^== (.*)", "^refused: (.*)").orderBy("seq").collect()] == [("one", "a"), ("two", "b")]
    data = spark.createDataFrame([("a", "x")], "item_id string, text string")
    good = data.select("item_id", F.sha2("text", 256).alias("sha256"))
    assert files.verified(data, good).count() == 1
    with pytest.raises(Exception, match="changed row"):
        files.verified(data.withColumn("text", F.lit("y")), good).collect()
