import json
import zipfile
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import power, scores, student
from plumbline.sources import generator, ingest, ledger
from plumbline.sources.score_cache import ScoreCache


def issues(df):
    return {r["item_id"]: (r["issue"], r["normalised"]) for r in df.collect()}


def test_json_lines(spark, tmp_path):
    lines = ['// comment', "", '{"item_id": "a", "score": 3}', '{"id": "b", "value": true}', '{"item_id": "c", "score": "4"}', '{"item_id": "d", "score": 6}', '{"item_id": "e"}', '{"item_id": "f", "score": 1}', '{"item_id": "f", "score": 2}', '{"item_id": "g", "score": 2, "value": 3}', '{"score": 2}', "not json", "[1]"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = ingest.load(spark, "jsonl", str(tmp_path / "x.jsonl"), 1.0, 5.0)
    got = issues(rows)
    assert got["a"] == (None, 0.5) and got["b"] == (None, 0.0)
    assert {k: v[0] for k, v in got.items() if k and k in "cdefg"} == {"c": "no numeric score", "d": "score out of range", "e": "no numeric score", "f": "duplicate item id", "g": "two names with different values"}
    assert {r["issue"] for r in rows.where("item_id is null").collect()} == {"no item id", "not JSON", "not an object"}
    with pytest.raises(ValueError, match="out of range"):
        ingest.strict(rows)


def test_promptfoo(spark, tmp_path):
    entry = lambda **k: k
    nested = {"results": {"results": [entry(testCase={"description": "t1"}, score=0.5), entry(testCase={"vars": {"id": "t2"}}, gradingResult={"score": 1}), entry(success=True), entry(id="t4", namedScores={"m": 0.25})]}}
    (tmp_path / "n.json").write_text(json.dumps(nested))
    got = issues(ingest.load(spark, "promptfoo", str(tmp_path / "n.json"), 0.0, 1.0))
    assert got == {"t1": (None, 0.5), "t2": (None, 1.0), "test-2": (None, 1.0), "t4": (None, 0.25)}
    (tmp_path / "f.json").write_text(json.dumps({"results": [entry(id="x", namedScores={"a": 1, "b": 0})]}))
    assert issues(ingest.load(spark, "promptfoo", str(tmp_path / "f.json"), 0.0, 1.0))["x"][0] == "several named scores and no overall one"
    (tmp_path / "b.json").write_text(json.dumps([entry(id="y", score=1)]))
    assert issues(ingest.load(spark, "promptfoo", str(tmp_path / "b.json"), 0.0, 1.0)) == {"y": (None, 1.0)}


def test_deepeval(spark, tmp_path):
    cases = {"testCases": [{"name": "a", "metricsData": [{"name": "m", "score": 0.5}]}, {"name": "b", "metricsData": [{"name": "m", "score": 1.0}, {"name": "n", "score": 0.0}]}, {"success": False}]}
    (tmp_path / "d.json").write_text(json.dumps(cases))
    got = issues(ingest.load(spark, "deepeval", str(tmp_path / "d.json"), 0.0, 1.0))
    assert got["a"] == (None, 0.5) and got["b"][0] == "several metrics and none named" and got["case-2"] == (None, 0.0)
    named = issues(ingest.load(spark, "deepeval", str(tmp_path / "d.json"), 0.0, 1.0, metric="n"))
    assert named["b"] == (None, 0.0) and named["a"][0] == "no metric of that name"


def test_inspect_log_plain_and_zipped(spark, tmp_path):
    log = {"samples": [{"id": "s1", "scores": {"acc": {"value": "C"}}}, {"id": 2, "scores": {"acc": {"value": "P"}}}, {"id": "s3", "scores": {"acc": {"value": 0.25}, "other": {"value": "I"}}}, {"id": "s4", "scores": {"acc": {"value": "maybe"}}}]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    with zipfile.ZipFile(tmp_path / "log.eval", "w") as z:
        z.writestr("a.json", json.dumps({"samples": []}))
        z.writestr("b.json", json.dumps(log))
    for name in ("log.json", "log.eval"):
        got = issues(ingest.load(spark, "inspect", str(tmp_path / name), 0.0, 1.0))
        assert got["s1"] == (None, 1.0) and got["2"] == (None, 0.5) and got["s3"][0] == "several scorers and none named" and got["s4"][0] == "no numeric score"
        assert issues(ingest.load(spark, "inspect", str(tmp_path / name), 0.0, 1.0, scorer="other"))["s3"] == (None, 0.0)


def test_ledger_round_trip_and_tampering(spark, tmp_path):
    path = str(tmp_path / "ledger")
    run = {"stream_id": "s", "run_id": "r1", "run_index": 0, "kind": "system", "epoch": 0, "suite_hash": "h", "observations": [{"item_id": "sk-secret", "score": 0.5, "raw": 3.0}]}
    ledger.append(spark, path, [("run", ledger.run_payload(run))])
    ledger.append(spark, path, [("rebaseline", ledger.rebaseline_payload("new rubric")), ("verdict", ledger.canonical({"stream_id": "s", "at": 0, "verdict": "stable", "rule_id": "insufficient_data"}))])
    lines = ledger.read(spark, path)
    assert lines.where("payload like '%sk-secret%'").count() == 0
    assert ledger.verify(lines).where("hash_ok and link_ok and seq_ok").count() == 3
    assert ledger.observations(lines).collect()[0]["item_id"] == ledger.item_key("sk-secret")
    assert ledger.epoch(lines).first()["epoch"] == 1 and ledger.verdicts(lines).first()["verdict"] == "stable"
    assert "new rubric" in ledger.current_pins(lines).first()["payload"]
    bad = lines.withColumn("payload", F.when(F.col("seq") == 1, F.lit("{}")).otherwise(F.col("payload")))
    assert [r["seq"] for r in ledger.verify(bad).where("not hash_ok").collect()] == [1]
    assert [r["seq"] for r in ledger.verify(lines.where("seq <> 1")).where("not link_ok").collect()] == [2]
    with pytest.raises(ValueError, match="may not hold"):
        ledger.allowed({"prompt": "text"})
    with pytest.raises(ValueError, match="reason"):
        ledger.rebaseline_payload(" ")


def test_student_and_power():
    assert abs(student.quantile(0.975, 4) - 2.7764451052) < 1e-9 and abs(student.quantile(0.9875, 7) - 2.841244) < 1e-6
    assert abs(student.cdf(-student.quantile(0.9, 3), 3) - 0.1) < 1e-12
    floor = power.Floor(0.08, 0.08 / 260**0.5, 5, 260)
    assert [power.min_items(t, floor, 0.05, 50, 40) for t in (0.10, 0.05, 0.03, 0.02, 0.015, 0.01)] == [40, 40, 96, 215, 382, 858]
    assert power.min_horizon(0.05) == 29 and power.min_shift(1000, floor, 0.05, 28) == float("inf")
    with pytest.raises(ValueError, match="nothing is provable"):
        power.min_items(0.05, floor, 0.05, 20, 40)


def test_shift_column_equals_scalar(spark):
    floor = power.Floor(0.08, 0.0057, 5, 200)
    rows = spark.createDataFrame([(n, h) for n in (40, 200) for h in (20, 50, 120)], "n long, h int")
    col = power.min_shift_column(F.col("n"), F.lit(0.08), F.lit(0.0057), F.lit(200.0), F.lit(student.dead_zone_factor(5, 0.05)), F.col("h"), 0.05, 1e-9)
    for r in rows.withColumn("m", col).collect():
        want = power.min_shift(r["n"], floor, 0.05, r["h"])
        assert r["m"] is None if want == float("inf") else abs(r["m"] - want) < 1e-12


def test_pins_and_prices(spark):
    row = spark.range(1).select(F.struct(F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("r").alias("rubric_hash"), F.lit(None).cast("string").alias("params_hash"), F.lit("s").alias("scale")).alias("a"), F.struct(F.lit("p").alias("provider"), F.lit("n").alias("model"), F.lit("r").alias("rubric_hash"), F.lit("x").alias("params_hash"), F.lit("s").alias("scale")).alias("b"))
    assert row.select(scores.differing_fields(F.col("a"), F.col("b"))).first()[0] == ["model", "params_hash"]
    assert row.select(scores.longest_prefix_price(F.lit("big-2"), {"big": 1.0, "big-2": 3.0})).first()[0] == 3.0
    assert spark.range(1).select(generator.latent_level(F.lit("x"))).first()[0] > 0.25


def test_lines_are_numbered_over_split_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = {}
    for name in ("a", "b"):
        lines = []
        for i in range(500):
            kind = rng.integers(0, 9)
            score = 9.0 if kind == 3 else float("%.3f" % rng.random())
            lines.append("" if kind == 0 else "// note" if kind == 1 else "{" + "x" * 40 if kind == 2 else json.dumps({"item_id": f"i{rng.integers(0, 200)}", "score": score}))
        texts[name] = lines
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    want = []
    for name, lines in texts.items():
        seen = {}
        for n, line in enumerate(lines, 1):
            if not line or line.startswith("//"):
                continue
            try:
                r = json.loads(line)
            except json.JSONDecodeError:
                want.append((name, n, ["not JSON"], None))
                continue
            issues = (["duplicate item id"] if r["item_id"] in seen else []) + (["score out of range"] if r["score"] > 1 else [])
            want.append((name, n, issues, seen.get(r["item_id"])))
            if not issues:
                seen[r["item_id"]] = n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")  # every file in many blocks
    try:
        rows = ingest.load(spark, "jsonl", str(tmp_path / "*.jsonl"), 0.0, 1.0)
        got = [(r["source"].split("/")[-1][0], r["line"], r["issues"], r["first_line"]) for r in rows.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        with pytest.raises(ValueError, match=r"duplicate item id \d+, not JSON \d+, score out of range \d+: line \d+: .*; and \d+ more"):
            ingest.strict(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wrong_paths_have_their_own_errors(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "binary.jsonl").write_bytes(b'{"item_id": "a", "score": 1}\n\xff\xfe\x00')
    with pytest.raises(ValueError, match="file not found"):
        ingest.load(spark, "jsonl", str(tmp_path / "missing.jsonl"), 0.0, 1.0)
    with pytest.raises(ValueError, match="directory"):
        ingest.load(spark, "jsonl", str(tmp_path / "none"), 0.0, 1.0)
    rows = ingest.load(spark, "jsonl", str(tmp_path / "binary.jsonl"), 0.0, 1.0).collect()
    assert [(r["line"], r["issue"]) for r in sorted(rows, key=lambda r: r["line"])] == [(1, None), (2, "not UTF-8 text")]


def test_writers_at_once_lose_and_double_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")

    def write(name):
        for i in range(2):
            # a record that depends on what is there, as a run_index does
            ledger.append(spark, path, lambda lines: [("rebaseline", ledger.rebaseline_payload(f"{name}-{i} after {0 if lines is None else lines.count()}"))] * 2)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, "abc"))
    lines = ledger.read(spark, path)
    assert lines.count() == 12 and ledger.verify(lines).where("not (hash_ok and link_ok and seq_ok)").count() == 0
    said = {r["seq"]: json.loads(r["payload"])["reason"] for r in lines.collect()}
    assert all(said[q].endswith(f" after {q - q % 2}") for q in said)
    assert sorted({t.split(" ")[0] for t in said.values()}) == [f"{n}-{i}" for n in "abc" for i in range(2)]
    assert not [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith(".")]


def test_a_name_is_taken_once_on_other_file_systems(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.books.link./at", f"file://{tmp_path}")
    for text, new in (("first\n", True), ("second\n", False)):
        assert ledger.put_if_absent(spark, "viewfs://books/at/ledger", "0.json", text) is new
    assert (tmp_path / "ledger" / "0.json").read_text() == "first\n"


def test_kept_scores_rewrite_only_touched_buckets(spark, tmp_path):
    cache = ScoreCache(spark, str(tmp_path / "cache"), 16)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, score double, at long")
    assert cache.rows().count() == 0 and cache.lookup(rows(("a", 0.0, 0)).select("key")).first()["score"] is None
    cache.upsert(rows(*((f"k{i}", i / 100, 0) for i in range(100)), ("k5", 0.9, 3), ("k5", 0.1, 1), (None, 1.0, 9)))
    before = cache._manifest()[1]["folders"]
    cache.upsert(rows(("k7", 0.5, 1), ("k8", 0.6, -1)))
    after = cache._manifest()[1]["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    again = ScoreCache(spark, str(tmp_path / "cache"), 99)  # another run finds it as it is
    got = {r["key"]: r["score"] for r in again.rows().collect()}
    assert again.buckets == 16 and len(got) == 100 and (got["k5"], got["k7"], got["k8"], got["k9"]) == (0.9, 0.5, 0.08, 0.09)
    asked = []

    def score(missing):
        asked.extend(r["key"] for r in missing.collect())
        return missing.withColumn("score", F.lit(0.25))

    items = rows(("k5", 0.0, 0), ("new", 0.0, 0), ("new", 0.0, 0)).select("key", F.lit(1).alias("tag"))
    assert sorted((r["key"], r["score"]) for r in again.fill(items, score, 4).collect()) == [("k5", 0.9), ("new", 0.25), ("new", 0.25)]
    assert asked == ["new"]

    def write(n):
        ScoreCache(spark, str(tmp_path / "cache")).upsert(rows((f"w{n}", n / 10, 5), ("both", n / 10, n)))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    got = {r["key"]: r["score"] for r in cache.rows().collect()}
    assert [got[k] for k in ("w0", "w1", "w2", "both")] == [0.0, 0.1, 0.2, 0.2] and len(got) == 105
    assert cache.vacuum() > 0 and cache.rows().count() == 105
