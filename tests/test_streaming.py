import json

import pytest

from plumbline.operators import kernel
from plumbline.streaming import live

SCHEMA = "stream_id string, leg string, epoch int, t long, z double, null_lo double, null_hi double"


@pytest.mark.parametrize("sizes", [[30], [7, 1, 22]])
def test_micro_batches_give_the_batch_result(spark, tmp_path, sizes):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(s, "system", 0, t, float(np.clip(rng.normal(0.5 + 0.2 * (t > 12), 0.1), 0, 1)), 0.45, 0.55) for t in range(30) for s in ("a", "b")]
    whole = spark.createDataFrame(rows, SCHEMA)
    want = {(r["stream_id"], r["t"]): r["log_e"] for r in kernel.detector_trace(whole, 0.025, 8).collect()}
    landing, name = tmp_path / "in", f"live_{len(sizes)}"
    landing.mkdir()
    stream = live.detect(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(landing)), 0.025, 8)
    with live.rocksdb(spark):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    lo = 0
    for n in sizes:
        part = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in rows if lo <= r[3] < lo + n]
        (landing / f"{lo:03d}.json").write_text("\n".join(map(json.dumps, part)))
        q.processAllAvailable()
        lo += n
    (landing / "late.json").write_text(json.dumps(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], rows[0]))))
    q.processAllAvailable()
    q.stop()
    got = spark.table(name).collect()
    assert [r["t"] for r in got if r["late"]] == [0]
    seen = {(r["stream_id"], r["t"]): r["log_e"] for r in got if not r["late"]}
    assert seen.keys() == want.keys() and all(abs(seen[k] - want[k]) < 1e-9 for k in want)


def test_a_restarted_query_goes_on_and_late_rows_go_aside(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(s, leg, e, t, float(np.clip(rng.normal(0.5 + 0.3 * (t > 9), 0.1), 0, 1)), 0.45, 0.55) for e in (0, 1) for t in range(24) for s in ("a", "b") for leg in ("system", "anchor")]
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 5, 6, 17, 24]
    late = [("a", "system", 0, 20, 0.5, 0.45, 0.55), ("b", "anchor", 1, 3, 0.5, 0.45, 0.55)]
    for e in (0, 1):
        for lo, hi in zip(cuts, cuts[1:]):
            part = [r for r in rows if r[2] == e and lo <= r[3] < hi]
            spark.createDataFrame(part, live.IN).coalesce(1).write.mode("append").parquet(landing)
            live.detect_folder(spark, landing, out, 0.025, 8, files_per_batch=2)  # a new query each time
    spark.createDataFrame(late, live.IN).coalesce(1).write.mode("append").parquet(landing)
    live.detect_folder(spark, landing, out, 0.025, 8)
    live.detect_folder(spark, landing, out, 0.025, 8)  # nothing new
    got = spark.read.parquet(f"{out}/trace").collect()
    want = []
    for e in (0, 1):  # a higher epoch begins anew
        want += kernel.detector_trace(spark.createDataFrame([r for r in rows if r[2] == e], live.IN), 0.025, 8).collect()
    flat = lambda rs: sorted((r["stream_id"], r["leg"], r["t"], round(r["log_e"], 9), round(r["peak_log_e"], 9), r["alarm"], r["best_start"], r["direction"]) for r in rs)
    assert flat(got) == flat(want)
    assert {(r["stream_id"], r["leg"], r["t"]) for r in spark.read.parquet(f"{out}/late").collect()} == {("a", "system", 20), ("b", "anchor", 3)}


def test_runs_with_issues_are_refused_whole(spark):
    rows = [("s", "system", 0, "a", 1.0), ("s", "system", 0, "b", 9.0), ("s", "system", 1, "a", 2.0), ("s", "system", 1, "b", 3.0)]
    kept, gone = [], []
    each = live.ingest_files(None, 1.0, 5.0, lambda d: kept.extend(d.collect()), lambda d: gone.extend(d.collect()))
    each(spark.createDataFrame(rows, "stream_id string, kind string, run_index long, item_id string, score double"), 0)
    assert {(r["run_index"], r["item_id"], r["score"]) for r in kept} == {(1, "a", 0.25), (1, "b", 0.5)}
    assert {(r["item_id"], r["issue"]) for r in gone} == {("a", None), ("b", "score out of range")}
