import random

import corpus_pipeline
from plumbline.llm import pieces

from .docs import awkward, empty
from .test_near import brute, family
from .test_text_models import brute_stats


def test_each_stage_acts_on_what_the_one_before_kept(spark, tmp_path):
    rng = random.Random(8)
    texts = [t for _ in range(5) for t in family(rng, 6, 4)] + [f"{family(rng, 1, 0)[0]} write to a{i}@b.cd now" for i in range(12)] + ["too short", "same words again here " * 20]
    docs = awkward(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    good = {(i, t) for i, t in rows if brute_stats(t)[0] >= 10 and (brute_stats(t)[4] or 0) * 5 <= brute_stats(t)[0]}
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        seen.append([(r["doc_id"], r["text"]) for r in step.collect()])
    assert set(seen[0]) == good
    parts = brute({(i, t) for i, t in good if i is not None})
    assert {i for i, _ in seen[1]} == {i for i, (_, c) in parts.items() if i == c}
    assert len(seen[2]) == len(seen[1]) and any("<EMAIL>" in t for _, t in seen[2]) and not any("@" in t for _, t in seen[2])
    assert set(seen[3]) == set(seen[2]) and len(seen[3]) >= len(seen[2])
    out = corpus_pipeline.run(spark, str(tmp_path))
    back = sorted((r["doc_id"], r["text"]) for r in pieces.decode(out).collect())
    assert back == sorted(seen[3])


def test_an_empty_table_and_any_column_names(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rng = random.Random(3)
    docs = awkward(spark, [family(rng, 1, 0)[0] for _ in range(12)])
    names = ["a.b", "c`d", "e f", "key", "row", "gone", "rejected", "k0", "spans", "node", "fold", "times", "__key", "__gone", "of", "d", "low"]
    docs = docs.drop("key", "row").selectExpr("*", *("doc_id AS `" + n.replace("`", "``") + "`" for n in names))
    step = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, "")
        assert step.columns == docs.columns
    rows = step.collect()
    assert {r["doc_id"] for r in rows} >= set(range(12)) and all(r[n] == r["doc_id"] for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, step, "").count() == len(rows)

