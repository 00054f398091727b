import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import importance

from .docs import awkward, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for i in range(len(words)) for k in (1, 2, 3) if i + k <= len(words)]


def brute(docs, target):
    """The definition with dictionaries: rows as (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, fs = features(text)
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    ranks = collections.defaultdict(list)
    for i, r in enumerate(able[: 5 * len(able) // 100], 1):
        ranks[r[:4]].append(i)
    return sorted(str((*r[:4], ranks[r[:4]].pop(0) if ranks[r[:4]] else None)) for r in rows)


def got(frame):
    assert frame.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in frame.dtypes)
    return sorted(str(tuple(r)) for r in frame.collect())


def test_resampling_equals_brute_force(spark):
    many = [" ".join(f"w{(i * k) % 97}" for k in range(1, 12 + i % 25)) for i in range(120)]
    texts = ["ÀB cd éF 12-ab_x", "nul\x00byte Ａfull", "One. one ONE", *many, *many[:7]]
    docs = awkward(spark, texts)
    target = spark.createDataFrame([(1, "w1 w2 w3 one one"), (2, None), (3, ""), (4, "ceta dun w5 w6")], "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert got(importance.resample(docs, target)) == want
    assert sum("None)" not in r for r in want) >= 3


def test_draw_ranks_ties_and_repeats(spark):
    rows = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") % 7).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_features"), F.lit(5).cast("long").alias("weight"), F.lit(9).cast("long").alias("score"))
    drawn = [r for r in importance.draw(rows).collect() if r["rank"]]
    assert sorted(r["rank"] for r in drawn) == list(range(1, 201)) and {r["doc_id"] for r in drawn} == {0}


def test_long_texts_in_segments(monkeypatch):
    text = " - ".join(f"wörd{i % 31}x{i % 7}" for i in range(1000))
    con = importance.connection()
    whole = importance.found_in(con, pa.array([text]))
    monkeypatch.setattr(importance, "LONG", 100)
    for size in (1, 2, 3, 64, 999, 1000):
        monkeypatch.setattr(importance, "SEGMENT", size)
        assert np.array_equal(importance.found_in(con, pa.array([text])), whole), size
    assert len(importance.found_in(con, pa.array(["-" * 200]))) == 0
    assert len(whole) == len(features(text)[1])


def test_resampling_of_empty_tables(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(empty(spark), target).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert got(importance.resample(docs, target.limit(0))) == brute([(1, "a b"), (2, None)], [])
