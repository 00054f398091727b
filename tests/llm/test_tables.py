import base64
import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, mixing, ring, topk, warc

from .docs import awkward, empty


def test_ring_fills_all_shards_alike(spark):
    docs = awkward(spark, [f"text {i}" for i in range(300)])
    rows = ring.bounded_ring(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = {(r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == texts
    assert ring.bounded_ring(empty(spark)).count() == 0


def test_ring_portions_follow_the_ring_while_there_is_room():
    points = ring.ring_points(4, 8, 64)
    counts = {c: 3 for c in range(64)}
    placed = ring.portions(counts, 4, 8, 64)
    room = [48] * 4
    for cell in range(64):
        left = 3
        p = next((i for i, (c, _) in enumerate(points) if c >= cell), 0)
        want = []
        while left:
            s = points[p % len(points)][1]
            n = min(left, room[s])
            if n:
                want.append((s, n))
                room[s] -= n
                left -= n
            p += 1
        assert [(s, hi - lo + 1) for c, lo, hi, s, _ in placed if c == cell] == want


def test_ring_moves_little_when_a_shard_comes(spark):
    keys = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = ({r["doc_id"]: r["shard"] for r in ring.bounded_ring(keys, n).collect()} for n in (23, 24))
    assert sum(a[k] != b[k] for k in a) < 2000 * 0.5


PAGES = "page_id long, url string, html string, header string, payload string"


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 2)  # groups of more are dealt to chunks
    rows = [(3, "http://a/b", "<p>ü</p>", "h", "p"), (1, "u", "<p>ü</p>", None, None), (2, None, None, "x", "y"), (5, "bad\r\nurl", "", "x", "y"), (None, "n", "only", "x", "y"), (7, "z", "long" * 5000, "x", "y"), (8, "z", "once", None, None), (8, "z", "once", None, None)]
    rows += [(-1, "m", "minus", "x", "y"), (4, "m", "minus", "x", "y"), (None, "m", "minus", "x", "y"), *((i, "c", "common", None, None) for i in range(20, 31))]
    pages = spark.createDataFrame(rows, PAGES)
    root = common.new_path(spark, "warc")
    warc.write_archive(pages, root)
    first = {}
    for p, _, html, *_ in rows:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    want = []
    for p, _, html, *_ in rows:
        data = (html or "").encode()
        at = first.get(html or "")
        revisit = at is not None and at != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", at if revisit else None))
    for _ in range(2):
        got = warc.read_index(spark, root).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
        for name in warc.TABLES:  # the second time as another session finds it
            spark.sql(f"DROP TABLE {warc._table(root, name)}")
    assert spark.read.parquet(f"{root}/payloads").count() == len({html or "" for _, _, html, *_ in rows})
    records = warc.read_records(spark, root).collect()
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(rest) - 4
        assert rest[:-4] == (bytes(r["payload"]) if fields["WARC-Type"] == "response" else b"")
    none = common.new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], PAGES), none)
    assert warc.read_index(spark, none).count() == 0


def test_rebuilding_moves_no_payload(spark):
    root = common.new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(i, "u", f"page {i % 9}", None, None) for i in range(40)], PAGES), root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = warc._read(spark, root, "headers").join(warc._read(spark, root, "payloads"), "sha256")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_damaged_payload_is_noticed(spark):
    root = common.new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "u", "abc", None, None)], PAGES), f"{root}/a")
    bad = warc._read(spark, f"{root}/a", "payloads").withColumn("payload", F.encode(F.lit("abd"), "UTF-8"))
    warc._write(bad, f"{root}/b", "payloads", 4)
    warc._write(warc._read(spark, f"{root}/a", "headers"), f"{root}/b", "headers", 4)
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, f"{root}/b").collect()


VECTORS = "vec_id long, embedding array<float>, label int, ids string, q string"


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0, "a", "b") for i, v in enumerate(x)]
    rows += [(1000, None, 0, "a", None), (1050, [1.0, None] * 4, 0, "a", "b"), (1100, [float("nan")] * 8, 0, "a", "b"), (None, [1.0] * 8, 0, "a", "b"), (1150, [], None, None, None), (1200, [2.0], 1, "a", "b"), (1200, [2.0], 1, "a", "b")]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS)).collect()
    fine = [(i, np.pad(np.floor(256 * np.array(v, np.float64)), (0, 8 - len(v)))) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = set()
    for q, a in {i: v for i, v in fine if i % 50 == 0}.items():
        best = sorted(((-int(a @ b), i) for i, b in fine if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want
    huge = [(i, [1e9 * (i % 7 - 3), 3e38 if i % 5 == 0 else -2.5, float(i)], 0, "a", "b") for i in range(120)] + [(500, [1e9, 0.0, 0.0], 0, "a", "b")]
    near = [(50, [2.0**24], 0, "a", "b"), *((i, [(2.0**22 - 1 + i / 4) if i % 2 else 2.0**22 - i], 0, "a", "b") for i in range(1, 30))]  # floor(256 x) near 2^30, the query's 2^32
    edge = [(100, [2.0**23, 2.0**23], 0, "a", "b"), *((i, [2.0**23, 2.0**23 - i], 0, "a", "b") for i in range(1, 9)), (9, [-(2.0**23), -(2.0**23)], 0, "a", "b"), (11, [2.0**24, 2.0**23], 0, "a", "b"), (12, [2.0**24, 2.0**23 + 1], 0, "a", "b")]  # sums to 2^63 and over
    twice = [(50, [2.0, 1.0], 0, "a", "b"), (50, [1.0, 9.0], 0, "a", "b"), *((i, [float(i % 3), float(i)], 0, "a", "b") for i in range(1, 9))]
    for table in (huge, near, edge, twice):
        whole = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, *_ in table]
        queries = {}
        for i, v in whole:
            if i % 50 == 0:
                queries[i] = min(v, queries.get(i, v))
        want = set()
        for q, a in queries.items():
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:5]
            want |= {(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)}
        assert {tuple(r) for r in topk.top_k(spark.createDataFrame(table, VECTORS)).collect()} == want
    few = topk.top_k(spark.createDataFrame(rows[:3], VECTORS)).collect()
    assert len(few) == 2 and topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_top_k_cells_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (900, 8))
    table = spark.createDataFrame([(i, (v / 256).tolist(), 0, "a", "b") for i, v in enumerate(x)], VECTORS)
    want = {tuple(r) for r in topk.top_k(table, query_every=3).collect()}
    monkeypatch.setattr(topk, "GROUP_BYTES", 2048)  # 128 vectors or queries of 16 bytes, so 8 by 3 cells
    monkeypatch.setattr(topk, "BLOCK", 32)
    assert {tuple(r) for r in topk.top_k(table, query_every=3).collect()} == want and len(want) == 1500
    vectors = pa.table({"ids": [np.arange(900).tobytes()], "vecs": [x.astype(np.int16).tobytes()]})
    queries = pa.table({"q_ids": [np.arange(900, 950).tobytes()], "q_vecs": [x[:50].astype(np.int16).tobytes()], "state": [json.dumps([[[]] * 50, [5] * 50])]})
    bound = 8 * 100**2
    bins = topk._histograms("i2", 8, bound, 2, topk.DIGIT)(vectors, queries).to_pandas()
    score = x[:50] @ x.T
    for i in range(50):  # as many rows as scores wanted, with whole counts from the kth score's bin on
        own = bins[bins["query_id"] == 900 + i].set_index("bin")["n"].to_dict()
        n = np.bincount((score[i] + bound) >> topk.DIGIT, minlength=topk.BINS)
        least = int(np.sort((score[i] + bound) >> topk.DIGIT)[-5])
        assert len(own) <= 5 and all(own.get(b, 0) == n[b] for b in range(least, topk.BINS))


def test_mix_meets_limits_and_keeps_rows(spark):
    texts = [f"{'word ' * (i % 7 + 1)}{i}" for i in range(600)]
    docs = awkward(spark, []).unionByName(spark.createDataFrame([(i, t, "en", "big" if i % 6 else "small", 1, 1, "r", "k") for i, t in enumerate(texts)], awkward(spark).schema))
    out = mixing.mix_rows(docs, max_repeats=3.0, block_rows=16)
    assert out.columns == docs.columns
    counts = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
    have = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    assert set(counts) == set(have)
    tokens = lambda c, s: sum(n * len((k[1] or "").split()) for k, n in c.items() if k[2] == s)
    for s in ("big", "small", "src0", "src1"):
        assert 1.0 <= tokens(counts, s) / tokens(have, s) <= 3.0 + 1e-6
    assert mixing.mix_rows(empty(spark)).count() == 0


def test_mix_budget_and_entropy(spark):
    rows = [(i, " ".join(["w"] * 10), "a" if i < 900 else "b", f"s{0 if i < 900 else 1}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.temperature_mix(docs, max_repeats=None, entropy_share=0.8, budget_share=0.5, block_rows=50)
    got = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(got.values())
    entropy = -sum(n / total * math.log(n / total) for n in got.values())
    assert 4950 <= total <= 5000 and abs(entropy - 0.8 * math.log(2)) < 0.01
    again = mixing.temperature_mix(docs, max_repeats=None, entropy_share=0.8, budget_share=0.5, block_rows=50)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def spark_hash(*values):
    """Spark's xxhash64: ("i", n) is an int, an int is a long, a text its bytes; null passes the seed on."""
    h = 42
    for v in values:
        if v is not None:
            data = v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_mix(rows, a, full, block_rows, seed):
    """doc_id, source, epoch, block, mix_point of every taken row, by loops over the definition."""
    keyed = {}
    for i, text, source in rows:
        key = (spark_hash(i, text), i, source)
        tokens, times = keyed.get(key, (0, 0))
        keyed[key] = tokens + len(re.findall(r"[^ \t\n\x0b\f\r]+", text or "")), times + 1
    sources = {}
    for (_, _, s), (n, _) in keyed.items():
        have = sources.setdefault(s, [0, 0])
        have[0] += n
        have[1] += 1
    total = sum(n for n, _ in sources.values())
    z = sum((n / total) ** a for n, _ in sources.values() if n)
    out = []
    for s, (tokens, keys) in sources.items():
        target = round((tokens / total) ** a / z * (full * total)) if tokens else 0
        epochs = target // tokens if tokens else 1
        rest = target - epochs * tokens if tokens else 0
        n_blocks = max(1, -(-keys // block_rows))
        blocks = {}
        for (h, i, of), (n, _) in keyed.items():
            if of == s:
                blocks.setdefault(spark_hash(h, ("i", seed)) % n_blocks, []).append((h, i, n))
        for e in range(epochs + 1):
            before = 0
            for b in sorted(blocks, key=lambda b: (spark_hash(b, ("i", e), ("i", seed)), b)):
                through = before
                for h, i, n in sorted(blocks[b], key=lambda r: (spark_hash(r[0], ("i", e), ("i", seed)), r[0])):
                    through += n
                    if e < epochs or (before < rest and through <= rest):
                        out.append((i, s, e, b, round((e * tokens + before) / target, 9) if target else 0.0))
                before += sum(n for _, _, n in blocks[b])
    return out


def test_mix_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)) + f" {i % 50}", rng.choice("aaaaaaaabbbc") if i % 90 else None) for i in range(500)]
    rows += rows[:20] + [(None, "x y", "b"), (7, None, "empty"), (8, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {}
    for _, t, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    shares = [n / sum(words.values()) for n in words.values() if n]
    lo, hi = 0.0, 1.0
    for _ in range(60):  # the flattest exponent that repeats no source over 2.5 times as often as another
        a = (lo + hi) / 2
        repeats = [q ** (a - 1) for q in shares]
        lo, hi = (lo, a) if max(repeats) / min(repeats) <= 2.5 else (a, hi)
    sources = spark.createDataFrame([(n, n / sum(words.values()) if n else None) for n in words.values()], "tokens long, share double")
    found, full = mixing.fit_exponent(sources, 2.5)
    assert abs(found - hi) < 1e-7
    got = mixing.temperature_mix(docs, max_repeats=2.5, block_rows=16).collect()
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, str(r["source"]), r["epoch"], r["block"], r["mix_point"]) for r in got)
    want = sorted((i is None, i or 0, str(s), e, b, p) for i, s, e, b, p in brute_mix(rows, found, full, 16, 17))
    assert [x[:5] for x in have] == [x[:5] for x in want] and all(abs(x[5] - y[5]) < 1e-8 for x, y in zip(have, want))

