import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import rarity

from .docs import awkward, empty

SENTENCES = random.Random(11)


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß0123456789,.") for _ in range(rng.randint(2, 9))) for _ in range(n))


def level(window):
    bits = sum(round(c * math.log2(c) * 2**20) for c in Counter(window).values())
    return (384 * 2**20 - bits) * 1000 // (384 * 2**20)


def brute_features(data, rank):
    """Positions and sizes of a text's features, by loops over the definition."""
    if len(data) < 64:
        return [(0, len(data))] if data else []
    levels = [level(data[i : i + 64]) for i in range(len(data) - 63)]
    votes = Counter()
    for i in range(len(levels) - 63):
        strong = [(rank[levels[j]], j) for j in range(i, i + 64) if levels[j] >= 100]
        if strong:
            votes[min(strong)[1]] += 1
    chosen = sorted(j for j, n in votes.items() if n >= 16) or [min((rank[v], j) for j, v in enumerate(levels))[1]]
    seen, out = set(), []
    for j in chosen:
        if data[j : j + 64] not in seen:
            seen.add(data[j : j + 64])
            out.append((j, 64))
    return out


def brute_ranks(texts):
    counts = Counter(level(t[i : i + 64]) for t in texts for i in range(len(t) - 63))
    return {v: r for r, v in enumerate(sorted(range(1001), key=lambda v: (counts[v], v)))}


TEXTS = [prose(40, 1), prose(9, 2), "a" * 200, "short", "ab" * 40, prose(300, 3), "", "x" * 63, "y" * 64, prose(60, 4) * 3]


def test_features_equal_brute_force(monkeypatch):
    monkeypatch.setattr(rarity, "UNIT", 257)
    data = [t.encode() for t in TEXTS]
    want = brute_ranks(data)
    array = pa.array(TEXTS)
    rank = rarity.rank_of(rarity.level_counts(array))
    assert {v: int(r) for v, r in enumerate(rank)} == want
    row, value = rarity.features(*rarity.buffers(array), rank)
    for i, t in enumerate(data):
        expected = brute_features(t, want)
        joined = np.frombuffer(t, np.uint8)
        hashes = rarity.window_hash(joined, np.array([a for a, _ in expected], np.int64), np.array([n for _, n in expected], np.int64)) if expected else []
        assert value[row == i].tolist() == list(hashes), i


def brute_likeness(a, na, b, nb):
    """a, b: filters as lists of sets of bits; na, nb: numbers of features."""
    if (a, na) == (b, nb):
        return 1.0
    if not a or not b:
        return 0.0

    def way(x, nx, y):
        total = 0
        for k, f in enumerate(x):
            scores = []
            for g in y:
                chance = len(f) * len(g) / 2048
                floor, most = chance + 3 * math.sqrt(chance), min(len(f), len(g))
                scores.append(min(max((len(f & g) - floor) / (most - floor), 0), 1) if most > floor else 0)
            total += max(scores) * min(128, nx - 128 * k)
        return total / nx

    ways = ([way(a, na, b)] if na <= nb else []) + ([way(b, nb, a)] if nb <= na else [])
    return sum(ways) / len(ways)


def decoded(text):
    import base64

    n, _, data = text.partition(":")
    bits = np.unpackbits(np.frombuffer(base64.b64decode(data), np.uint8)).reshape(-1, 2048)
    return [set(np.flatnonzero(f).tolist()) for f in bits], int(n)


def check(rows, docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest(), following))
    assert sorted(map(str, ((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows))) == sorted(map(str, (w[:3] for w in want)))
    prints = {hashlib.sha256(t.encode()).hexdigest(): None for _, t in docs}
    by_id = {}
    for r in rows:
        by_id.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"]), []).append(r)
    for (doc_id, n, sha, following), (_, text) in zip(want, order):
        r = by_id[doc_id, n, sha].pop()
        key = hashlib.sha256(text.encode()).hexdigest()
        assert prints[key] in (None, r["fingerprint"])  # equal texts, equal fingerprints
        prints[key] = r["fingerprint"]
    for r in rows:
        a, b = decoded(r["fingerprint"]), decoded(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(brute_likeness(*a, *b), abs=1e-12)
        assert 0 <= r["near_next"] <= 1
    following = {w[0]: hashlib.sha256(w[3].encode()).hexdigest() for w in want}
    for r in rows:
        if sum(w[0] == r["doc_id"] for w in want) == 1:
            assert r["near_next"] == pytest.approx(brute_likeness(*decoded(r["fingerprint"]), *decoded(prints[following[r["doc_id"]]])), abs=1e-12)


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    docs = awkward(spark, [*TEXTS, prose(2500, 5), *(prose(30 + i, 100 + i) for i in range(40)), prose(40, 1)])
    pairs = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    check(rarity.fingerprints(docs).collect(), pairs)
    monkeypatch.setattr(rarity, "RANGE_BYTES", 2000)  # many ranges
    monkeypatch.setattr(rarity, "UNIT", 500)
    check(rarity.fingerprints(docs.repartition(3)).collect(), pairs)


def test_small_tables(spark):
    assert rarity.fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(3, "äbcdef" * 50)], "doc_id long, text string")
    check(rarity.fingerprints(one).collect(), [(3, "äbcdef" * 50)])
    nulls = spark.createDataFrame([(None, None), (None, "b" * 90), (None, "a" * 90)], "doc_id long, text string")
    check(rarity.fingerprints(nulls).collect(), [(None, ""), (None, "b" * 90), (None, "a" * 90)])


def test_half_edits_are_nearer_than_strangers(spark):
    docs = spark.createDataFrame([(i, prose(400, 1000 + i)) for i in range(60)], "doc_id long, text string")
    rows = rarity.fingerprints(docs).collect()
    assert min(r["near_edited"] for r in rows) > 0.2 and max(r["near_next"] for r in rows) < 0.1
