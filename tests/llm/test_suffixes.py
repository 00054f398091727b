import hashlib
import os
import random

import numpy as np

from plumbline.llm import suffixes

from .docs import awkward, empty


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(i, first.get(s, i))
    out = set()
    for i, b in data:
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = [True] * 50
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.add((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_removed_bytes_equal_brute_force(spark):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (49, 50, 51, 60, 90, 400)]
    texts = ["a" * 300, "a" * 120, "ab" * 100, "x" * 49, "x" * 50, "x" * 50]
    for _ in range(60):
        parts = ["".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(0, 80))) for _ in range(4)]
        for k in (1, 3):
            p = rng.choice(passages)
            cut = rng.randint(0, 20) * rng.randint(0, 1)
            parts.insert(k, p[cut:])
        texts.append("".join(parts))
    texts += texts[6:9]
    docs = awkward(spark, texts)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for crowd, spot in ((suffixes.CROWD, suffixes.SPOT), (6, 1), (1, 1)):  # 1: every lead is cut down to single strings
        got = suffixes.remove_repeats(docs, crowd, spot).collect()
        assert len(got) == docs.count()
        assert {tuple(r) for r in got} == want
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_a_line_in_many_contexts(spark):
    """Halves of one lead collapse where they lie in the line, and part where they reach beyond it."""
    rng = random.Random(3)
    line = "All rights reserved by the owners of this very common line of text."
    texts = [f"{rng.getrandbits(60):x} {rng.choice(['x', 'yy'])}{line}{rng.choice(['', ' 1', ' 22'])} {rng.getrandbits(60):x}" for _ in range(80)]
    docs = awkward(spark, texts)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {tuple(r) for r in suffixes.remove_repeats(docs, 10, 1).collect()} == want


def test_strings_sort_by_successive_tokens():
    """Groups are numbered in the order of the bytes, whichever token the strings part at: the first, the 41st byte, the last."""
    rng = random.Random(4)
    stem = bytes(rng.randrange(256) for _ in range(50))
    parted = [stem[:k] + bytes([b]) + stem[k + 1 :] for k in (0, 7, 8, 15, 16, 39, 40, 41, 42, 47, 48, 49) for b in (0, 127, 128, 255)]
    strings = [rng.choice([stem, *parted, bytes(50), b"\xff" * 50]) for _ in range(3000)]
    data = np.frombuffer(b"".join(strings), np.uint8)
    assert suffixes.string_groups(data, np.arange(len(strings)) * 50).tolist() == [sorted(set(strings)).index(s) for s in strings]
    run = np.frombuffer(b"ab" * 200 + b"abc" * 100, np.uint8)
    every = [run[i : i + 50].tobytes() for i in range(len(run) - 49)]
    assert suffixes.string_groups(run, np.arange(len(every))).tolist() == [sorted(set(every)).index(s) for s in every]
    assert suffixes.string_groups(data, np.array([100])).tolist() == [0]


def colliding(seed=42):
    """Two binaries of 64 bytes with equal xxhash64 under the seed: the second stripe makes up for the first in one lane."""
    p1, p2, m = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 1 << 64

    def lane(x):
        a = (seed + p1 + p2 + x * p2) % m
        return ((a << 31 | a >> 33) * p1) % m

    def whole(x, y):
        return x.to_bytes(8, "little") + bytes(24) + y.to_bytes(8, "little") + bytes(24)

    return whole(1, 0), whole(2, (lane(1) - lane(2)) * pow(p2, -1, m) % m)


def test_second_digest_does_not_follow_from_the_first(spark):
    rows = suffixes.digests(spark.createDataFrame([(c,) for c in colliding()], "content binary")).collect()
    assert rows[0]["content"] != rows[1]["content"] and rows[0]["one"] == rows[1]["one"]
    assert rows[0]["two"] != rows[1]["two"]


def test_disk_is_one_steps(spark, monkeypatch):
    """The result rests on narrow tables only: what the search made is deleted with its shuffles, and the setting is as before."""
    name, kept, made = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], []
    real = suffixes.materialize

    def watched(df, label, keep=False):
        made.append((label, spark.conf.get(name)))
        out = real(df, label, keep)
        kept.append((label, out.columns, out.inputFiles()[0].rsplit("/", 1)[0]))
        return out

    monkeypatch.setattr(suffixes, "materialize", watched)
    before = spark.conf.get(name)
    line = "a line of more than fifty bytes that stands in several of these texts"
    docs = spark.createDataFrame([(i, f"{i} {line} {i * 7919}") for i in range(40)], "doc_id long, text string")
    rows = suffixes.remove_repeats(docs, 6, 1)
    assert {on for _, on in made} == {"true"} and spark.conf.get(name) == before
    left = {label: columns for label, columns, path in kept if os.path.exists(path.removeprefix("file:"))}
    assert set(left) == {"copies", "cut"} and not {"text", "content"} & {c for columns in left.values() for c in columns}
    assert all("lead" not in columns and "one" not in columns for label, columns, _ in kept if label in ("segments", "stretches", "halves"))
    assert {r["doc_id"]: r["n_removed"] > 60 for r in rows.collect()} == {i: i > 0 for i in range(40)}
