import random
import re

from plumbline.llm import near

from .docs import awkward, empty


def brute(rows):
    def shingle_set(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, drift):
    """A chain of texts, each a little different from one before it."""
    vocabulary = [f"w{i}" for i in range(500)]
    out = [[rng.choice(vocabulary) for _ in range(120)]]
    for _ in range(size - 1):
        t = list(rng.choice(out))
        for _ in range(rng.randint(0, drift)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(t)
    return [" ".join(t) for t in out]


def test_components_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [t for _ in range(6) for t in family(rng, 25, 5)]
    texts += ["short one", "Short ONE", "short  one", "a b c d e", "A B C D E", "x"]
    rng.shuffle(texts)
    docs = awkward(spark, texts)
    want = brute({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    got = near.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert len({c for _, c in want.values()}) < len(want) - 50
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    left = near.deduplicate(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert near.near_duplicates(empty(spark)).count() == 0


def test_large_buckets_are_dealt_to_tiles_and_chunks(spark, monkeypatch):
    """Many texts of one template, mostly below the threshold: buckets of several components."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    frame = [rng.choice(vocabulary) for _ in range(130)]
    texts = []
    for _ in range(60):
        own = list(frame)
        at = rng.randrange(90)
        own[at : at + 30] = [rng.choice(vocabulary) for _ in range(30)]
        texts.append(" ".join(own))
        if rng.random() < 0.4:
            own[rng.randrange(130)] = "other"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    docs = awkward(spark, texts).selectExpr("*", "1 AS gone", "2 AS node", "3 AS __gone", "4 AS low")
    want = brute({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    for size in (3, 1000):
        monkeypatch.setattr(near, "CHUNK", size)
        monkeypatch.setattr(near, "TILE", size)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(docs).collect() if r["doc_id"] is not None}
        assert got == want
    left = near.deduplicate(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} - {None} == {i for i, (_, c) in want.items() if i == c}


def test_unlike_rows_of_one_document(spark):
    text = [" ".join(f"w{i * k}" for i in range(40)) for k in (1, 2, 3)]
    rows = [(1, text[0]), (5, text[0] + " a b"), (5, text[1]), (7, text[1]), (9, text[2])]
    got = sorted(map(tuple, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == [(1, 36, 1), (5, 36, 5), (5, 38, 5), (7, 36, 5), (9, 36, 9)]  # 5 is linked by its smaller set
