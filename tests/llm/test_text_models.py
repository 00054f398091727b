import gc
import hashlib
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import kneser, pieces

from .docs import awkward, empty


def brute_stats(text):
    text = text or ""
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(windows) < 800 else None
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, covered if covered is None else len(covered)


TEXTS = ["a b c d e a b c d e x y", "line\nline\n line\nother\n\n\nline", "# * $ % & | < > x", "ünï cödé " * 9, "x", "one two three four five six seven eight nine ten eleven"]


def test_stats_equal_brute_force(spark):
    docs = awkward(spark, TEXTS)
    want = {(r["doc_id"], brute_stats(r["text"])) for r in docs.collect()}
    got = kneser.quality(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"])
        match = [w for i, w in want if i == r["doc_id"] and w[:4] == found]
        assert match, r
        if match[0][4] is not None:
            assert r["n_repeat_words"] == match[0][4], r
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert kneser.quality(empty(spark)).count() == 0


def fold_of(lang, text):
    return int(hashlib.sha256(f"{lang}\x00{text}".encode()).hexdigest()[0], 16) & 1


def brute_discounts(counts):
    c = [sum(n == i for n in counts) for i in range(1, 5)]
    if min(c) == 0:
        return [0, 0.5, 1.0, 1.5]
    y = c[0] / (c[0] + 2 * c[1])
    raw = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return [0, *(min(max(v, 0.05), i + 0.95) for i, v in enumerate(raw))]


def brute_model(texts, letters):
    """Modified Kneser-Ney with dictionaries: probability of a character after four others."""
    levels = {5: {}}
    for t in texts:
        padded = "\x02" * 4 + t
        for i in range(len(t)):
            g = padded[i : i + 5]
            levels[5][g] = levels[5].get(g, 0) + 1
    for k in (4, 3, 2, 1):
        levels[k] = {}
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    discounts = {k: brute_discounts(list(v.values())) for k, v in levels.items()}

    def p(g):
        if not g:
            return 1 / letters
        level, d = levels[len(g)], discounts[len(g)]
        same = [n for h, n in level.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        n = level.get(g, 0)
        return (n - d[min(n, 3)]) / sum(same) + sum(d[min(x, 3)] for x in same) / sum(same) * p(g[1:])

    return p


def score_with(p, text):
    padded = "\x02" * 4 + text
    return -sum(math.log(p(padded[i : i + 5])) for i in range(len(text))) / len(text)


def test_each_fold_is_scored_by_the_other_folds_model(spark, monkeypatch):
    rng = random.Random(3)
    texts = {"en": ["".join(rng.choice("abcd ef.\U0001f600字") for _ in range(rng.randint(1, 60))) for _ in range(25)]}
    texts["zh"] = ["".join(rng.choice("日本語の文字列") for _ in range(rng.randint(5, 30))) for _ in range(12)]
    rows = [(i, t, lang) for lang in texts for i, t in enumerate(texts[lang], 100 * len(lang) + 1000 * (lang == "zh"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(kneser, "RANGE", 300)  # several ranges
    whole = {r["doc_id"]: r["score"] for r in kneser.quality(docs).collect()}
    sliced = {r["doc_id"]: r["score"] for r in kneser.quality(docs, slice_bytes=300 * 16).collect()}  # several slices
    for lang in texts:
        letters = len(set("".join(texts[lang])))
        models = [brute_model([t for t in texts[lang] if fold_of(lang, t) != f], letters) for f in (0, 1)]
        assert math.isclose(sum(models[0]("abcd"[:4] + c) for c in set("".join(texts["en"]))), 1, rel_tol=1e-9) or lang != "en"
        for i, t, of in rows:
            if of == lang:
                want = score_with(models[fold_of(lang, t)], t)
                assert abs(whole[i] - want) < 1e-4 and abs(sliced[i] - want) < 1e-4


def test_counts_do_not_depend_on_stretches_or_tasks(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcde fg") for _ in range(n)) for n in (3, 500, 41, 2000, 1)]
    counter, small = kneser.Counter("en"), kneser.Counter("en")
    counter.add(texts, 0)
    monkeypatch.setattr(kneser, "STRETCH", 37)
    small.add(texts, 0)
    want = {}
    for t in texts:
        padded = "\x02" * 4 + t
        for i in range(len(t)):
            want[padded[i : i + 5]] = want.get(padded[i : i + 5], 0) + 1
    for c in (counter, small):
        assert {r["gram"]: r["n0"] for r in c.rows().to_pylist()} == want and not c.counts[:, 1].any()


WORDS = ["the", "river", "of", "stone", "and", "water", "ran", "under", "a", "bridge", "near", "town", "while", "children", "played"]


def test_production_band_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(250)]
    prose = [t for t in prose if brute_stats(t)[4] <= 0.2 * 80]
    prose += [" ".join(rng.sample(WORDS, 10)) for _ in range(10)]
    noise = ["".join(rng.choice("qxzjkvwpQXZ#@!0189") + rng.choice(["", " "]) for _ in range(300)) for _ in range(3)]
    texts = [*prose, *noise, *(a[: len(a) // 2] + b[: len(b) // 2] for a, b in zip(prose, noise))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9000 + i, prose[0], "aa") for i in range(8)] + [(9100, prose[1], "aa")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in kneser.quality(docs).collect()}
    assert not any(rows[i]["base_failed"] for i in rows)
    assert {i for i in rows if not rows[i]["kept"]} == set(range(len(prose), len(texts)))


def test_band_works_beyond_latin(spark):
    rng = random.Random(6)
    phrases = ["河水", "流过", "石桥", "孩子们", "在", "村庄", "附近", "玩耍", "的", "和"]
    common = "".join(phrases)
    prose = [" ".join("".join(rng.choice(phrases) for _ in range(4)) for _ in range(40)) for _ in range(250)]
    junk = [" ".join("".join(rng.choice(common) for _ in range(8)) for _ in range(40)) for _ in range(3)]  # the same characters, shuffled
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate([*prose, *junk])], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in kneser.quality(docs).collect()}
    assert {i for i in rows if not rows[i]["kept"]} == set(range(len(prose), len(prose) + 3))


def test_keep_returns_whole_rows_under_any_names(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(60)]
    docs = awkward(spark, prose).selectExpr("*", "doc_id AS rejected", "1 AS rejected_", "'x' AS __key", "2 AS fold", "3 AS score", "4 AS lang0", "5 AS part")
    kept = kneser.keep(docs)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in kneser.quality(docs).collect() if r["kept"]}
    got = kept.collect()
    assert {r["doc_id"] for r in got} == want and all(r["__key"] == "x" and r["rejected"] == r["doc_id"] for r in got)
    assert kneser.keep(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def machine():
    return pieces.Machine(pieces.load_vocabulary())


def brute_ids(p, text):
    """The whole lattice of a text, solved at once; the longest piece wins ties."""
    best, back = [0], [None]
    for j in range(1, len(text) + 1):
        found = [(best[j - n] + p.score[text[j - n : j]][0], n, p.score[text[j - n : j]][1]) for n in range(1, min(j, p.longest) + 1) if text[j - n : j] in p.score]
        if found:
            top = max(found, key=lambda x: x[:2])
        else:
            cost, ids = p.spelled(text[j - 1])
            top = best[j - 1] + cost, 1, ids
        best.append(top[0])
        back.append(top[1:])
    out, j = [], len(text)
    while j:
        n, ids = back[j]
        out.append(ids)
        j -= n
    return np.frombuffer(b"".join(reversed(out)), "<i4")


def test_stream_equals_the_whole_lattice_and_round_trips(machine, monkeypatch):
    rng = random.Random(9)
    texts = ["", " ", "Hello  world", "naïve ▁ \U0001f600\n\ttab\r\n", "thnterti eandble", "x" * 200, "=" * 5000 + " a " + "-=" * 300, "   lead", "日本語" * 40]
    texts += ["".join(rng.choice("etaoin shrdlu\n.é▁,") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += ["".join(rng.choice("= -") for _ in range(400)), "abc def " * 50, "abc def " * 50]
    for remember in (pieces.REMEMBER, 40):  # with so few, everything is forgotten again and again
        monkeypatch.setattr(pieces, "REMEMBER", remember)
        machine.forget()
        ids, counts = machine.encode(texts)
        raw, offs = machine.pieces.decode(ids, counts)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for i, t in enumerate(texts):
            own = ids[cuts[i] : cuts[i + 1]]
            assert raw[offs[i] : offs[i + 1]].tobytes().decode() == t
            if t:
                assert own.tolist() == brute_ids(machine.pieces, " " + t).tolist(), t[:40]
                assert b"".join(machine.stream(" " + t)) == own.tobytes()


def test_ids_are_committed_while_the_text_still_runs(machine):
    read = 0

    def chars():
        nonlocal read
        for c in " the cat sat on the mat" * 500:
            read += 1
            yield c

    first = next(machine.stream(chars()))
    assert first and read <= 4 * machine.pieces.longest


def test_memory_is_bounded(machine, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(pieces, "REMEMBER", 100)
    machine.forget()
    machine.encode(["".join(rng.choice("abcdefgh ") for _ in range(20_000))])
    assert len(machine.states) <= 100 and machine.learnt <= 100
    machine.forget()
    machine.encode(["=" * 50_000])
    assert all(len(s) <= pieces.PENDING for s in machine.states)


def test_words_outlive_the_states(machine, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    monkeypatch.setattr(pieces, "REMEMBER", 1000)
    machine.forget()
    first, _ = machine.encode([" ".join([*words, "end"])])
    machine.encode(["".join(rng.choice("abcdefgh") for _ in range(20_000))])  # one word, and more states than are remembered
    walked = []
    monkeypatch.setattr(pieces.Machine, "walk", lambda self, at, word: walked.append(word))
    again, _ = machine.encode([" ".join([*words, "end"])])
    assert not walked and again.tolist() == first.tolist()


class Task:
    """Stands for a table and its session; its mapInArrow gives what a task runs."""

    sparkSession = sparkContext = property(lambda self: self)
    broadcast = staticmethod(lambda value: SimpleNamespace(value=value))
    select = lambda self, *columns: self
    mapInArrow = staticmethod(lambda run, schema: run)


def test_a_task_leaves_no_states_behind(monkeypatch):
    def states():
        return sum(type(x) is pieces.State for x in gc.get_objects())

    gc.collect()
    before = states()
    monkeypatch.setattr(gc, "enable", lambda: None)  # what is left to the collector counts as left
    try:
        run = pieces.encode(Task())
        rows = [r for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["thnterti eandble " * 5, "=" * 500]})])) for r in b.to_pylist()]
        assert [r["round_trip"] for r in rows] == [True, True] and states() == before
    finally:
        monkeypatch.undo()
        gc.enable()


def test_encode_decode_over_tables(spark):
    docs = awkward(spark, TEXTS)
    enc = pieces.encode(docs).cache()
    rows = enc.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    for r in rows:
        assert r["n_ids"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<i4").tobytes()).hexdigest()
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(enc).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert pieces.encode(empty(spark)).count() == 0
