import hashlib
import heapq
import random
import re
import zlib

import pytest

from plumbline.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, pos int, head string, s0 string"
SPACE = "[^\x20\x09-\x0d]"


def after_damage(rows):
    """conv_id -> its turns after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        place = (turn is not None, turn or 0, "user" if fate == 4 else role, hashlib.sha256(text.encode()).digest())
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(place, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: [r[1:] for r in sorted(v, key=lambda r: r[0])] for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = re.findall(SPACE, text)
        out.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, flags):
    """Dijkstra's search over (turns read, state) by (cost, audit, lines), every edit one by one."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if (at, state) in best:
            continue
        best[at, state] = (cost, audit, lines)
        ways = [(3, "I", at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            ways.append((4, "D", at + 1, None, None))
            if flags[at] not in ("b", "d"):
                extra = 3 * (flags[at] == "t")
                ways.append((extra, "K", at + 1, role, f"{role}:{text}"))
                ways += [(3 + extra, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for more, letter, to, role, line in ways:
            new = state if role is None else legal.get((state, role[:1]))
            if new is not None:
                heapq.heappush(heap, (cost + more, audit + letter, to, new, lines if line is None else (*lines, line)))
    return min(best[k] for k in [(len(rows), ""), (len(rows), "a")] if k in best)


def brute(rows):
    out = []
    for conv, kept in after_damage(rows).items():
        flags = faults(kept)
        cost, audit, lines = cheapest(kept, flags)
        numbers = [t for t, *_ in kept if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, flags.count("b"), flags.count("d"), flags.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(seed, n, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, most)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "s", "User"])
            text = rng.choice(["Yes.", "No", "ok!", "", " \t", None, "a longer one, unfinished", "é?", f"number {turn}."])
            rows += [(conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("chunk", [2, 1024])
def test_repair_equals_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    rows = conversations(chunk, 150, 9)
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)
    found = turns.repair(frame)
    assert [f"{n} {t}" for n, t in found.dtypes] == [f.replace(" long", " bigint") for f in turns.REPAIRED.split(", ")]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)


def test_a_long_conversation_and_long_texts(spark):
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 50 else "w" * 50000) for i in range(2600)]
    found = turns.repair(spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)).collect()
    assert [str(tuple(r)) for r in found] == brute(rows)


def test_no_conversations(spark):
    assert turns.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    found = turns.repair(spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "x", "y")], SCHEMA)).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
