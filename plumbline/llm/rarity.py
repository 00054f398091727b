"""Document fingerprints of improbable features: byte windows of rare entropy in chained Bloom filters.

* Every window of `WINDOW` bytes has an entropy level, 0 to `LEVELS`. Levels are counted over all windows of all
  documents, and a level's rank is its place from the rarest to the commonest (ties: the lower level first).
* In every run of `WINDOW` neighbouring windows the one of least rank is voted for (ties: the leftmost); windows of a
  level under `WEAK` get no vote. Those with `VOTES` votes and more are features. A text in which none has is
  represented by its window of least rank, weak or not, and a text shorter than a window by itself.
* A feature sets five bits of a filter of `BITS` bits; after `CAPACITY` different features the next filter of the
  chain begins. The fingerprint is the number of features and the filters in base64.
* Likeness of two fingerprints: for every filter of the one with fewer features, the best overlap with a filter of
  the other, as a share of what is possible beyond chance (expected common bits and `SIGMAS` of their deviations),
  averaged by the filters' features. 1 for equal fingerprints, 0 where one has no features.

Levels and fingerprints are numpy over blocks of Arrow text. To meet its neighbour, each text is shuffled once, to a
range of doc_ids of about `RANGE_BYTES`; the first row of each range is copied to the range before it, so that no task
sees more than its range. Ranges are cut by bytes from narrow rows (a row per 64 kB), by Spark.

The next document is the one with the next smaller doc_id (after the smallest: the largest). Nulls: a null text is
empty and has an empty fingerprint; a null doc_id comes after all others. Rows that share a doc_id are ordered by text
and stay in one range. Very long texts are taken whole. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, blocks, buffers, materialize, mix, parts, text_or_empty

WINDOW = 64
LEVELS = 1000
WEAK = 100
VOTES = 16
BITS = 2048
CAPACITY = 128
HASHES = 5
SIGMAS = 3.0
RANGE_BYTES = 64 << 20
UNIT = 1 << 16  # bytes that weigh as one row when ranges are cut

_ONE = 1 << 20
_F = np.array([round(c * np.log2(c) * _ONE) if c else 0 for c in range(WINDOW + 1)], np.int64)
_G = np.concatenate([[0], np.diff(_F)])
_MOST = int(_F[WINDOW])


def levels(buf: np.ndarray) -> np.ndarray:
    """Entropy level of every window of WINDOW bytes."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    out = np.empty(n, np.int16)
    for lo in range(0, n, 1 << 16):  # blocks that stay in the cache
        hi = min(lo + (1 << 16), n)
        x = buf[lo : hi + WINDOW - 1]
        ahead, back = np.ones(len(x), np.uint8), np.ones(len(x), np.uint8)
        same = np.empty(len(x), bool)
        for d in range(1, WINDOW):
            eq = np.equal(x[d:], x[:-d], out=same[d:]).view(np.uint8)
            ahead[:-d] += eq
            back[d:] += eq
        total = np.empty(hi - lo, np.int64)
        total[0] = _F[np.bincount(x[:WINDOW], minlength=256)].sum()
        np.cumsum(_G[back[WINDOW:]] - _G[ahead[: hi - lo - 1]], out=total[1:])
        total[1:] += total[0]
        out[lo:hi] = (_MOST - total) * LEVELS // _MOST
    return out


def _within(offs: np.ndarray, n: int, width: int) -> np.ndarray:
    """For n places: do the width bytes from there on lie in one text?"""
    long = np.flatnonzero(np.diff(offs) >= width)
    step = np.zeros(n + 1, np.int8)
    step[offs[long]] += 1
    step[offs[long + 1] - width + 1] -= 1
    return np.cumsum(step[:n], dtype=np.int8) > 0


def level_counts(texts: pa.Array) -> np.ndarray:
    """How many windows inside the texts have each level."""
    buf, offs = buffers(texts)
    found = levels(buf)
    return np.bincount(found[_within(offs, len(found), WINDOW)], minlength=LEVELS + 1)


def rank_of(counts: np.ndarray) -> np.ndarray:
    """Rank of every level, 0 for the rarest."""
    rank = np.empty(len(counts), np.int16)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    return rank


def popular(level: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the windows with VOTES votes and more, block by block."""
    n = len(level)
    votes = np.zeros(n, np.uint8)
    voter = _within(offs, n, 2 * WINDOW - 1)
    strong = np.where(np.arange(LEVELS + 1) < WEAK, LEVELS + 1, rank).astype(np.int64)
    for lo in range(0, n, UNIT):
        some = level[lo : lo + UNIT + WINDOW - 1]
        least = (strong[some] << 32) | np.arange(len(some))
        for half in (1, 2, 4, 8, 16, 32):  # after these, the least of WINDOW neighbours
            np.minimum(least[:-half], least[half:], out=least[:-half])
        voted = least[:UNIT][voter[lo : lo + UNIT]]
        voted = voted[voted < (LEVELS + 1) << 32] & 0xFFFFFFFF
        votes[lo : lo + len(some)] += np.bincount(voted, minlength=len(some)).astype(np.uint8)
    return np.flatnonzero(votes >= VOTES)


def window_hash(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start : start + size], size WINDOW at most."""
    at = start[:, None] + np.arange(WINDOW)
    data = np.where(np.arange(WINDOW) < size[:, None], buf[np.minimum(at, max(len(buf) - 1, 0))], 0).astype(np.uint8)
    h = mix(size.astype(np.uint64))
    for column in data.view(np.uint64).T:
        h = mix(h * BASE + column)
    return h


def features(buf: np.ndarray, offs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the different features of all texts, in the texts' order."""
    size = np.diff(offs)
    level = levels(buf)
    at = popular(level, offs, rank)
    without = np.ones(len(size), bool)
    without[np.searchsorted(offs, at, "right") - 1] = False
    alone = [offs[r] + int(np.argmin(rank[level[offs[r] : offs[r + 1] - WINDOW + 1]])) for r in np.flatnonzero(without & (size >= WINDOW))]
    start = np.sort(np.concatenate([at, np.array(alone, np.int64), offs[:-1][(size > 0) & (size < WINDOW)]]))
    row = np.searchsorted(offs, start, "right") - 1
    value = window_hash(buf, start, np.minimum(size[row], WINDOW))
    order = np.lexsort((start, value, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1])
    keep = np.sort(order[new])
    return row[keep], value[keep]


class Digests:
    """Fingerprints of some texts: filters as rows of 64-bit words, first filter and number of features of each text."""

    def __init__(self, row: np.ndarray, value: np.ndarray, rows: int):
        self.n = np.bincount(row, minlength=rows)
        chain = -(-self.n // CAPACITY)
        self.first = np.concatenate([[0], np.cumsum(chain)])
        at = self.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)) // CAPACITY
        bits = np.zeros(int(self.first[-1]) * BITS, bool)
        code = mix(value)
        for i in range(HASHES):
            bits[at * BITS + ((code >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.filters = np.packbits(bits).view(np.uint64).reshape(-1, BITS // 64)
        self.ones = np.bitwise_count(self.filters).sum(1, dtype=np.int64)

    def text(self, i: int) -> str:
        return f"{self.n[i]}:{base64.b64encode(self.filters[self.first[i] : self.first[i + 1]].tobytes()).decode()}"


def digests(texts: pa.Array, rank: np.ndarray) -> Digests:
    buf, offs = buffers(texts)
    return Digests(*features(buf, offs, rank), len(texts))


def _overlap(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Overlap beyond chance of filters a with filters b, by broadcasting; na and nb are their set bits."""
    common = np.bitwise_count(a & b).sum(-1, dtype=np.int64)
    chance = na * nb / BITS
    floor = chance + SIGMAS * np.sqrt(chance)
    most = np.minimum(na, nb)
    return np.where(most > floor, np.clip((common - floor) / np.where(most > floor, most - floor, 1), 0, 1), 0.0)


def _one_way(a: Digests, i: int, b: Digests, j: int) -> float:
    fa, fb = slice(a.first[i], a.first[i + 1]), slice(b.first[j], b.first[j + 1])
    weight = np.full(fa.stop - fa.start, CAPACITY)
    weight[-1] = a.n[i] - CAPACITY * (len(weight) - 1)
    best = np.zeros(len(weight))
    for lo in range(0, len(best), 64):
        for at in range(fb.start, fb.stop, 256):
            to = slice(at, min(at + 256, fb.stop))
            found = _overlap(a.filters[fa][lo : lo + 64, None], a.ones[fa][lo : lo + 64, None], b.filters[None, to], b.ones[None, to])
            best[lo : lo + 64] = np.maximum(best[lo : lo + 64], found.max(1))
    return float((best * weight).sum() / weight.sum())


def likeness(a: Digests, i: np.ndarray, b: Digests, j: np.ndarray) -> np.ndarray:
    """Of the i-th text of a with the j-th of b, pair by pair."""
    out = np.zeros(len(i))
    ca, cb = a.first[i + 1] - a.first[i], b.first[j + 1] - b.first[j]
    single = np.flatnonzero((ca == 1) & (cb == 1))
    fa, fb = a.first[i[single]], b.first[j[single]]
    out[single] = np.where((a.filters[fa] == b.filters[fb]).all(1), 1.0, _overlap(a.filters[fa], a.ones[fa], b.filters[fb], b.ones[fb]))
    for k in np.flatnonzero((ca * cb == 0) | (ca > 1) | (cb > 1)):
        x, y = int(i[k]), int(j[k])
        if ca[k] == cb[k] and a.n[x] == b.n[y] and np.array_equal(a.filters[a.first[x] : a.first[x + 1]], b.filters[b.first[y] : b.first[y + 1]]):
            out[k] = 1.0
        elif ca[k] and cb[k]:
            ways = ([_one_way(a, x, b, y)] if a.n[x] <= b.n[y] else []) + ([_one_way(b, y, a, x)] if b.n[y] <= a.n[x] else [])
            out[k] = sum(ways) / len(ways)
    return out


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SURVEY = "doc_id long, n_bytes long, counts array<long>"


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = ["doc_id", "n_bytes", "counts"], [pa.int64(), pa.int64(), pa.list_(pa.int64())]
    total = np.zeros(LEVELS + 1, np.int64)
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in blocks(texts):
            total += level_counts(texts.slice(lo, hi - lo))
        size = pa.array(np.diff(buffers(texts)[1]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.nulls(len(batch), types[2])], names)
    yield pa.RecordBatch.from_arrays([pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.array([total], types[2])], names)


def survey(docs: DataFrame) -> DataFrame:
    """A narrow row for each text, and one of level counts for each partition, in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(rows.mapInArrow(_survey, SURVEY), "rarity")


def ranks(surveyed: DataFrame) -> np.ndarray:
    merged = surveyed.where("counts is not null").select(F.posexplode("counts").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect()  # LEVELS rows
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in merged:
        counts[r["level"]] = r["n"]
    return rank_of(counts)


def cut(surveyed: DataFrame) -> list[int | None]:
    """The largest doc_id of every range of about RANGE_BYTES, descending, a null one last. As many rows as ranges reach the driver."""
    rows = surveyed.where("counts is null")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    units = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr(f"n_bytes div {UNIT}"))).alias("unit")).select("doc_id")
    ranges = units.repartitionByRange(max(parts(surveyed.sparkSession), total // RANGE_BYTES), F.col("doc_id").desc_nulls_last())
    heads = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("head")).collect()
    return sorted((r["head"] for r in heads), key=lambda h: (h is None, -(h or 0)))


def _deal(heads: list[int | None]):
    """Rows with their range and false; the first rows of a range once more, with the range before (of the first: the last) and true."""
    known = np.array([-h for h in heads if h is not None], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column("doc_id")
            missing = doc_id.is_null().to_numpy(zero_copy_only=False)
            number = doc_id.fill_null(0).to_numpy()
            place = np.where(missing, len(heads) - 1, np.searchsorted(known, -number, "right") - 1)
            head = np.where(missing, heads[-1] is None, np.isin(-number, known)) if heads else missing
            for at, part, copy in ((None, place, False), (np.flatnonzero(head), (place[head] - 1) % max(len(heads), 1), True)):
                rows = batch if at is None else batch.take(pa.array(at))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), copy)), *rows.columns], ["part", "copy", *rows.schema.names])

    return deal


NEAR = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rank: np.ndarray):
    """Rows in order, the last one only a neighbour."""

    def block(ids: list, texts: list[str]) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        n = len(changed)
        both = digests(pa.array(texts + changed, pa.large_string()), rank)
        i = np.arange(n)
        columns = [
            pa.array(ids[:n], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([both.text(k) for k in range(n)], pa.string()),
            pa.array([both.text(n + 1 + k) for k in range(n)], pa.string()),
            pa.array(likeness(both, i, both, n + 1 + i)),
            pa.array(likeness(both, i, both, i + 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEAR.split(", ")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, ended = [], [], 0, False
        for batch in batches:
            for doc_id, text, copy in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("copy").to_pylist()):
                if ended:
                    break
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                ended = copy
                if held > 1 << 19 and len(texts) > 1:
                    yield block(ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield block(ids, texts)

    return compare


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of NEAR for every row of docs."""
    surveyed = survey(docs)
    rank, heads = ranks(surveyed), cut(surveyed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.mapInArrow(_deal(heads), "part int, copy boolean, doc_id long, text string")
    near = dealt.repartitionById(max(len(heads), 1), "part").sortWithinPartitions("copy", F.col("doc_id").desc_nulls_last(), "text")
    return near.mapInArrow(_compare(rank), NEAR)
