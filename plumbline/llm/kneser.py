"""Quality rules: text statistics, and perplexity under a modified Kneser-Ney n-gram model per language.

The model runs over the characters as they are, order 5, so what it gathers grows with the corpus: there is no
folding and no bound on the number of different n-grams. Texts fall into two folds by content, and each fold is
scored by the model counted on the other one, so no text is part of its own model (equal texts share a fold).

1. Tasks count their texts' 5-grams in sorted hash arrays, by language and fold, and emit each n-gram once with its
   counts; Spark sums them. Counts of the lower orders (different left neighbours), the discounts of each order
   from its counts of counts, the contexts' backoff weights and the interpolated probabilities are joins and
   aggregations of tables. Since every scored n-gram is in the corpus, each has its own entry at the end.
2. The finished model is stored as sorted arrays of 64-bit hashes with both log probabilities, one row a hash range
   of about `RANGE` entries.
3. Scoring broadcasts consecutive ranges up to `slice_bytes`, and scans the texts once for each such slice; the sums
   of several slices are added by text. So neither driver nor tasks ever hold more of the model than that.

A text's score is its mean negative log probability per character. The bands are language-specific and come
from the language's own scores, equal texts taken once (so that copies don't narrow the band): the median less
`width` times the median deviation below it, and plus `width` times that above it. Medians are exact over scores
rounded to `GRAIN` nats, so they depend on no partitioning. As a mean over n characters
spreads like 1 / sqrt(n), texts shorter than the language's median get a reach wider by that law; a language
of N texts gets one wider by 1 + 4 / sqrt(N), about three standard errors of the deviations' median. `slack` is a
floor in nats for who wants one. A text outside its language's band is rejected, as is one that fails the base rules.

Nulls: a null text has no words and fails the base rules; a null lang is a language of its own. A text
without characters has no score and is judged by the base rules alone. Repeated rows count one by one. Very long
texts are counted and scored in stretches of `STRETCH` characters. A table of any size, empty included, is
legal; other columns are ignored by `quality` and kept by `keep`, names of working columns included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, blocks, buffers, free_name, materialize, mix, scratch, span_hash, words

ORDER = 5
START = "\x02"
STRETCH = 1 << 20
HOLD = 1 << 21
RANGE = 1 << 18
GRAIN = 1e-4
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
NO_LANG = "\x00none"
FOLDS = (0, 1)


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def gram_hash(chars: np.ndarray, lang: str) -> np.ndarray:
    """Hash of every window of ORDER code points."""
    m = len(chars) - ORDER + 1
    h = np.full(max(m, 0), lang_hash(lang))
    for k in range(ORDER):
        h = h * BASE + chars[k : k + m]
    return mix(h)


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)


def stretches(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Code points of some texts with ORDER - 1 before each, how many windows each part has, and whose part it is."""
    held: list[str] = []
    whose: list[int] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, list[int]]:
        return code_points(held), np.array([len(t) - ORDER + 1 for t in held]), whose

    for i, text in enumerate(texts):
        for at in range(0, len(text), STRETCH):
            before = START * (ORDER - 1) if at == 0 else text[at - ORDER + 1 : at]
            held.append(before + text[at : at + STRETCH])
            whose.append(i)
            size += len(held[-1])
            if size >= STRETCH:
                yield out()
                held, whose, size = [], [], 0
    if held:
        yield out()


def windows(n: np.ndarray) -> np.ndarray:
    """Which windows of ORDER in joined parts of n windows each lie within one part."""
    gap = np.zeros(int(n.sum()) + (ORDER - 1) * len(n), bool)
    ends = np.cumsum(n + ORDER - 1)
    for k in range(1, ORDER):
        gap[ends - k] = True
    return ~gap[: len(gap) - ORDER + 1]


class Counter:
    """Counts of one language's n-grams by fold, in sorted hash arrays; the n-grams themselves beside them."""

    def __init__(self, lang: str):
        self.lang = lang
        self.keys, self.counts, self.grams = np.zeros(0, np.uint64), np.zeros((0, len(FOLDS)), np.int64), np.zeros((0, ORDER), np.uint32)

    def add(self, texts: list[str], fold: int) -> None:
        for chars, n, _ in stretches(texts):
            key = gram_hash(chars, self.lang)
            at = np.flatnonzero(windows(n))
            key = key[at]
            found, count = np.unique(key, return_counts=True)
            have = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
            old = self.keys[have] == found if len(self.keys) else np.zeros(len(found), bool)
            self.counts[have[old], fold] += count[old]
            new, count = found[~old], count[~old]
            if not len(new):
                continue
            spot = np.zeros(1 << 20, bool)
            spot[new >> np.uint64(44)] = True
            maybe = np.flatnonzero(spot[key >> np.uint64(44)])
            seen, first = np.unique(key[maybe], return_index=True)
            place = at[maybe[first[np.searchsorted(seen, new)]]]
            gram = np.stack([chars[place + k] for k in range(ORDER)], axis=1).astype(np.uint32)
            to = np.searchsorted(self.keys, new)
            self.keys, self.grams = np.insert(self.keys, to, new), np.insert(self.grams, to, gram, axis=0)
            more = np.zeros((len(new), len(FOLDS)), np.int64)
            more[:, fold] = count
            self.counts = np.insert(self.counts, to, more, axis=0)

    def rows(self) -> pa.RecordBatch:
        joined = np.ascontiguousarray(self.grams).tobytes().decode("utf-32-le")
        grams = [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(grams), pa.string()), pa.array(grams, pa.string()), *(pa.array(self.counts[:, f]) for f in FOLDS)], ["lang", "gram", "n0", "n1"])


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[int], list[str]]]:
    """lang, fold, row numbers and texts, for every language and fold in a batch."""
    langs, folds, texts = batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), batch.column("text").to_pylist()
    groups: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(langs, folds)):
        groups.setdefault(key, []).append(i)
    for (lang, fold), at in groups.items():
        yield lang, fold, at, [texts[i] for i in at]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts, each n-gram once or, beyond HOLD of them, once per HOLD."""
    held: dict[str, Counter] = {}
    for batch in batches:
        for lo, hi in blocks(batch.column("text"), 4 << 20):
            for lang, fold, _, texts in _grouped(batch.slice(lo, hi - lo)):
                held.setdefault(lang, Counter(lang)).add(texts, fold)
            if sum(len(c.keys) for c in held.values()) > HOLD:
                yield from (c.rows() for c in held.values())
                held = {}
    yield from (c.rows() for c in held.values())


def text_key() -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce("lang", F.lit(NO_LANG)), F.coalesce("text", F.lit(""))), 256)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id and lang0 as they are; key (of language and text), fold, lang and text without nulls."""
    lang, text = F.coalesce("lang", F.lit(NO_LANG)), F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.col("lang").alias("lang0"), text_key().alias("key"), lang.alias("lang"), text.alias("text"))
    return rows.withColumn("fold", F.conv(F.substring("key", 1, 1), 16, 10).cast("int").bitwiseAND(1))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """lang, k, gram, n0, n1 by fold: raw counts for k = ORDER, continuation counts (different left neighbours) below."""
    raw = texts.select("lang", "fold", "text").mapInArrow(_count, "lang string, gram string, n0 long, n1 long")
    level = materialize(raw.groupBy("lang", "gram").agg(*(F.sum(c).alias(c) for c in ("n0", "n1"))), "ngrams")
    out = level.select("lang", F.lit(ORDER).alias("k"), "gram", "n0", "n1")
    for k in range(ORDER - 1, 0, -1):
        shorter = level.groupBy("lang", F.substring("gram", 2, k).alias("gram"))
        level = shorter.agg(*(F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("n0", "n1")))
        out = out.unionByName(level.select("lang", F.lit(k).alias("k"), "gram", "n0", "n1"))
    return materialize(out, "levels")


def discounts(levels: DataFrame) -> DataFrame:
    """lang, k, d0, d1: [D1, D2, D3+] of each fold's counts (Chen and Goodman); 0.5, 1, 1.5 where they can't be had."""

    def of(n: str) -> Column:
        c = [F.count(F.when(F.col(n) == i, 1)).cast("double") for i in range(1, 5)]
        y = c[0] / (c[0] + 2 * c[1])
        raw = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
        fit = F.array(*(F.least(F.greatest(v, F.lit(0.05)), F.lit(i + 0.95)) for i, v in enumerate(raw)))
        return F.when(F.least(*c) > 0, fit).otherwise(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5)))

    return levels.groupBy("lang", "k").agg(of("n0").alias("d0"), of("n1").alias("d1"))


def probabilities(levels: DataFrame) -> DataFrame:
    """lang, gram, p0, p1 of every n-gram of the highest order: p0 is for texts of fold 0, so counted on fold 1."""
    cut = materialize(discounts(levels), "discounts")
    letters = levels.where("k = 1").groupBy("lang").agg((F.lit(1.0) / F.count(F.lit(1))).alias("p0")).withColumn("p1", F.col("p0"))
    lower = letters.withColumn("gram", F.lit(""))
    for k in range(1, ORDER + 1):
        own = levels.where(F.col("k") == k).join(cut.where(F.col("k") == k).drop("k"), "lang")
        off = {f: F.when(F.col(f"n{f}") > 0, F.element_at(f"d{f}", F.least(F.col(f"n{f}"), F.lit(3)).cast("int"))).otherwise(0.0) for f in FOLDS}
        own = own.select("lang", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"), "n0", "n1", *(off[f].alias(f"o{f}") for f in FOLDS))
        context = own.groupBy("lang", "context").agg(*(F.sum(c).alias(f"sum_{c}") for c in ("n0", "n1", "o0", "o1")))
        shorter = lower.select("lang", F.col("gram").alias("suffix"), *(F.col(f"p{f}").alias(f"q{f}") for f in FOLDS))
        both = own.join(context, ["lang", "context"]).join(shorter, ["lang", "suffix"])

        def seen_by(f: int) -> Column:
            other = 1 - f
            total = F.col(f"sum_n{other}")
            mixed = (F.col(f"n{other}") - F.col(f"o{other}") + F.col(f"sum_o{other}") * F.col(f"q{f}")) / total
            return F.when(total > 0, mixed).otherwise(F.col(f"q{f}"))

        lower = both.select("lang", "gram", *(seen_by(f).alias(f"p{f}") for f in FOLDS))
    return lower


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        chars = code_points(batch.column("gram").to_pylist()).reshape(-1, ORDER)
        key = np.zeros(len(langs), np.uint64)
        for lang in set(langs):
            mine = langs == lang
            key[mine] = gram_hash(chars[mine].ravel(), lang)[::ORDER]
        logs = [pa.array(np.log(batch.column(c).to_numpy()).astype(np.float32)) for c in ("p0", "p1")]
        yield pa.RecordBatch.from_arrays([pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), *logs], ["key", "l0", "l1"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's entries, which are one hash range in order of their hashes, as one row."""
    held = list(batches)
    table = pa.Table.from_batches(held).combine_chunks() if held else None
    if table is None or not table.num_rows:
        return
    key = table.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    cols = [key.tobytes(), *(table.column(c).to_numpy().tobytes() for c in ("l0", "l1"))]
    yield pa.RecordBatch.from_arrays([pa.array([table.column("range")[0].as_py()], pa.int32()), pa.array([len(key)], pa.int64()), *(pa.array([c], pa.binary()) for c in cols)], ["range", "size", "keys", "l0", "l1"])


def model(texts: DataFrame) -> DataFrame:
    """range, size, keys, l0, l1: the model as sorted hash arrays, one row a hash range."""
    with scratch(texts.sparkSession):
        entries = materialize(probabilities(count_ngrams(texts)).mapInArrow(_hashed, "key long, l0 float, l1 float"), "entries")
        ranges = max(1, -(-entries.count() // RANGE))
        bits = (ranges - 1).bit_length()
        place = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int") if bits else F.lit(0)
        ranged = entries.withColumn("range", place).repartitionById(1 << bits, "range").sortWithinPartitions("key")
        return materialize(ranged.mapInArrow(_packed, "range int, size long, keys binary, l0 binary, l1 binary"), "model", keep=True)


class Slice:
    """Some hash ranges of the model: sorted hashes, found from where their leading bits begin."""

    def __init__(self, keys: bytes, *logs: bytes):
        self.keys, self.logs = np.frombuffer(keys, np.uint64), [np.frombuffer(x, np.float32) for x in logs]
        self.bits = max(1, len(self.keys).bit_length())
        self.begin = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    def log_p(self, h: np.ndarray, fold: int) -> np.ndarray:
        at = self.begin[h >> np.uint64(64 - self.bits)]
        most = len(self.keys) - 1
        at = np.minimum(at, most)
        live = np.flatnonzero(self.keys[at] < h)
        while len(live):
            at[live] = np.minimum(at[live] + 1, most)
            live = live[(self.keys[at[live]] < h[live]) & (at[live] < most)]
        return np.where(self.keys[at] == h, self.logs[fold][at], np.float32(0))


def slices(packed: DataFrame, slice_bytes: int) -> list[tuple[int, int]]:
    """First and last range of each slice: consecutive ranges of at most slice_bytes together (one at least)."""
    out: list[list[int]] = []
    held = 0
    for r in packed.select("range", "size").orderBy("range").toLocalIterator():
        if out and held + 16 * r["size"] <= slice_bytes:
            out[-1][1] = r["range"]
            held += 16 * r["size"]
        else:
            out.append([r["range"], r["range"]])
            held = 16 * r["size"]
    return [tuple(x) for x in out]


def load(packed: DataFrame, first: int, last: int) -> tuple[bytes, bytes, bytes]:
    """A slice's arrays; its size is bounded by slice_bytes, or by one range."""
    rows = packed.where(F.col("range").between(first, last)).orderBy("range").toArrow()
    return tuple(b"".join(rows.column(c).to_pylist()) for c in ("keys", "l0", "l1"))


def text_stats(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by row."""
    buf, offs = buffers(column)
    rows = len(column)
    start, end, row = words(buf, offs)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offs[1:]] - sums[offs[:-1]]

    lead = (buf & 0xC0) != 0x80
    inside = np.ones(len(buf), bool)
    inside[np.isin(buf, [9, 10, 11, 12, 13, 32])] = False
    n_words = np.bincount(row, minlength=rows)
    symbols = per_row(np.isin(buf, SYMBOLS))
    return [n_words, per_row(inside & lead), symbols, _dup_lines(buf, offs, inside), _repeat_words(span_hash(buf, start, end), row, rows)]


def _dup_lines(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> np.ndarray:
    rows = len(offs) - 1
    cut = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offs[:-1], cut + 1]))
    starts = starts[starts < len(buf)]
    ends = np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts
    ends = ends - (buf[ends - 1] == 10) if len(starts) else ends
    has = np.concatenate([[0], np.cumsum(inside)])
    ok = has[ends] > has[starts]
    starts, ends = starts[ok], ends[ok]
    row = np.searchsorted(offs, starts, "right") - 1
    key = span_hash(buf, starts, ends)
    order = np.lexsort((key, row))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][same], minlength=rows)


def _repeat_words(hashes: np.ndarray, row: np.ndarray, rows: int, width: int = 5) -> np.ndarray:
    n = len(hashes)
    if n < width:
        return np.zeros(rows, np.int64)
    h = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        h = mix(h * BASE + hashes[i : n - width + 1 + i])
    at = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    key = mix(h[at] + row[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:].copy()
    marks = np.zeros(n + 1, np.int64)
    hit = at[order[twice]]
    marks[hit] += 1
    np.subtract.at(marks, hit + width, 1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(row[covered], minlength=rows)


def _sums(batch: pa.RecordBatch, piece: Slice) -> np.ndarray:
    """What the slice's n-grams add to each text's log probability."""
    sums = np.zeros(batch.num_rows)
    for lang, fold, at, texts in _grouped(batch):
        for chars, n, whose in stretches(texts):
            log_p = piece.log_p(gram_hash(chars, lang)[windows(n)], fold).astype(np.float64)
            np.add.at(sums, np.array(at)[whose], np.add.reduceat(log_p, np.cumsum(n) - n))
    return sums


def scored(docs: DataFrame, slice_bytes: int = 192 << 20) -> DataFrame:
    """doc_id, lang0, key, lang, the statistics, size and score of every row."""
    spark, texts = docs.sparkSession, prepared(docs)
    packed = model(texts)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "lang0", "key", "lang", *STATS, "size", "part"]

    def first(arrays: tuple[bytes, bytes, bytes]):
        shared = spark.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = Slice(*shared.value)
            for batch in batches:
                for lo, hi in blocks(batch.column("text")):
                    part = batch.slice(lo, hi - lo)
                    size = pc.utf8_length(part.column("text")).cast(pa.int64())
                    stats = [pa.array(x.astype(np.int64)) for x in text_stats(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), *stats, size, pa.array(_sums(part, piece))], names)

        return run

    def further(arrays: tuple[bytes, bytes, bytes]):
        shared = spark.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = Slice(*shared.value)
            for batch in batches:
                for lo, hi in blocks(batch.column("text")):
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(_sums(part, piece))], ["key", "more"])

        return run

    cuts = slices(packed, slice_bytes) or [(0, 0)]
    ddl = f"doc_id {kind}, lang0 string, key string, lang string, {', '.join(f'{c} long' for c in STATS)}, size long, part double"
    rows = materialize(texts.mapInArrow(first(load(packed, *cuts[0])), ddl), "quality")
    for cut in cuts[1:]:
        more = texts.mapInArrow(further(load(packed, *cut)), "key string, more double").groupBy("key").agg(F.max("more").alias("more"))
        rows = materialize(rows.join(more, "key").withColumn("part", F.col("part") + F.col("more")).select(*names), "quality")
    return rows.withColumn("score", F.when(F.col("size") > 0, F.round(-F.col("part") / F.col("size"), 9))).drop("part")


def bands(rows: DataFrame) -> DataFrame:
    """lang, mid, below and above (median deviations on each side), typical (median size) and many (texts), of distinct texts."""
    once = rows.where("score is not null").groupBy("lang", "key").agg(F.max("score").alias("score"), F.max("size").alias("size"))
    # a language's rows below are its different bins, of a bounded number, however many texts it has
    once = materialize(once.select("lang", F.round(F.col("score") / GRAIN).cast("long").alias("bin"), F.round(F.log2("size") * 64).cast("long").alias("length")), "bins")
    counted, lengths = (once.groupBy("lang", c).agg(F.count(F.lit(1)).alias("n")) for c in ("bin", "length"))
    half = F.lit(0.5)
    mid = counted.groupBy("lang").agg(F.percentile("bin", half, F.col("n")).alias("mid"), F.sum("n").alias("many"))
    mid = mid.join(lengths.groupBy("lang").agg(F.percentile("length", half, F.col("n")).alias("typical")), "lang")
    off = counted.join(mid, "lang").withColumn("off", F.col("bin") - F.col("mid"))
    side = [F.percentile(F.when(x > 0, x), half, F.col("n")).alias(name) for x, name in ((-F.col("off"), "below"), (F.col("off"), "above"))]
    whole = off.groupBy("lang").agg(*(F.first(c).alias(c) for c in ("mid", "typical", "many")), *side)
    return whole.select("lang", *((F.col(c) * GRAIN).alias(c) for c in ("mid", "below", "above")), F.pow(F.lit(2.0), F.col("typical") / 64).alias("typical"), "many")


def within(width: float, slack: float) -> Column:
    """Whether score lies in the band beside it; null without a score."""
    off = F.col("score") - F.col("mid")
    reach = width * F.when(off > 0, F.col("above")).otherwise(F.col("below"))
    reach = reach * (1 + 4 / F.sqrt("many")) * F.sqrt(F.greatest(F.lit(1.0), F.col("typical") / F.col("size")))
    return F.abs(off) <= F.greatest(reach, F.lit(max(slack, GRAIN)))


def judged(docs: DataFrame, width: float = 6.0, slack: float = 0.0, slice_bytes: int = 192 << 20) -> DataFrame:
    """key, doc_id, lang, the statistics, base_failed, kept and score of every row."""
    rows = scored(docs, slice_bytes)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = rows.join(bands(rows), "lang", "left").withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & F.coalesce(within(width, slack), F.lit(True))
    return rows.select("key", "doc_id", F.col("lang0").alias("lang"), *STATS, "base_failed", kept.alias("kept"), F.round("score", 6).alias("score"))


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, lang, the statistics, base_failed, kept and score of every row."""
    return judged(docs, **options).drop("key")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, in their own columns. Rows are told apart by the hash of language and text."""
    name = free_name(docs, "rejected")
    gone = materialize(judged(docs, **options).where("not kept").select(F.col("key").alias(name)).distinct(), "rejected")
    return docs.join(gone, text_key() == F.col(name), "left_anti")
