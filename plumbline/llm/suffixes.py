"""Removal of repeated byte strings with a sparse, distributed suffix array.

A byte goes if a string of `LENGTH` bytes around it also starts in a document with a smaller doc_id. Only
suffixes at anchors are kept: of all GRAM-byte grams inside a LENGTH-byte string, the leftmost with the
smallest hash. Equal strings have equal anchors, so nothing is lost, and one suffix in about 16 remains. All
strings with one anchor are a stretch of the text around it, the suffix with its left context.

1. Documents that equal one with a smaller id are known from their digests, and go no further.
2. Candidate search: anchors' fingerprints are dealt out by hash, in packed arrays, and those found in
   several documents go back to their documents. What a chunk of a task repeats by itself goes there at once.
3. There they become suffix records. Equal stretches collapse to one with the smallest doc_id (partial
   aggregation, so a passage of a third of all documents is one row a task). What is left is range-partitioned
   by the suffixes' leading tokens, with splitters that Spark samples; buckets sort their strings by multikey
   quicksort over 8-byte tokens, so neighbours are compared in all their bytes. A splitter lies between different leads, and a lead is shorter than a
   string, so no equal strings stand on two sides of a boundary, which is what comparing across boundaries has
   to settle.
4. A lead of more than about `CROWD` stretches (a common line in many contexts) is partitioned further as
   multikey quicksort would, by more bytes: a string's anchor lies `o` bytes after its start, equal strings have
   equal `o`, and strings with `o` in [a, b] share a lead of 50 - (b - a) bytes around the anchor. So such a
   stretch is cut in two halves of its `o`, each with a longer lead; equal halves collapse, and the halves are
   dealt anew, down to single strings if need be. The size only says when to cut; how strings are compared is the
   same for all. It is estimated from one stretch in `SPOT`.
5. Each stretch's smallest doc_id per string goes back to all its documents by joins on its digest.

Matches never cross documents and are judged on the input. Nulls: a null text is empty; a row with a null
doc_id neither loses bytes nor makes others lose any. Rows that share a doc_id don't cut each other. A very long
text is a block of its own, never cut. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, materialize, mix, parts, scratch, shuffles_dropped, text_or_empty
from .common import ranges as _ranges

LENGTH = 50
GRAM = 20
LOW = np.uint64((1 << 48) - 1)
HOLD = 4 << 20
STRINGS = 1 << 20
CROWD = 4096
SPOT = 16
SALTS = 16
PART_BYTES = 16 << 20


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, anchor place, gram fingerprint and row of every anchor's stretch."""
    n = len(buf)
    if n < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((n,), "<u8", padded, strides=(1,))
    m = n - GRAM + 1
    x = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x += eight[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x += eight[12 : m + 12] * np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(30)
    key = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    span, grams = 1, LENGTH - GRAM + 1
    while 2 * span <= grams:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < grams:
        key = np.minimum(key[: span - grams], key[grams - span :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    lo = np.maximum(offs[:-1], offs[1:] - LENGTH + 1)
    np.add.at(edge, lo, 1)
    np.subtract.at(edge, offs[1:], 1)
    valid = np.cumsum(edge[: len(at)], dtype=np.int32) == 0
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & first)
    last = np.ones(len(at), bool)
    last[:-1] = first[1:] | ~valid[1:]
    end = np.flatnonzero(valid & last)
    place = at[start]
    return start, end, place, x[place], np.searchsorted(offs, start, "right") - 1


PACKED = "bucket int, known boolean, grams binary, ids binary"


def _fingerprints(n_parts: int):
    """Fingerprints to be looked for in other chunks, and those known to be repeated, which are dealt to their documents.

    Of a fingerprint's documents in a chunk only the first and the last are asked about: those between share it
    with them. A fingerprint of a third of all documents thus gives two entries a chunk to its partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            x, ids = _pairs(*(np.concatenate(c) for c in zip(*held)))
            edge = np.ones(len(x) + 1, bool)
            edge[1:-1] = x[1:] != x[:-1]
            asked = edge[1:] | edge[:-1]
            bucket = ((x[asked] >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            yield _dealt(bucket.astype(np.int32), x[asked] & LOW, ids[asked], False)
            if not asked.all():
                yield _dealt(np.mod(ids[~asked], n_parts).astype(np.int32), x[~asked] & LOW, ids[~asked], True)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for lo, hi in blocks(batch.column("text")):
                _, _, _, x, row = anchors(*buffers(batch.column("text").slice(lo, hi - lo)))
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
                held.append((x[new], ids[lo + row[new]]))
                size += int(new.sum())
                if size > HOLD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return run


def _pairs(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted."""
    order = np.lexsort((ids, x))
    x, ids = x[order], ids[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (ids[1:] != ids[:-1])
    return x[new], ids[new]


def _dealt(bucket: np.ndarray, x: np.ndarray, ids: np.ndarray, known: bool) -> pa.RecordBatch:
    """One row a bucket: fingerprints (low 4 bytes of all, then 2 more) and ids, as packed arrays."""
    order = np.argsort(bucket, kind="stable")
    bucket, x, ids = bucket[order], x[order], ids[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=np.int32(2**31 - 1)))
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint16)
    pairs = list(zip(cuts[:-1], cuts[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]]), pa.array([known] * len(pairs), pa.bool_()), pa.array([low[a:b].tobytes() + high[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([ids[a:b].tobytes() for a, b in pairs], pa.binary())],
        ["bucket", "known", "grams", "ids"],
    )


def _unpacked(grams: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(grams, np.uint32, n).astype(np.uint64) | (np.frombuffer(grams, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)), np.frombuffer(ids, np.int64)


def _repeated(n_parts: int):
    """Of the fingerprints of a hash partition, those in several documents, dealt to their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.column("known")
            if known.true_count:
                yield batch.filter(known)
            asked = batch.filter(pc.invert(known))
            held += [_unpacked(g, i) for g, i in zip(asked.column("grams").to_pylist(), asked.column("ids").to_pylist())]
        if not held:
            return
        x, ids = (np.concatenate(c) for c in zip(*held))
        del held
        order = np.argsort(x, kind="stable")
        x, ids = x[order], ids[order]
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        several = np.minimum.reduceat(ids, cuts) < np.maximum.reduceat(ids, cuts)
        keep = np.repeat(several, np.diff(np.append(cuts, len(x))))
        if keep.any():
            yield _dealt(np.mod(ids[keep], n_parts).astype(np.int32), x[keep], ids[keep], True)

    return run


def _key(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(np.uint64)) ^ (x & LOW))


SEGMENTS = "doc_id long, rid long, start int, at int, content binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix records of a partition's documents; its fingerprints (rows without a text) come first."""
    held: list[np.ndarray] = []
    known = np.zeros(0, np.uint64)
    for batch in batches:
        is_doc = batch.column("kind").to_numpy() == 1
        split = int(is_doc.argmax()) if is_doc.any() else len(is_doc)
        for g, i in zip(batch.column("grams").slice(0, split).to_pylist(), batch.column("ids").slice(0, split).to_pylist()):
            x, ids = _unpacked(g, i)
            held.append(_key(ids, x))
        if split == batch.num_rows:
            continue
        if held:
            known, held = np.unique(np.concatenate([known, *held])), []
        docs = batch.slice(split)
        doc_ids, rids = docs.column("doc_id").to_numpy(), docs.column("rid").to_numpy()
        for lo, hi in blocks(docs.column("text")):
            buf, offs = buffers(docs.column("text").slice(lo, hi - lo))
            start, end, place, x, row = anchors(buf, offs)
            key = _key(doc_ids[lo + row], x)
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            start, end, place, row = start[hit], end[hit], place[hit], row[hit]
            size = end - start + LENGTH
            cols = [pa.array(doc_ids[lo + row]), pa.array(rids[lo + row]), pa.array((start - offs[row]).astype(np.int32)), pa.array((place - start).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, _binary(buf, start, size)], ["doc_id", "rid", "start", "at", "content"])


def _binary(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(buf[_ranges(start, size)].tobytes())])


RUNS = "one long, two long, lo array<int>, hi array<int>, first array<long>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by lead; each block holds whole groups of one lead."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) * 16 >= STRINGS:
            table = pa.Table.from_batches(held).combine_chunks()
            leads = table.column("lead")
            cut = table.num_rows - 1
            last = leads[cut]
            while cut > 0 and leads[cut - 1] == last:
                cut -= 1
            if cut:
                yield from (_smallest(b) for b in table.slice(0, cut).combine_chunks().to_batches())
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from (_smallest(b) for b in pa.Table.from_batches(held).combine_chunks().to_batches())


def _smallest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """For each stretch, the smallest doc_id of every string in it, as runs of equal ones."""
    content = batch.column("content")
    buf, offs = buffers(content)
    first = batch.column("first").to_numpy()
    count = np.diff(offs) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    at = _ranges(offs[:-1], count)
    groups = string_groups(buf, at)
    smallest = np.full(int(groups.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, groups, first[row])
    value = smallest[groups]
    begin = np.cumsum(count) - count
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    runs = np.concatenate([[0], np.cumsum(np.bincount(row[lo], minlength=len(count)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(runs), pa.array(v)) for v in ((lo - begin[row[lo]]).astype(np.int32), (hi - begin[row[lo]]).astype(np.int32), value[lo])]
    return pa.RecordBatch.from_arrays([batch.column("one"), batch.column("two"), *lists], ["one", "two", "lo", "hi", "first"])


def string_groups(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Group numbers of the LENGTH-byte strings at these places: equal exactly where the bytes are, in the bytes' order.

    Multikey quicksort with tokens of 8 bytes as letters: strings sort by a token, those that share it go on with the
    next one. A group that shares the next token too is passed over by one comparison, not sorted again.
    """
    tokens = np.ndarray((len(buf),), ">u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    token = tokens[at].astype(np.uint64)
    order = np.argsort(token, kind="stable")
    token = token[order]
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = token[1:] != token[:-1]
    for depth in (*range(8, LENGTH - 8, 8), LENGTH - 8):  # the last one laps over bytes already equal
        rows = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(rows):
            break
        group = np.cumsum(new[rows]) - 1
        token = tokens[at[order[rows]] + depth].astype(np.uint64)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][(group[1:] == group[:-1]) & (token[1:] != token[:-1])]] = True
        rows, group, token = (x[mixed[group]] for x in (rows, group, token))
        sub = np.lexsort((token, group))
        order[rows], token = order[rows[sub]], token[sub]
        new[rows[1:]] |= token[1:] != token[:-1]
    groups = np.empty(len(at), np.int64)
    groups[order] = np.cumsum(new[:-1]) - 1
    return groups


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, lo, hi in zip(batch.column("text").to_pylist(), batch.column("lo").to_pylist(), batch.column("hi").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, lo, 1)
            np.subtract.at(mark, hi, 1)
            gone = np.cumsum(mark[:-1]) > 0
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            out.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        removed, spans, digest = zip(*out) if out else ((),) * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "rid", "n_removed", "n_spans", "kept_sha256"])


HALVES = "whole_one long, whole_two long, shift int, a int, b int, at int, first long, content binary"


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with anchors a to b bytes after their strings' starts, cut in the middle of that; shift: where a half begins."""
    for batch in batches:
        for lo, hi in blocks(batch.column("content")):
            part = batch.slice(lo, hi - lo)
            buf, offs = buffers(part.column("content"))
            last = np.diff(offs) - LENGTH
            at, a, b = (part.column(c).to_numpy().astype(np.int64) for c in ("at", "a", "b"))
            middle = (a + b) // 2
            for least, most in ((a, middle), (middle + 1, b)):
                begin, end = np.maximum(0, at - most), np.minimum(last, at - least)
                ok = np.flatnonzero((begin <= end) & (least <= most))
                begin, end, least, most, g, base = begin[ok], end[ok], least[ok], most[ok], at[ok], offs[:-1][ok]
                own = [part.column(c).take(pa.array(ok)) for c in ("one", "two", "first")]
                cols = [pa.array(x.astype(np.int32)) for x in (begin, least, most, g - begin)]
                content = _binary(buf, base + begin, end - begin + LENGTH)
                yield pa.RecordBatch.from_arrays([own[0], own[1], *cols, own[2], content], ["whole_one", "whole_two", "shift", "a", "b", "at", "first", "content"])


def smallest_runs(stretches: DataFrame, n_parts: int, crowd: int, spot: int) -> DataFrame:
    """one, two, lo, hi, first: what _compare gives for stretches (at, a, b, first, content)."""
    told, cuts, now = None, [], leads(stretches)
    while True:
        sample = now.where((F.pmod("one", F.lit(spot)) == 0) & (F.col("a") < F.col("b")))
        often = materialize(sample.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * spot >= crowd).select("lead"), "crowded")
        calm = now.join(often, "lead", "left_anti").select("lead", "content", "first", "one", "two")
        told = calm if told is None else told.unionByName(calm)
        if not often.take(1):
            break
        halves = materialize(now.join(often, "lead", "left_semi").select("one", "two", "first", "at", "a", "b", "content").mapInArrow(_halves, HALVES), "halves")
        cuts.append(digests(halves).select("whole_one", "whole_two", "shift", "one", "two"))
        now = leads(materialize(halves.groupBy("content", "at", "a", "b").agg(F.min("first").alias("first")), "stretches"))
    runs = told.repartitionByRange(n_parts, "lead").sortWithinPartitions("lead").mapInArrow(_compare, RUNS)
    if not cuts:
        return runs
    runs = materialize(runs, "runs")
    every = runs
    for left, cut in reversed(list(enumerate(cuts))):  # from the smallest halves back to whole stretches
        moved = [F.transform(c, lambda x: x + F.col("shift")).alias(c) for c in ("lo", "hi")]
        below = every.join(cut, ["one", "two"]).select(F.col("whole_one").alias("one"), F.col("whole_two").alias("two"), *moved, "first")
        every = every.unionByName(below)
        every = materialize(every, "runs") if left else every
    return every


def digests(df: DataFrame) -> DataFrame:
    """Two hashes of content under different seeds: xxhash64(content, 1) would only hash 1 under the first one's value."""
    return df.withColumn("one", F.xxhash64("content")).withColumn("two", F.xxhash64(F.lit(1), "content"))


def leads(stretches: DataFrame) -> DataFrame:
    """With lead, the bytes around the anchor that all strings of a stretch share, and digests: neither is stored, since both follow from the content."""
    return digests(stretches.withColumn("lead", F.substring("content", F.col("at") - F.col("a") + 1, F.lit(LENGTH) - F.col("b") + F.col("a"))))


def repeated_ranges(docs: DataFrame, n_bytes: int, crowd: int = CROWD, spot: int = SPOT) -> DataFrame:
    """doc_id, rid, lo, hi: the byte ranges that go, overlapping as they come, for texts without an equal before them.

    What a step has made for the next one goes as soon as that has its result: the disk has one step's tables at a time.
    """
    spark = docs.sparkSession
    n_parts = max(parts(spark), -(-n_bytes // PART_BYTES)) | 1
    with scratch(spark):
        prints = docs.select("doc_id", "text").mapInArrow(_fingerprints(n_parts), PACKED)
        found = materialize(prints.repartitionById(n_parts, "bucket").mapInArrow(_repeated(n_parts), PACKED), "repeated-grams")
        segments = materialize(_with_texts(docs, found, n_parts), "segments", keep=True)
    with scratch(spark):
        distinct = materialize(segments.groupBy("content", "at").agg(F.min("doc_id").alias("first")), "stretches")
        distinct = distinct.withColumns({"a": F.lit(0), "b": F.lit(LENGTH - GRAM)})
        runs = materialize(smallest_runs(distinct, n_parts, crowd, spot), "runs", keep=True)
    joined = digests(segments).select("doc_id", "rid", "start", "one", "two").join(runs, ["one", "two"])
    each = joined.select("doc_id", "rid", "start", F.explode(F.arrays_zip("lo", "hi", "first")).alias("r")).where("r.first < doc_id")
    return each.groupBy("doc_id", "rid").agg(F.collect_list((F.col("start") + F.col("r.lo")).cast("int")).alias("lo"), F.collect_list((F.col("start") + F.col("r.hi") + LENGTH).cast("int")).alias("hi"))


def _with_texts(docs: DataFrame, found: DataFrame, n_parts: int) -> DataFrame:
    """The suffix records of all texts, whose repeated fingerprints meet them."""
    nothing = F.lit(None).cast("binary")
    rows = docs.select(F.pmod("doc_id", F.lit(n_parts)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "doc_id", "rid", "text", nothing.alias("grams"), nothing.alias("ids"))
    told = found.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("string").alias("text"), "grams", "ids")
    both = rows.unionByName(told).repartitionById(n_parts, "bucket").sortWithinPartitions("kind")
    return both.mapInArrow(_segments, SEGMENTS)


def remove_repeats(docs: DataFrame, crowd: int = CROWD, spot: int = SPOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    text = text_or_empty()
    keyed = docs.select("doc_id", text.alias("text"))
    with scratch(spark), shuffles_dropped(spark):
        known = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
        known = materialize(known, "digests")
        before = known.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # a large group of copies is salted: its few rows of `before` go to every salt
        before = before.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = known.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
        known = salted.join(before, ["sha", "salt"], "left").drop("salt").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
        known = materialize(known, "copies", keep=True)
        copies = materialize(known.where("copy").select("doc_id", "rid").distinct(), "copied")
        live = keyed.where("doc_id is not null").withColumn("rid", F.xxhash64("doc_id", "text")).where(F.octet_length("text") >= LENGTH).join(copies, ["doc_id", "rid"], "left_anti")
        live = materialize(live, "live")  # it is read three times
        n_bytes = known.agg(F.sum("n_bytes")).first()[0] or 0
        with scratch(spark):
            ranges = materialize(repeated_ranges(live, n_bytes, crowd, spot), "ranges", keep=True)
        cut = live.join(ranges, ["doc_id", "rid"]).dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", "text", "lo", "hi").mapInArrow(_cut, "doc_id long, rid long, n_removed long, n_spans long, kept_sha256 string")
        cut = materialize(cut.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "n_removed", "n_spans", "kept_sha256"), "cut", keep=True)
    whole = F.col("copy") & (F.col("n_bytes") >= LENGTH)
    rows = known.join(cut, (F.col("doc_id") == F.col("d")) & (F.col("rid") == F.col("r")), "left")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
