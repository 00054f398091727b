"""Near-duplicates by min-max hashing: banded signatures, exact confirmation, connected components.

Words are lower-cased (A-Z) and cut into 5-word shingles. Under each of 64 permutations of the 64-bit
shingle hashes both the minimum and the maximum are kept, 128 values from 64 evaluations, in 32 bands of 4.
A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32, about 5e-6.

Documents with equal shingle sets form a class and go on as one node, its smallest doc_id. In every bucket
of a band all nodes are compared with the smallest one, never all with all; texts travel to (pivot, chunk of
256 partners), so a large group is spread over tasks. After the linked nodes' components are known, a
bucket may still hold nodes of different components. Two bounds say which of their pairs can be linked at
all, and exactly those are compared too: Jaccard distance is a metric, so the distances to the pivot differ
by at most 0.25; and shingles that no other node in question has are in no intersection, so what is left of
either set must reach 3/7 of both sizes together (an intersection of 0.75 of the union). Nodes of a large
bucket are dealt to tiles of about `TILE` for that, each against the whole bucket, so its pairs are tested by many
tasks. A finer min-max sketch of these nodes, one bit of each of 1024 values, leaves out most pairs that are clearly below: at 0.75
the differing bits are 128 with a standard deviation of 10.6, so 181 is passed with probability 3e-7. No
partner or bucket is capped. Every link is confirmed on the full sets.

Nulls: a null text and one without words have an empty set, linked with nothing; rows with a null doc_id
stand alone and are kept. Texts of fewer than five words have one shingle; very long ones are read whole. Rows that
repeat a doc_id are one document; if their texts are unlike, it is linked by the one with the smallest set (ties:
the smallest hashes), and all its rows get that component. Ties for a component's name can't be. An empty table gives no rows; other columns are ignored by `near_duplicates` and kept by
`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, buffers, free_name, materialize, mix, parts, scratch, shingles, span_hash, words

WIDTH = 5
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
CHUNK = 256
TILE = 1024
SALTS = 16
_rng = np.random.default_rng(75)
TIMES = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
FINE = 1024
FINE_MOST = 181
FINE_TIMES = _rng.integers(0, 2**63, FINE // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FINE_KEYS = _rng.integers(0, 2**63, FINE // 2, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row and sorted in each; their rows; how many each row has."""
    buf, offs = buffers(column)
    buf = LOWER[buf]
    start, end, row = words(buf, offs)
    h, r, _ = shingles(span_hash(buf, start, end), row, WIDTH, len(column))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, r, np.bincount(r, minlength=len(column))


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Band hashes (rows with shingles x BANDS): minima and maxima under each permutation, ROWS to a band."""
    at = (np.cumsum(n) - n)[n > 0]
    values = np.empty((len(at), 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        p = h * TIMES[i] + PLUS[i]
        p ^= p >> np.uint64(32)
        p *= TIMES[-1 - i]
        values[:, 2 * i] = np.minimum.reduceat(p, at)
        values[:, 2 * i + 1] = np.maximum.reduceat(p, at)
    bands = np.empty((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b, np.uint64)
        for c in range(ROWS):  # a minimum and a maximum of one permutation go to different bands
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, c * BANDS + b])
        bands[:, b] = key
    return bands


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in blocks(batch.column("text")):
            h, r, n = sets(batch.column("text").slice(lo, hi - lo))
            at = np.concatenate([[0], np.cumsum(n)])
            one, two = (np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(k)), dtype=np.uint64)]) for k in (1, 2))
            bands = signatures(h, n).view(np.int64).ravel()
            offs = np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32)
            cols = [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "th")), pa.array(n.astype(np.int64))]
            cols += [pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in (one, two)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offs), pa.array(bands))], ["doc_id", "th", "n", "one", "two", "bands"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (pivot, chunk), the pivot's own first; each partner is compared with it on full sets."""
    key, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for lo, hi in blocks(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            h, _, n = sets(part.column("text"))
            at = np.concatenate([[0], np.cumsum(n)])
            pivot, chunk, node = (part.column(c).to_numpy() for c in ("pivot", "chunk", "node"))
            out = []
            for i in range(hi - lo):
                mine = h[at[i] : at[i + 1]]
                if node[i] == pivot[i]:
                    key, own = (pivot[i], chunk[i]), mine.copy()
                    continue
                if key != (pivot[i], chunk[i]):
                    raise RuntimeError("a partner without its pivot")
                a, b = (mine, own) if len(mine) < len(own) else (own, mine)
                both = int((b[np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))] == a).sum()) if len(a) else 0
                out.append((pivot[i], node[i], both, len(mine) + len(own) - both))
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["pivot", "node", "both", "either"])


def large_groups(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """key, and in how many parts of about size rows (name), of keys with more rows than that."""
    return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)).where(F.col(name) > 1)


def salted(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows (with a node) left-joined to groups by key; a key's rows are dealt to SALTS places."""
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(copies, [key, "salt"], "left").drop("salt")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pivot, node, both, either: sizes of intersection and union for every pair. texts: node, text."""
    spark = pairs.sparkSession
    many = large_groups(pairs, "pivot", CHUNK, "chunks")
    chunk = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    members = salted(pairs, many, "pivot").select("pivot", chunk.alias("chunk"), "node")
    leads = members.select("pivot", "chunk").distinct().withColumn("node", F.col("pivot"))
    asked = members.unionByName(leads)
    rows = asked.join(texts.hint("merge"), "node").repartition(parts(spark), "pivot", "chunk").sortWithinPartitions("pivot", "chunk", F.col("node") != F.col("pivot"))
    return rows.select("pivot", "chunk", "node", "text").mapInArrow(_confirm, "pivot long, node long, both long, either long")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in blocks(batch.column("text")):
            h, r, _ = sets(batch.column("text").slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(batch.column("node").to_numpy()[lo + r])], ["shingle", "node"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of each of FINE minima and maxima, in longs."""
    for batch in batches:
        for lo, hi in blocks(batch.column("text"), 1 << 20):
            h, _, n = sets(batch.column("text").slice(lo, hi - lo))
            at = np.cumsum(n) - n
            bits = np.empty((hi - lo, FINE), np.uint8)
            for i in range(FINE // 2):
                p = (h ^ FINE_KEYS[i]) * FINE_TIMES[i]
                p ^= p >> np.uint64(32)
                p *= FINE_TIMES[-1 - i]
                for k, f in enumerate((np.minimum, np.maximum)):
                    v = f.reduceat(p, at)
                    bits[:, 2 * i + k] = (v ^ (v >> np.uint64(17)) ^ (v >> np.uint64(37))) & np.uint64(1)
            longs = np.packbits(bits, axis=1).view(np.int64)
            offs = np.arange(hi - lo + 1, dtype=np.int32) * (FINE // 64)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offs), pa.array(longs.ravel()))], ["node", "bits"])


def sketches(texts: DataFrame) -> DataFrame:
    return texts.select("node", "text").mapInArrow(_sketched, "node long, bits array<long>")


def own_shingles(texts: DataFrame) -> DataFrame:
    """node, own: how many of a node's shingles no other node here has (nodes without any are left out)."""
    once = texts.select("node", "text").mapInArrow(_spelled, "shingle long, node long").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b)."""
    with scratch(edges.sparkSession):
        both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
        now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
        while True:
            told = both.join(now, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("told"))
            step = now.join(told, "node").select("node", F.least("component", "told").alias("near"), F.col("component").alias("old"))
            jump = now.select(F.col("node").alias("at"), F.col("component").alias("far"))
            new = step.join(jump, F.col("near") == F.col("at")).select("node", F.least("near", "far").alias("component"), (F.least("near", "far") != F.col("old")).alias("moved"))
            new = materialize(new, "labels")
            now = new.select("node", "component")
            if not new.where("moved").take(1):
                return materialize(now, "labels", keep=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = materialize(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_scan, "doc_id long, th long, n long, one long, two long, bands array<long>"), "minmax")
    named, whole = signed.where("doc_id is not null"), F.struct("n", "one", "two", "th")
    unlike = named.groupBy("doc_id").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).where("low <> high").select("doc_id", "low")
    unlike = materialize(unlike, "unlike")
    signed = signed.join(unlike, "doc_id", "left")
    own = {c: F.coalesce(F.col("low")[c], F.col(c)) for c in ("one", "two", "n")}
    full = signed.where("n > 0 and doc_id is not null").where(F.col("low").isNull() | (whole == F.col("low")))
    classes = materialize(full.groupBy("one", "two", "n").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "classes")
    buckets = classes.select("node", "n", F.explode("bands").alias("band"))
    pivots = buckets.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last")
    shared = materialize(buckets.join(pivots, "band").select("band", "pivot", "node", "n"), "buckets")
    pairs = materialize(shared.where("node <> pivot").select("pivot", "node").distinct(), "pairs")
    nodes = pairs.select("node").union(pairs.select("pivot")).distinct()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    texts = rows.hint("merge").join(nodes, "node", "left_semi").join(unlike.withColumnRenamed("doc_id", "node"), "node", "left")
    texts = texts.where(F.col("low").isNull() | (F.xxhash64("text") == F.col("low.th"))).select("node", "text")
    texts = materialize(texts.dropDuplicates(["node"]), "texts")
    linked = F.col("both") * 100 >= F.col("either") * 75
    first = materialize(confirm(pairs, texts), "confirmed")
    label = components(first.where(linked).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    # what a bucket still holds of other components, as far as bounds on the pair's similarity allow a link
    apart = (F.lit(1.0) - F.col("both") / F.col("either")).alias("apart")
    held = shared.join(first.select("pivot", "node", linked.alias("linked"), apart), ["pivot", "node"]).join(label, "node", "left")
    held = materialize(held.select("band", "node", "n", "linked", "apart", F.coalesce("component", "node").alias("of")), "held")
    mixed = held.groupBy("band").agg(F.min("linked").alias("all"), F.min("of").alias("low"), F.max("of").alias("high")).where("not all and low < high").select("band")
    held = held.join(mixed, "band", "left_semi")
    few = materialize(texts.join(held.select("node").distinct(), "node", "left_semi"), "texts")
    able = classes.select("node", "n", "bands").join(sketches(few), "node").join(own_shingles(few), "node", "left")
    able = able.withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("most") * 100 >= F.col("n") * 75)
    held = materialize(held.join(materialize(able.select("node", "most", "bits", "bands"), "able"), "node"), "held")
    tiles = large_groups(held.where("not linked"), "band", TILE, "tiles")
    count = F.coalesce("tiles", F.lit(1))
    dealt = salted(held, tiles, "band")
    lone = dealt.where("not linked").withColumn("tile", F.pmod(F.xxhash64("node"), count).cast("int")).alias("x")
    others = dealt.withColumn("tile", F.explode(F.sequence(F.lit(0), count - 1))).alias("y")
    near = (F.abs(F.col("x.apart") - F.col("y.apart")) <= 0.25 + 1e-9) & (F.least("x.most", "y.most") * 7 >= (F.col("x.n") + F.col("y.n")) * 3)
    differ = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(1, FINE // 64)), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
    first_band = F.coalesce(*(F.when(F.col("x.bands")[i] == F.col("y.bands")[i], F.col("x.bands")[i]) for i in range(BANDS)))
    once = F.col("y.linked") | (F.col("x.node") < F.col("y.node"))
    more = lone.join(others, (F.col("x.band") == F.col("y.band")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.of") != F.col("y.of")) & near & once & (differ <= FINE_MOST) & (first_band == F.col("x.band")))
    more = materialize(more.select(F.least("x.node", "y.node").alias("pivot"), F.greatest("x.node", "y.node").alias("node")).distinct(), "pairs")
    second = materialize(confirm(more, texts).where(linked), "confirmed")
    edges = first.where(linked).select("pivot", "node").unionByName(second.select("pivot", "node"))
    label = components(edges.select(F.col("pivot").alias("a"), F.col("node").alias("b"))) if second.take(1) else label
    of_class = classes.select("one", "two", "n", "node").join(label, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), *(c.alias(k) for k, c in own.items())).join(of_class, ["one", "two", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, in their own columns."""
    name = free_name(docs, "gone")
    gone = materialize(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
