"""Exact top-k inner-product search by distributed histogram selection.

Components become floor(256 * x), stored as the smallest whole numbers that hold them. Vectors and queries are dealt to
groups, every pair of which is a cell: `GROUP_BYTES` of either side at most, so what a task holds doesn't grow with the
tables. Every pass scores all candidates against all queries, cell by cell, and sums one global histogram of scores per
query; the bin that holds the kth largest score becomes the next pass's range, until a bin is one score wide. A cell
doesn't count bins below the one of its own kth score, which the kth of all can't be in. A last pass keeps what beats the
kth score, and of the ties at it the smallest ids. A histogram row is a query's bin, at most k of them per query and cell.

Nulls: vectors that are null, or hold null or non-finite components, and rows without an id take no part. A
shorter vector counts as ending in zeros. A query's own id is no candidate for it; rows that repeat an id
are candidates of their own and, as queries, count once, with the least of their vectors (by their components in
order). Fewer than k candidates: all are returned. Ties go to the smaller id. Scores are exact whole numbers whatever
the components, and so is their order; where one doesn't fit a long, the nearest long is reported in its place. A
component whose 256-fold is beyond doubles counts as non-finite. Very long vectors make blocks of fewer rows. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts

DIGIT = 11
BINS = 1 << DIGIT
BLOCK = 2048
BLOCK_BYTES = 4 << 20
QUERIES = 256
GROUP_BYTES = 16 << 20
LONG = (1 << 63) - 1
PACKED = "ids binary, vecs binary"
BINNED = pa.schema([("query_id", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("place", pa.binary())])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    out[row, at] = flat
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exactly: in floating point that holds them, in 64 bits or in Python's integers, as the block's bound asks."""
    bound = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0))
    if bound < 1 << 24:
        return q.astype(np.float32) @ v.astype(np.float32).T
    if bound < 1 << 52:
        return q.astype(np.float64) @ v.astype(np.float64).T
    if bound <= LONG:
        return q.astype(np.int64) @ v.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    return exact(q) @ exact(v).T


def starts(digits: list[list[int]], bound: int, passes: int) -> list[int]:
    """Where the ranges begin that the digits of the passes so far have led to."""
    return [sum(d << (passes - 1 - i) * DIGIT for i, d in enumerate(row)) - bound for row in digits]


def _tiles(vectors: pa.Table, queries: pa.Table, kind: str, dim: int, bound: int, passes: int) -> Iterator[tuple]:
    """For each block of a cell's queries: their ids, needs and range starts, and found(least, lo, hi): the pairs among vectors lo to hi that score least or more."""
    if not vectors.num_rows:
        return
    v_ids = np.frombuffer(b"".join(vectors.column("ids").to_pylist()), np.int64)
    v = np.frombuffer(b"".join(vectors.column("vecs").to_pylist()), kind).reshape(-1, dim)
    for row in queries.to_pylist():
        q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vecs"], kind).reshape(-1, dim)
        digits, need = json.loads(row["state"])
        start = starts(digits, bound, passes)

        def found(least: list[int], lo: int, hi: int, q_ids=q_ids, q=q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            s = products(q, v[lo:hi])
            if s.dtype.kind == "f":  # no score is below the tile's own bound, which these hold exactly
                held = 1 << (24 if s.dtype == np.float32 else 52)
                least = [max(-held, min(held, x)) for x in least]
            elif s.dtype == np.int64:
                over = np.array([x > LONG for x in least])
                least = [max(-LONG - 1, min(LONG, x)) for x in least]
            hit = s >= np.array(least, s.dtype)[:, None]
            if s.dtype == np.int64:
                hit[over] = False
            qi, vi = np.nonzero(hit)
            other = q_ids[qi] != v_ids[lo:hi][vi]
            qi, vi = qi[other], vi[other]
            x = s[qi, vi]
            return qi, v_ids[lo + vi], x.astype(np.int64) if x.dtype.kind == "f" else x

        yield q_ids, need, start, found, _cuts(len(v_ids), max(1, min(BLOCK, BLOCK_BYTES // (8 * dim))))


def _cuts(n: int, block: int) -> list[tuple[int, int]]:
    """Ranges of 0 to n, the first ones short: what they hold says which of the later scores count."""
    at = [0, *(c for c in (block // 32, block // 4) if 0 < c < n), *range(block, n, block), n]
    return list(zip(at[:-1], at[1:]))


def _above(x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """x - least for x >= least, exactly: the difference of two longs fits 64 bits without a sign."""
    return x - least if object in (x.dtype, least.dtype) else x.astype(np.uint64) - least.astype(np.uint64)


def _whole(values: list[int]) -> np.ndarray:
    return np.array(values, np.int64 if all(-LONG - 1 <= x <= LONG for x in values) else object)


def _histograms(kind: str, dim: int, bound: int, passes: int, shift: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for q_ids, need, start, found, cuts in _tiles(vectors, queries, kind, dim, bound, passes):
            n, first = np.zeros((len(q_ids), BINS), np.int64), np.zeros(len(q_ids), np.int64)
            lo, need = _whole(start), np.array(need)[:, None]
            for a, b in cuts:
                qi, _, x = found([at + (int(f) << shift) for at, f in zip(start, first)], a, b)
                above = _above(x, lo[qi]) >> (shift if object in (x.dtype, lo.dtype) else np.uint64(shift))
                within = above < BINS
                qi, above = qi[within], above[within].astype(np.int64)
                np.add.at(n.reshape(-1), qi * BINS + above, 1)
                if len(qi) * 64 >= len(q_ids) * (b - a):  # many still count: the least bin is looked for anew
                    reached = n[:, ::-1].cumsum(1) >= need
                    first = np.where(reached[:, -1], BINS - 1 - reached.argmax(1), 0)
            n[np.arange(BINS) < first[:, None]] = 0
            qi, bins = np.nonzero(n)
            out.append(pa.table([pa.array(q_ids[qi]), pa.array(bins.astype(np.int32)), pa.array(n[qi, bins])], BINNED))
        return pa.concat_tables([BINNED.empty_table(), *out])

    return run


def _survivors(kind: str, dim: int, k: int, bound: int, passes: int):
    width = passes * DIGIT // 8 + 1

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for q_ids, _, start, found, cuts in _tiles(vectors, queries, kind, dim, bound, passes):
            hits = [found(start, a, b) for a, b in cuts]
            qi, v_ids, x = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((v_ids, qi))
            qi, v_ids, x = qi[order], v_ids[order], x[order]
            tie = x == _whole(start)[qi]
            before = np.cumsum(tie) - tie  # ties that stand before
            keep = ~tie | (before - before[np.searchsorted(qi, qi, "left")] < k)
            values = [int(v) for v in x[keep]]
            places = pa.array([(v + bound).to_bytes(width, "big") for v in values], pa.binary())
            scores = pa.array([max(-LONG - 1, min(LONG, v)) for v in values], pa.int64())
            out.append(pa.table([pa.array(q_ids[qi[keep]]), pa.array(v_ids[keep]), scores, places], FOUND))
        return pa.concat_tables([FOUND.empty_table(), *out])

    return run


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by query_every."""
    x = F.col("embedding")
    scaled = lambda c: c.cast("double") * 256
    floor = lambda y: F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(y).cast("double"))  # noqa: E731  (beyond, doubles are whole)
    whole = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(scaled(c)) == float("inf"))))
    whole = whole.select("vec_id", F.transform(x, lambda c: floor(scaled(c))).alias("q"))
    most, dim, count = whole.agg(F.max(F.array_max(F.transform("q", lambda c: F.abs(c)))), F.max(F.size("q")), F.count(F.lit(1))).first()
    dim, count = max(dim or 1, 1), count or 0
    bound = int(most or 0) ** 2 * dim
    kind = "i2" if (most or 0) < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    row_bytes = np.dtype(kind).itemsize * dim
    block, q_block = (max(1, min(most_rows, BLOCK_BYTES // row_bytes)) for most_rows in (BLOCK, QUERIES))
    passes = max(1, -(-(2 * bound + 1).bit_length() // DIGIT))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                ids, m = part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("q"), dim).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "vecs"])

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            for own in np.unique(h):
                rows = batch.take(pa.array(np.flatnonzero(h == own)))
                for lo in range(0, rows.num_rows, q_block):
                    part = rows.slice(lo, q_block)
                    cols = [part.column("vec_id").to_numpy().astype(np.int64), _matrix(part.column("q"), dim).astype(kind)]
                    state = pa.array([json.dumps([part.column("digits").to_pylist(), part.column("need").to_pylist()])])
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols), state], ["h", "q_ids", "q_vecs", "state"])

    # a group of vectors meets every group of queries: more of them than the bytes ask for only while the copies of the queries are few
    n_queries = max(1, -(-count // query_every))
    share = max(1, GROUP_BYTES // row_bytes)
    groups = max(1, -(-count // share), min(-(-count // block), parts(vectors.sparkSession), 2 * query_every))
    query_groups = -(-n_queries // share)
    # one group after the other, from another one in each partition
    by_group = F.pmod(F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(groups)) + F.pmod(F.monotonically_increasing_id(), F.lit(groups)), F.lit(groups)).cast("int")
    packed = materialize(whole.mapInArrow(pack, PACKED).withColumn("g", by_group), "topk-vectors")
    queries = whole.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    queries = materialize(queries.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(query_groups)).cast("int")), "topk-queries")
    query_parts = max(query_groups, -(-n_queries // (8 * QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(state: DataFrame, scored, ddl: str) -> DataFrame:
        q = queries.join(state, F.col("vec_id") == F.col("query_id")).repartition(query_parts, F.xxhash64("vec_id"))
        q = q.select("h", "vec_id", "q", "digits", "need").mapInArrow(pack_queries, "h int, q_ids binary, q_vecs binary, state string")
        q = q.withColumn("g", each(groups))
        v = packed.withColumn("h", each(query_groups))
        return v.groupBy("g", "h").cogroup(q.groupBy("g", "h")).applyInArrow(scored, ddl)

    state = queries.select(F.col("vec_id").alias("query_id"), F.array().cast("array<int>").alias("digits"), F.lit(k).cast("long").alias("need"))
    down = Window.partitionBy("query_id").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    for i in reversed(range(passes)):
        bins = cells(state, _histograms(kind, dim, bound, passes, i * DIGIT), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        seen = state.join(bins.withColumn("through", F.sum("n").over(down)), "query_id", "left")
        # the bin of the kth score; with fewer than k scores the range's start stays, below them all
        hit = F.when(F.col("through") >= F.col("need"), F.struct(F.col("bin"), (F.col("need") - F.col("through") + F.col("n")).alias("left")))
        best = seen.groupBy("query_id", "digits", "need").agg(F.max(hit).alias("hit"))
        stepped = best.select("query_id", F.array_append("digits", F.coalesce("hit.bin", F.lit(0))).alias("digits"), F.coalesce("hit.left", "need").alias("need"))
        state = materialize(stepped, "topk-state")
    found = cells(state, _survivors(kind, dim, k, bound, passes), "query_id long, vec_id long, score long, place binary")
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
