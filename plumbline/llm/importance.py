"""Importance resampling towards a target distribution: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark.

Features of a text are its runs of one to three consecutive words, each in one of `BUCKETS` buckets by CRC-32.
One pass has DuckDB unnest and window the words of a block of texts, with zlib's CRC-32 as a registered function,
and spills two kinds of rows to Parquet in the shared folder: the sorted buckets of every document (two bytes a
feature before compression) and the bucket counts of every partition. Spark merges the counts of both tables into
the gains of the buckets, and a second pass over the spilled buckets sums the gains of each document.

The draw is the Gumbel top-k of the weights. Ranks come from one range partitioning of narrow rows by score, doc_id
and row, and from the sizes of the ranges, so no task sees all rows; rows that repeat a doc_id and tie are dealt to
ranges, too.

Nulls: a null text has no words and weight 0; a null doc_id is hashed as empty text and comes last among ties.
Texts of over `LONG` bytes are windowed in segments of words that lap two words over, so that memory stays bounded.
Repeated rows count and are drawn one by one, in any order among themselves. Tables may be empty; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from duckdb.sqltypes import SMALLINT, VARCHAR
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, buffers, materialize, parts, small_table

BUCKETS = 10000
LONG = 1 << 22
SEGMENT = 1 << 16  # words in a segment of a longer text
RANGE_ROWS = 1 << 21

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# A row and bucket as one number for each feature; the lowest bit marks single words. `last` is the last word a feature may begin at.
FEATURES = f"""
    WITH lists AS (SELECT row, last, {WORDS} AS ws FROM texts),
    words AS (SELECT row, last, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
    near AS (SELECT row, i <= last AS begins, w, lead(w, 1) OVER () AS b, lead(w, 2) OVER () AS c, lead(i, 1) OVER () AS ib, lead(i, 2) OVER () AS ic FROM words),
    found AS (
      SELECT row, unnest([w, CASE WHEN ib > 1 THEN w || ' ' || b END, CASE WHEN ib > 1 AND ic > 2 THEN w || ' ' || b || ' ' || c END]) AS feature, unnest([1, 0, 0]) AS single
      FROM near WHERE begins)
    SELECT (row * 16384 + bucket(feature)) * 2 + single AS found FROM found WHERE feature IS NOT NULL"""

COUNTED = "key long, doc_id long, n_words long, n_features long, buckets binary, counts array<long>"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bucket(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = column.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return pa.array((np.fromiter(map(zlib.crc32, data), np.uint32, len(data)) % BUCKETS).astype(np.int16))


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.create_function("bucket", _bucket, [VARCHAR], SMALLINT, type="arrow")
    return con


def segments(texts: pa.Array) -> pa.Table:
    """row, text, last: texts as they are, or long ones in segments of SEGMENT words and the two after them."""
    buf, offs = buffers(texts)
    if len(texts) > 1 or len(buf) <= LONG:
        return pa.table({"row": pa.array(np.arange(len(texts))), "text": texts, "last": pa.array(np.full(len(texts), 2**40))})
    inside = _WORD[buf]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lo = np.arange(0, max(len(starts), 1), SEGMENT)
    pieces = [buf[starts[a] : ends[min(a + SEGMENT + 2, len(ends)) - 1]].tobytes().decode() if len(starts) else "" for a in lo]
    return pa.table({"row": pa.array(np.zeros(len(lo), np.int64)), "text": pa.array(pieces, pa.string()), "last": pa.array(np.full(len(lo), SEGMENT))})


def found_in(con: duckdb.DuckDBPyConnection, texts: pa.Array) -> np.ndarray:
    """Sorted (row, bucket, single) numbers of all features of a block of texts."""
    con.register("texts", segments(texts))
    out = con.sql(FEATURES).to_arrow_table()["found"].to_numpy()
    con.unregister("texts")
    return np.sort(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = connection()
    total = np.zeros(BUCKETS, np.int64)
    names = [f.split()[0] for f in COUNTED.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in blocks(texts):
            n = hi - lo
            found = found_in(con, texts.slice(lo, n).fill_null(""))
            row, bucket = found >> 15, (found >> 1) & 16383
            total += np.bincount(bucket, minlength=BUCKETS)
            sizes = np.bincount(row, minlength=n)
            singles = np.bincount(row[(found & 1) == 1], minlength=n)
            data, ends = bucket.astype("<u2").tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 2
            lists = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            columns = [batch.column("key").slice(lo, n), batch.column("doc_id").slice(lo, n), pa.array(singles), pa.array(sizes), lists, pa.nulls(n, types[-1])]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names)
    con.close()
    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in types[:-1]), pa.array([total], types[-1])], names)


def count_features(texts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """A row of buckets for each text, and one of counts for each partition, in the shared folder."""
    rows = texts.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_count, COUNTED), "features")


def merged_counts(counted: DataFrame) -> DataFrame:
    """bucket, n: the partitions' counts added up; a bucket that none has is missing."""
    return counted.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """Of every bucket, in thousandths: how much likelier it is in the target than in the source. Both are merged counts."""
    sides = [side.withColumn("bucket", F.col("bucket").cast("long")).withColumnRenamed("n", name) for side, name in ((source, "s"), (target, "t"))]
    both = source.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(sides[0], "bucket", "left").join(sides[1], "bucket", "left").na.fill(0)
    sums = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + BUCKETS)
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + BUCKETS)
    rows = both.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")).collect()  # BUCKETS rows
    return [gain for _, gain in sorted((r["bucket"], r["gain"]) for r in rows)]


def weigh(counted: DataFrame, by_bucket: list[int]) -> DataFrame:
    """key, doc_id, n_words, n_features, weight: the sum of the gains of a document's features."""
    table = np.array(by_bucket, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = buffers(batch.column("buckets"))
            sums = np.concatenate([[0], np.cumsum(table[buf.view("<u2")])])
            weight = pa.array(sums[offs[1:] // 2] - sums[offs[:-1] // 2], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "n_words", "n_features")), weight], ["key", "doc_id", "n_words", "n_features", "weight"])

    lists = counted.where("counts is null").select("key", "doc_id", "n_words", "n_features", "buckets")
    return lists.mapInArrow(add, "key long, doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int = 42) -> DataFrame:
    """score: the weight and Gumbel noise that follows from seed and doc_id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """scored with rank, from 1, of the highest scores among rows with enough words; null elsewhere."""
    spark = scored.sparkSession
    scored = materialize(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key").asc()]
    ranges = able.repartitionByRange(max(parts(spark), n // RANGE_ROWS), *order).withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    sizes = sorted((r["part"], r["count"]) for r in ranges.groupBy("part").count().collect())  # a row a range
    before, rows = 0, []
    for part, size in sizes:
        rows.append((part, before))
        before += size
    offsets = small_table(spark, rows, "part int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranges.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; target needs a column text."""
    counted = count_features(docs)
    wanted = count_features(target.select("text").withColumn("doc_id", F.lit(None).cast("long")))
    by_bucket = gains(merged_counts(counted), merged_counts(wanted))
    drawn = draw(with_noise(weigh(counted, by_bucket), seed), percent, least_words)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
