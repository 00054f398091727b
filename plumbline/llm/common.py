"""What the training-data operators share: tables in the shared folder, and numpy over Arrow text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import folder

_SCRATCH: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and outlives executors.

    keep: it outlives the scratch() it is made in, too.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    held = _SCRATCH[: len(_SCRATCH) - keep]
    if held:
        held[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are deleted at the end. What is needed after that must have been materialized to keep."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries inside have shuffled is deleted when they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A driver-made table of bounded size, without Python workers."""
    names = [c.strip().split()[0] for c in ddl.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}: {t}' for n, t in (c.split() for c in ddl.split(',')))}>>")))


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- numpy over Arrow text

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        a = np.full(size, BASE_INV if inverse else BASE, np.uint64)
        a[0] = 1
        have = _POWERS[key] = np.cumprod(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (rows + 1) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offs = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each (a longer text is a range of its own)."""
    if not len(column):
        return
    _, offs = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal exactly where bytes are (but for 64-bit collisions)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_KEY[buf] * powers(len(buf)), out=sums[1:])
    h = (sums[end] - sums[start]) * powers(len(buf) + 1, True)[start]
    return mix(h ^ mix((end - start).astype(np.uint64)))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words `[^\\x20\\x09-\\x0D]+`; none crosses a row."""
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def shingles(word_hash: np.ndarray, row: np.ndarray, width: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word windows of each row, their rows and their first words. A row with 1..width-1 words has one, of all of them."""
    n = len(word_hash)
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out_h, out_r, out_at = [], [], []
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            h = mix(h * BASE + word_hash[i : n - width + 1 + i])
        ok = row[: n - width + 1] == row[width - 1 :]
        out_h.append(h[ok])
        out_r.append(row[: n - width + 1][ok])
        out_at.append(np.flatnonzero(ok))
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            h = np.full(len(short), k * 0xD1B54A32D192ED03 % 2**64, np.uint64)
            for i in range(k):
                h = mix(h * BASE + word_hash[first[short] + i])
            out_h.append(h)
            out_r.append(short)
            out_at.append(first[short])
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_r), np.concatenate(out_at)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then start[1], ..."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start - ends + n, n)
