"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is quantised into `cells` positions. A key's hash picks its cell; the cell's owner is the shard
of the next virtual node clockwise. Every shard has a capacity (row counts differing by at most one); keys
that meet a full shard go on clockwise to the next virtual node whose shard has room. Keys enter cell by
cell, clockwise from 0, in hash order, so the outcome is a function of the set of rows alone.

Only the row count of each cell (`cells` longs, a fixed number) reaches the driver. It turns them into
portions (cell, first rank, last rank, shard, first slot), at most cells + cells' splits many, which go back
as a broadcast of bounded size. Rows are ranked within their cell, and a slot is the portion's first slot
plus the rank in it, so no shard is ever gathered in one task.

Nulls: a null doc_id is a key like another; a null text counts as empty. Repeated rows are placed one by
one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table, text_or_empty


def ring_points(shards: int, vnodes: int, cells: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    points = []
    for s in range(shards):
        for v in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
            points.append((h % cells, h, s))
    return [(c, s) for c, _, s in sorted(points)]


def portions(counts: dict[int, int], shards: int, vnodes: int, cells: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank, shard, first slot), ranks from 1: where each cell's keys end up."""
    points = ring_points(shards, vnodes, cells)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    out, at = [], 0
    for cell in range(cells):
        left, lo = counts.get(cell, 0), 1
        while at < len(points) and points[at][0] < cell:
            at += 1
        p = at
        while left:
            s = points[p % len(points)][1]
            n = min(left, room[s])
            if n:
                out.append((cell, lo, lo + n - 1, s, filled[s]))
                filled[s] += n
                room[s] -= n
                left -= n
                lo += n
            p += 1
    return out


def bounded_ring(docs: DataFrame, shards: int = 24, vnodes: int = 64, cell_bits: int = 14) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    data = F.encode(text_or_empty(), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text_or_empty()) + F.lit(8)).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32")).withColumn("cell", F.shiftrightunsigned("h", 64 - cell_bits).cast("int"))
    counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}
    plan = small_table(docs.sparkSession, portions(counts, shards, vnodes, 1 << cell_bits), "cell int,lo long,hi long,shard int,at long")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")))
    placed = ranked.join(F.broadcast(plan), (ranked["cell"] == plan["cell"]) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))
