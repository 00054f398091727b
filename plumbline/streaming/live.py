"""The detector and ingest over Structured Streaming.

State per (stream, leg) is what the batch kernel keeps: at most M starts and a few scalars, so it doesn't grow
with the stream. It lives in RocksDB stores as typed values, a row a start, in the query's checkpoint, so a restarted
query goes on where the last finished batch ended. Micro-batches of any size give the batch result, since each
observation is one step. Late observations come out as rows of their own, and `detect_folder` writes them aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernel
from ..operators.wealth import LEG, MOST_STARTS
from ..sources import ingest

IN = "stream_id string, leg string, epoch long, t long, z double, null_lo double, null_hi double"
OUT = "stream_id string, leg string, t long, log_e double, peak_log_e double, alarm boolean, best_start long, direction string, late boolean"
HEAD = "epoch long, last long, t long, peak double"
START = ", ".join(f"{f} double" for f in kernel.FIELDS)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Detector(StatefulProcessor):
    """One leg's detector: a value of the epoch, the last t, the step and the peak, and a list of the live starts."""

    def __init__(self, alpha: float, most_starts: int):
        self.limit, self.most = float(np.log(1.0 / alpha)), most_starts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.starts = handle.getListState("starts", START)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        epoch, last, state = -1, -1, kernel.fresh()
        if self.head.exists():
            epoch, last, t, peak = self.head.get()
            held = np.array([tuple(r) for r in self.starts.get()], float).reshape(-1, len(kernel.FIELDS))
            state = dict(zip(kernel.FIELDS, held.T)) | {"t": t, "peak": peak}
        out = []
        for r in pd.concat(list(rows)).sort_values(["epoch", "t"]).itertuples():
            if r.epoch > epoch:
                epoch, last, state = int(r.epoch), -1, kernel.fresh()
            if r.epoch < epoch or r.t <= last:
                out.append((*key, r.t, None, None, None, None, None, True))
                continue
            state, log_e, best, rising = kernel.step(state, r.z, r.null_lo, r.null_hi, self.most)
            last = int(r.t)
            out.append((*key, r.t, log_e, state["peak"], state["peak"] >= self.limit, best, "up" if rising else "down", False))
        self.head.update((epoch, last, int(state["t"]), float(state["peak"])))
        self.starts.put([tuple(map(float, row)) for row in np.stack([state[f] for f in kernel.FIELDS], 1)])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"alarm": "object", "best_start": "Int64"})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own choice is back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def detect(legs: DataFrame, alpha: float, most_starts: int = MOST_STARTS) -> DataFrame:
    """legs: a streaming frame of the columns of IN. One row per observation. Start its query inside rocksdb().

    A higher epoch clears the state. An observation that isn't later than what its leg has seen is not
    taken in and comes out as late.
    """
    return legs.groupBy(*LEG).transformWithStateInPandas(Detector(alpha, most_starts), OUT, "append", "none")


def detect_folder(spark: SparkSession, folder: str, to: str, alpha: float, most_starts: int = MOST_STARTS, files_per_batch: int = 1000) -> None:
    """Takes in all files of the folder that no earlier call has, then stops: the trace to `to`/trace, late rows to `to`/late.

    Files are taken in the order they arrived in, so a leg's later observations belong in the same or a later file. The
    checkpoint is `to`/checkpoint. Batches are written under their number, so one that is repeated after a loss
    replaces itself and no row is doubled.
    """
    legs = spark.readStream.schema(IN).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("not late").drop("late").write.mode("overwrite").parquet(f"{to}/trace/batch={number}")
        late = batch.where("late").select(*LEG, "t")
        if late.take(1):
            late.write.mode("overwrite").parquet(f"{to}/late/batch={number}")
        batch.unpersist()

    with rocksdb(spark):
        query = detect(legs, alpha, most_starts).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_files(lines: DataFrame, lo: float, hi: float, accept: Callable[[DataFrame], None], refuse: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: sound runs go to accept(), the rows of runs with any issue to refuse().

    lines: stream_id, kind, run_index, item_id, score.
    """
    run = ["stream_id", "kind", "run_index"]

    def each(batch: DataFrame, _: int) -> None:
        rows = ingest.validate(batch, lo, hi, run).persist()
        bad = rows.where("issue is not null").select(*run).distinct()
        accept(rows.join(bad, run, "left_anti").select(*run, F.lit(0).alias("epoch"), "item_id", F.col("normalised").alias("score")))
        refuse(rows.join(bad, run, "left_semi"))
        rows.unpersist()

    return each
