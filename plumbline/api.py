"""The verbs: plan, baseline, observe, verdict, gate, replay, rebaseline, report, over one ledger.

A ledger is a folder that Spark reads and writes; all streams in it are decided in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report as rendering
from .config import Settings
from .functions import power, scores
from .operators import anchors, runs
from .plans import attribution, replay
from .sources import ingest, ledger

Scorer = Callable[[DataFrame, str], DataFrame]  # (items with item_id, nonce) -> item_id, score in [0, 1]


class Bench:
    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings()):
        self.spark, self.path, self.settings = spark, path, settings

    def lines(self) -> DataFrame:
        """All records; a damaged chain stops every verb."""
        lines = ledger.read(self.spark, self.path)
        if ledger.verify(lines).where("not (hash_ok and link_ok and seq_ok)").take(1):
            raise ValueError(f"the ledger at {self.path} is damaged")
        return lines

    def _epoch_and_next(self, lines: DataFrame | None, stream_id: str, kind: str) -> tuple[int, int]:
        """The current epoch and the next run_index, by the lines of a ledger (None: there is none yet)."""
        if lines is None:
            return 0, 0
        last = ledger.runs(lines, kind).where(F.col("stream_id") == stream_id).agg(F.max("run_index")).first()[0]
        return ledger.epoch(lines).first()["epoch"], 0 if last is None else last + 1

    def _record(self, rows: DataFrame, stream_id: str, kind: str, run_index: int, epoch: int, pin: dict) -> tuple[str, str]:
        """One run's record. Its observations are a single run's and go through the driver, as an append does."""
        seen = [{"item_id": r["item_id"], "score": r["score"], "raw": r["raw"]} for r in rows.select("item_id", "score", "raw").collect()]
        if len(seen) < self.settings.min_obs:
            raise ValueError(f"{len(seen)} scored items, {self.settings.min_obs} are needed")
        suite = rows.agg(scores.id_set_hash(F.collect_list("item_id")).alias("h")).first()["h"]
        run = {"stream_id": stream_id, "run_id": f"{stream_id}-{kind}-{epoch}-{run_index}", "run_index": run_index, "kind": kind, "epoch": epoch, "suite_hash": suite, "judge_pin": pin, "observations": seen}
        return "run", ledger.run_payload(run)

    def observe(self, path: str, stream_id: str, pin: dict, kind: str = "system", scorer: Scorer | None = None, control: DataFrame | None = None, **options) -> int:
        """Append one run from an export; at the cadence also re-score the control set under the same index."""
        rows = ingest.strict(ingest.load(self.spark, self.settings.adapter, path, *self.settings.scale, **options))
        index = 0

        def records(lines: DataFrame | None) -> ledger.Records:
            nonlocal index
            epoch, index = self._epoch_and_next(lines, stream_id, kind)
            new = [self._record(ingest.to_observations(rows, stream_id, kind, index, epoch), stream_id, kind, index, epoch, pin)]
            if scorer is not None and control is not None and index % self.settings.cadence == 0:
                scored = scorer(control, f"{stream_id}-{index}").withColumn("raw", F.col("score"))
                new.append(self._record(scored, stream_id, "anchor", index, epoch, pin))
            return new

        ledger.append(self.spark, self.path, records)
        return index

    def baseline(self, candidates: DataFrame, stream_id: str, pin: dict, scorer: Scorer) -> DataFrame:
        """Choose a control set (item_id, stratum), score it K times, record floor and runs; returns the chosen ids."""
        chosen = anchors.stratified_sample(candidates, self.settings.anchor_n, self.settings.seed).persist()
        k = self.settings.replicates
        scored = [scorer(chosen, f"baseline-{i}").withColumn("raw", F.col("score")).persist() for i in range(k)]
        every = scored[0].withColumn("replicate", F.lit(0))
        for i in range(1, k):
            every = every.unionByName(scored[i].withColumn("replicate", F.lit(i)))
        floor = anchors.noise_floor(every).first().asDict()
        if not floor["same_items"]:
            raise ValueError("the replicates scored different item sets")
        floor_record = ("baseline", ledger.canonical({"stream_id": stream_id, **{n: floor[n] for n in ("per_item_sd", "run_mean_sd", "replicates", "n_items")}}))

        def records(lines: DataFrame | None) -> ledger.Records:
            epoch, index = self._epoch_and_next(lines, stream_id, "anchor")
            return [floor_record, *(self._record(s, stream_id, "anchor", index + i, epoch, pin) for i, s in enumerate(scored))]

        ledger.append(self.spark, self.path, records)
        return chosen

    def rebaseline(self, reason: str) -> None:
        ledger.append(self.spark, self.path, [("rebaseline", ledger.rebaseline_payload(reason))])

    def floors(self, lines: DataFrame) -> DataFrame:
        """Each stream's latest noise floor."""
        read = lines.where("type = 'baseline'").select("seq", F.from_json("payload", "struct<stream_id:string,per_item_sd:double,run_mean_sd:double,replicates:int,n_items:bigint>").alias("b")).select("seq", "b.*")
        return anchors.latest_by_key(read, "stream_id", "seq").drop("seq")

    def _inputs(self, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        pins = ledger.runs(lines).select(*runs.STREAM, "run_index", "judge_pin")
        return ledger.observations(lines), self.floors(lines), pins

    def verdict(self, record: bool = True) -> DataFrame:
        lines = self.lines()
        obs, floors, pins = self._inputs(lines)
        out = attribution.decide(obs, floors, self.settings.plan(), pins).persist()
        if record:
            rows = out.where("not refused").select("stream_id", "at", "verdict", "rule_id").collect()
            ledger.append(self.spark, self.path, [("verdict", ledger.canonical({**r.asDict(), "alpha": self.settings.alpha, "target": self.settings.target})) for r in rows])
        return out

    def gate(self) -> DataFrame:
        """stream_id, verdict, exit_code: 0 passes, 1 fails, 2 warns, 3 could not be judged."""
        code = scores.exit_code(F.coalesce("verdict", F.lit("")), self.settings.fail_on, self.settings.warn_on, F.col("refused"))
        return self.verdict().select("stream_id", "verdict", "rule_id", code.alias("exit_code"))

    def replay(self) -> DataFrame:
        """Recorded verdicts that are not derived again, by the alpha and target that each was issued with."""
        lines = self.lines()
        obs, floors, pins = self._inputs(lines)
        recorded = ledger.verdicts(lines).drop("seq")
        return replay.divergences(recorded, attribution.by_settings(obs, floors, recorded, self.settings.plan(), pins), 1).drop("alpha", "target")

    def plan(self, stream_id: str) -> dict:
        f = self.floors(self.lines()).where(F.col("stream_id") == stream_id).first()
        if f is None:
            raise ValueError(f"stream {stream_id} has no baseline yet")
        s = self.settings
        return power.plan(power.Floor(f["per_item_sd"], f["run_mean_sd"], f["replicates"], f["n_items"]), s.target, s.alpha, s.horizon, s.min_obs)

    def report(self, markdown: bool = False) -> str:
        rows = [r.asDict() for r in self.verdict(record=False).collect()]
        return "\n\n".join((rendering.markdown if markdown else rendering.block)(r) for r in rows)
