"""Recorded verdicts against those derived again from the record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def divergences(recorded: DataFrame, derived: DataFrame, semantics_version: int) -> DataFrame:
    """recorded: stream_id, at, verdict, rule_id, semantics_version; derived: stream_id, at, verdict, rule_id.

    Both may have alpha and target, which then tell verdicts on one run apart.

    A row per recorded verdict that is not derived again: a changed meaning of the rules (the record is of
    another semantics version) or a regression; a verdict that can't be derived at all is missing.
    """
    key = ["stream_id", "at", *(c for c in ("alpha", "target") if c in recorded.columns and c in derived.columns)]
    now = derived.select(*key, F.col("verdict").alias("verdict_now"), F.col("rule_id").alias("rule_now"))
    both = recorded.join(now, key, "left")
    same = F.col("verdict").eqNullSafe(F.col("verdict_now")) & F.col("rule_id").eqNullSafe(F.col("rule_now"))
    kind = F.when(F.col("rule_now").isNull(), "missing").when(F.col("semantics_version") != semantics_version, "semantics").otherwise("regression")
    return both.where(~same).select(*key, "verdict", "rule_id", "verdict_now", "rule_now", kind.alias("kind"))
