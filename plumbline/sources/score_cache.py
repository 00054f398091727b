"""Scores that outlive a run: a table bucketed by key that is updated bucket by bucket.

Data lies in folders that are never changed; a manifest names the folder of every bucket. An upsert writes the touched
buckets anew, and the next manifest, put only if no other writer has put it, makes them current at once: a writer that
comes second merges into what it finds then. Readers of an earlier manifest keep seeing its folders until vacuum().
Only the buckets that a lookup's keys fall into are read. A manifest has an entry a bucket, whatever the data's size.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import put_if_absent
from .shared import written

ROWS = "key string, score double, at long"


class ScoreCache:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        """Opens the cache at path; buckets counts only for a new one."""
        self.spark, self.path = spark, path
        put_if_absent(spark, path, self._name(0), json.dumps({"buckets": buckets, "folders": {}}))
        self.buckets = self._manifest()[1]["buckets"]

    @staticmethod
    def _name(version: int) -> str:
        return f"manifest-{version:020d}.json"

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self) -> tuple[int, dict]:
        fs, at = self._folder()
        names = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("manifest-")]
        last = max(names)
        text = "".join(r["value"] for r in self.spark.read.text(f"{self.path}/{last}").collect())
        return int(last.split("-")[1].split(".")[0]), json.loads(text)

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket(F.col("key")).alias("b")).where("b is not null").distinct().collect()]

    def _read(self, folders: dict[str, str], touched: list[int]) -> DataFrame:
        paths = [f"{self.path}/{folders[str(b)]}" for b in sorted(touched) if str(b) in folders]
        return self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)

    def rows(self) -> DataFrame:
        """key, score, at of everything."""
        return self._read(self._manifest()[1]["folders"], list(range(self.buckets)))

    def lookup(self, items: DataFrame) -> DataFrame:
        """items (key, ...) with score, null where the cache has none."""
        have = self._read(self._manifest()[1]["folders"], self._touched(items))
        return items.join(have.select("key", "score"), "key", "left")

    def upsert(self, rows: DataFrame, attempts: int = 20) -> None:
        """rows: key, score, at. Of rows with one key the latest stays, and of equally late ones the higher score."""
        rows = written(rows.select("key", F.col("score").cast("double").alias("score"), F.col("at").cast("long").alias("at")).where("key is not null"), "cache-rows")
        touched = self._touched(rows)
        if not touched:
            return
        for _ in range(attempts):
            version, manifest = self._manifest()
            merged = self._read(manifest["folders"], touched).unionByName(rows).groupBy("key").agg(F.max(F.struct("at", "score")).alias("r"))
            folder = f"data-{uuid.uuid4().hex}"
            merged = merged.select("key", "r.score", "r.at", self._bucket(F.col("key")).alias("bucket"))
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            folders = manifest["folders"] | {str(b): f"{folder}/bucket={b}" for b in touched}
            if put_if_absent(self.spark, self.path, self._name(version + 1), json.dumps(manifest | {"folders": folders})):
                return
        raise TimeoutError(f"{attempts} attempts to update {self.path} were overtaken by other writers")

    def fill(self, items: DataFrame, score: Callable[[DataFrame], DataFrame], at: int) -> DataFrame:
        """items (key, ...) with score; score() is asked once for each key that is missing, and its answers are kept."""
        found = written(self.lookup(items), "cache-found")
        missing = found.where("score is null").drop("score").dropDuplicates(["key"])
        self.upsert(score(missing).select("key", "score").where("score is not null").withColumn("at", F.lit(at)))
        return self.lookup(items)

    def vacuum(self) -> int:
        """Deletes folders that the current manifest doesn't name, and earlier manifests; how many went."""
        version, manifest = self._manifest()
        fs, at = self._folder()
        kept = {f.split("/")[0] for f in manifest["folders"].values()} | {self._name(version)}
        gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in kept]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
