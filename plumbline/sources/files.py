"""Other inputs: which framework wrote a folder, logs as rows, datasets checked against a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*.json*", most: int | None = None) -> DataFrame:
    """Paths and sizes under root that match; pruned folders are those that start with a dot. most: raises beyond so many."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    found = files.select("path", "length").where(~F.col("path").rlike(r"/\.[^/]+/"))
    if most is not None and len(found.limit(most + 1).collect()) > most:
        raise ValueError(f"more than {most} files under {root}")
    return found.orderBy("path")


def detect_framework(spark: SparkSession, root: str) -> str:
    """The first framework in a fixed order whose export is found; score lines if none is."""
    files = listing(spark, root, "*")
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.try_parse_json("value").alias("v"))
    probes = texts.agg(
        F.max(F.try_variant_get("v", "$.results.results", "array<variant>").isNotNull() | F.try_variant_get("v", "$.results[0].testCase", "variant").isNotNull()).alias("promptfoo"),
        F.max(F.try_variant_get("v", "$.samples", "array<variant>").isNotNull()).alias("inspect"),
        F.max(F.try_variant_get("v", "$.testCases", "array<variant>").isNotNull() | F.try_variant_get("v", "$.test_cases", "array<variant>").isNotNull()).alias("deepeval"),
    ).first()
    if probes["promptfoo"]:
        return "promptfoo"
    if probes["inspect"] or files.where("path like '%.eval'").take(1):
        return "inspect"
    return "deepeval" if probes["deepeval"] else "jsonl"


def looks_like_scores(spark: SparkSession, path: str) -> bool:
    """Whether the first lines are objects with an id and a score."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(5).select(F.try_parse_json("value").alias("v"))
    ok = F.coalesce(F.try_variant_get("v", "$.score", "double"), F.try_variant_get("v", "$.value", "double")).isNotNull()
    r = head.agg(F.count_if(ok).alias("good"), F.count(F.lit(1)).alias("n")).first()
    return 0 < r["n"] == r["good"]


def log_sections(lines: DataFrame, section: str, outcome: str, stretch: int = 100_000) -> DataFrame:
    """lines (seq, value) as rows: the section's name carried forward to each line that matches outcome (one group: its kind).

    Names are carried within stretches of the log, then from stretch to stretch, so no task reads the whole log.
    """
    name = F.nullif(F.regexp_extract("value", section, 1), F.lit(""))
    kind = F.nullif(F.regexp_extract("value", outcome, 1), F.lit(""))
    cut = lines.select("seq", F.floor(F.col("seq") / stretch).alias("stretch"), name.alias("name"), kind.alias("kind")).where("name is not null or kind is not null")
    within = Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy("stretch").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("end"))
    carried = ends.select("stretch", F.last("end", ignorenulls=True).over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    rows = cut.withColumn("own", F.last("name", ignorenulls=True).over(within)).join(carried, "stretch")
    return rows.where("kind is not null").select("seq", F.coalesce("own", "before").alias("config"), "kind")


def verified(data: DataFrame, manifest: DataFrame, text: str = "text") -> DataFrame:
    """data's rows that the manifest (item_id, sha256) names, in full: a missing or changed row raises."""
    both = manifest.join(data, "item_id", "left")
    same = F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("sha256")
    checked = F.when(F.col(text).isNull(), F.raise_error(F.concat(F.lit("missing row "), "item_id"))).when(~same, F.raise_error(F.concat(F.lit("changed row "), "item_id"))).otherwise(F.col(text))
    return both.withColumn(text, checked).drop("sha256")
