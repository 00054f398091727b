"""Scored items from JSON lines and three framework exports, checked row by row.

Nothing is coerced or clamped: every row gets all issues that hold for it, and the first of them as its issue;
`strict` raises when any row has one. Score lines carry their numbers, counted exactly however files are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import grade, normalise
from . import archives

# Accepted names of fields.
ITEM_NAMES = ["item_id", "id", "test_id", "case_id"]
SCORE_NAMES = ["score", "value"]
CASE_KEYS = ["testCases", "test_cases", "testResults", "test_results", "results"]
METRIC_KEYS = ["metricsData", "metrics_data", "metricsMetadata", "metrics"]
CASE_NAMES = ["name", "id", "input"]
TEST_NAMES = ["id", "description", "name", "item_id"]


def validate(rows: DataFrame, lo: float, hi: float, keys: list[str] | None = None) -> DataFrame:
    """rows (item_id, score, and optionally issue and line) with issues, all that is wrong in the order of the checks, and issue, the first.

    With line, the first sound row of an item stays, and the later ones are its duplicates, with its line as first_line;
    without, all rows that share an id are.
    """
    keys = keys or []
    before = F.col("issue") if "issue" in rows.columns else F.lit(None).cast("string")
    nameless = F.col("item_id").isNull() | (F.trim("item_id") == "")
    x = F.col("score")
    score = F.when(x.isNull(), "no numeric score").when(F.isnan(x) | (F.abs(x) == float("inf")), "score is not finite").when(~x.between(lo, hi), "score out of range")
    if "line" in rows.columns:
        sound = rows.where(before.isNull() & ~nameless & score.isNull())
        known = sound.groupBy(*keys, "item_id").agg(F.min("line").alias("first_line"))
        rows = rows.join(known, [*keys, "item_id"], "left")
        again = F.col("line") > F.col("first_line")
        rows = rows.withColumn("first_line", F.when(again, F.col("first_line")))
        again = F.col("first_line").isNotNull()
    else:
        again = F.count(F.lit(1)).over(Window.partitionBy(*keys, "item_id")) > 1
    read = before.isNull()
    found = [before, F.when(read & nameless, "no item id"), F.when(read & again & ~nameless, "duplicate item id"), F.when(read, score)]
    rows = rows.withColumn("issues", F.array_compact(F.array(*found)))
    return rows.withColumn("issue", F.try_element_at("issues", F.lit(1))).withColumn("normalised", F.when(F.col("issue").isNull(), normalise(x, lo, hi)))


def strict(rows: DataFrame, quoted: int = 20) -> DataFrame:
    """Only sound tables pass: one error names the kinds of issues with their numbers and quotes the first rows."""
    bad = rows.where("issue is not null")
    kinds = sorted((r["issue"], r["count"]) for r in bad.groupBy("issue").count().collect())  # a row a kind
    if kinds:
        order = [c for c in ("source", "line") if c in rows.columns] or ["item_id"]
        first = bad.orderBy(*order).limit(quoted).collect()
        total = sum(n for _, n in kinds)

        def told(r) -> str:
            line = f"line {r['line']}: " if "line" in order else ""
            back = f" (first on line {r['first_line']})" if "line" in order and r["first_line"] else ""
            return f"{line}{r['item_id']}: {', '.join(r['issues'])}{back}"

        more = f"; and {total - len(first)} more" if total > len(first) else ""
        raise ValueError(f"{', '.join(f'{k} {n}' for k, n in kinds)}: {'; '.join(map(told, first))}{more}")
    if not rows.take(1):
        raise ValueError("no scored items")
    return rows


def checked_path(spark: SparkSession, path: str) -> str:
    """The path, if there is something to read: missing paths and folders without files have their own errors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        raise ValueError(f"{path}: file not found")
    if len(found) == 1 and found[0].isDirectory() and not found[0].getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(found[0].getPath(), True).hasNext():
        raise ValueError(f"{path}: a directory without files, not a score file")
    return path


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line (from 1), value of all lines, blank ones included.

    Files are read in blocks by many tasks. One pass counts the lines of each block; a block's lines begin after those
    of the blocks before it in its file. A row a block is all that is shuffled.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    blocks = lines.groupBy("source", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return lines.join(blocks, ["source", "block"]).select("source", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), "value")


def _number(text: Column) -> Column:
    """A JSON number or boolean as a double; strings, null and anything else are null."""
    return F.when(text.isin("true", "false"), (text == "true").cast("double")).when(text.rlike(r"^-?[0-9]"), text.try_cast("double"))


def json_lines(spark: SparkSession, path: str, lo: float, hi: float) -> DataFrame:
    """source, line, item_id, score, issues of every line that is neither blank nor a // comment."""
    lines = numbered_lines(spark, path).where("trim(value) <> '' and not startswith(ltrim(value), '//')")
    v = F.try_parse_json("value")
    raw = {n: F.try_variant_get(v, f"$.{n}", "string") for n in ITEM_NAMES}
    typed = {n: F.to_json(F.try_variant_get(v, f"$.{n}", "variant")) for n in SCORE_NAMES}
    several = lambda cols: F.size(F.array_distinct(F.array_compact(F.array(*cols)))) > 1
    issue = (
        F.when(~F.is_valid_utf8("value"), "not UTF-8 text")
        .when(v.isNull(), "not JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(several(raw.values()) | several(typed.values()), "two names with different values")
    )
    rows = lines.select("source", "line", F.coalesce(*raw.values()).alias("item_id"), _number(F.coalesce(*typed.values())).alias("score"), issue.alias("issue"))
    return validate(rows, lo, hi, ["source"])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.try_parse_json("value").alias("v"))


def _elements(df: DataFrame, paths: list[str], *kept: str) -> DataFrame:
    """One row per element of the first path that is an array."""
    arrays = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in paths))
    return df.select("source", *kept, F.posexplode_outer(arrays).alias("pos", "e"))


def _text(path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get("e", path, "string")), F.lit(""))


def _json(path: str) -> Column:
    return F.to_json(F.try_variant_get("e", path, "variant"))


def promptfoo(spark: SparkSession, path: str, lo: float, hi: float) -> DataFrame:
    """Nested results, flat results, or a bare array. Several named scores without an overall one are refused."""
    rows = _elements(_documents(spark, path), ["$.results.results", "$.results", "$"])
    named = F.map_values(F.try_variant_get("e", "$.namedScores", "map<string,double>"))
    plain = lambda p: F.when(_json(p).rlike(r"^-?[0-9]"), _json(p).try_cast("double"))
    score = F.coalesce(plain("$.score"), plain("$.gradingResult.score"), F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1))), F.when(F.coalesce(F.size(named), F.lit(0)) <= 1, _number(_json("$.success"))))
    ids = [_text(f"{p}.{n}") for p in ("$.testCase", "$.testCase.vars", "$") for n in TEST_NAMES]
    item = F.coalesce(*ids, F.concat(F.lit("test-"), F.col("pos").cast("string")))
    issue = F.when(F.col("e").isNull(), "no results found").when(score.isNull() & (F.size(named) > 1), "several named scores and no overall one")
    return validate(rows.select("source", item.alias("item_id"), score.alias("score"), issue.alias("issue")), lo, hi, ["source"])


def deepeval(spark: SparkSession, path: str, lo: float, hi: float, metric: str | None = None) -> DataFrame:
    rows = _elements(_documents(spark, path), [*(f"$.{k}" for k in CASE_KEYS), "$"])
    metrics = F.coalesce(*(F.when(F.size(m) > 0, m) for m in (F.try_variant_get("e", f"$.{k}", "array<struct<name:string,score:double>>") for k in METRIC_KEYS)))
    chosen = metrics if metric is None else F.filter(metrics, lambda m: m["name"] == metric)
    score = F.when(F.size(chosen) == 1, F.try_element_at(chosen, F.lit(1))["score"]).when(metrics.isNull(), F.coalesce(_number(_json("$.score")), _number(_json("$.success"))))
    item = F.coalesce(*(_text(f"$.{n}") for n in CASE_NAMES), F.concat(F.lit("case-"), F.col("pos").cast("string")))
    issue = F.when(F.col("e").isNull(), "no cases found").when(F.size(chosen) > 1, "several metrics and none named").when(F.size(chosen) == 0, "no metric of that name")
    return validate(rows.select("source", item.alias("item_id"), score.alias("score"), issue.alias("issue")), lo, hi, ["source"])


def merged_logs(rows: DataFrame) -> DataFrame:
    """source, v (null where a member is broken), broken: the logs of archives' members (source, member, value).

    Later members' fields replace earlier ones' by name, so of all members only the last that has samples is kept.
    """
    v = F.try_parse_json("value")
    has = F.try_variant_get(v, "$.samples", "variant").isNotNull()
    last = F.max_by(F.when(has, F.col("value")), F.when(has, F.coalesce("member", F.lit(""))))
    logs = rows.groupBy("source").agg(last.alias("value"), F.coalesce(F.bool_or(v.isNull()), F.lit(False)).alias("broken"))
    return logs.select("source", F.when(~F.col("broken"), F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}")))).alias("v"), "broken")


def inspect_log(spark: SparkSession, path: str, lo: float, hi: float, scorer: str | None = None) -> DataFrame:
    """JSON logs, or zip archives of JSON members that are merged in name order; a task reads members, not archives.

    A log with a member that is not JSON gives one row, with that issue.
    """
    logs = merged_logs(archives.read(spark, path))
    rows = _elements(logs, ["$.samples"], "broken")
    given = F.try_variant_get("e", "$.scores", "map<string,variant>")
    one = F.try_element_at(given, F.lit(scorer)) if scorer else F.when(F.size(given) == 1, F.try_element_at(F.map_values(given), F.lit(1)))
    value = F.coalesce(F.to_json(F.try_variant_get(one, "$.value", "variant")), F.to_json(one))
    text = F.regexp_replace(value, '^"|"$', "")
    score = F.when(value.startswith('"'), F.when(F.upper(F.trim(text)).isin("C", "I", "P", "N"), grade(text))).otherwise(_number(value))
    issue = F.when(F.col("broken"), "a member is not JSON").when(F.col("e").isNull(), "no samples found").when(F.coalesce(F.size(given), F.lit(0)) == 0, "a sample without scores").when(one.isNull(), "several scorers and none named" if scorer is None else "no scorer of that name")
    item = F.coalesce(_text("$.id"), F.col("pos").cast("string"))
    return validate(rows.select("source", item.alias("item_id"), score.alias("score"), issue.alias("issue")), lo, hi, ["source"])


READERS = {"jsonl": json_lines, "promptfoo": promptfoo, "deepeval": deepeval, "inspect": inspect_log}


def load(spark: SparkSession, adapter: str, path: str, lo: float, hi: float, **options) -> DataFrame:
    if adapter not in READERS:
        raise ValueError(f"unknown adapter {adapter}; one of {', '.join(READERS)}")
    return READERS[adapter](spark, checked_path(spark, path), lo, hi, **options)


def to_observations(rows: DataFrame, stream_id: str, kind: str, run_index: int, epoch: int = 0) -> DataFrame:
    return rows.select(F.lit(stream_id).alias("stream_id"), F.lit(kind).alias("kind"), F.lit(epoch).alias("epoch"), F.lit(run_index).cast("long").alias("run_index"), "item_id", F.col("normalised").alias("score"), F.col("score").alias("raw"))
