"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only.

Fixed patterns give the base spans (assign, access, hex); long tokens that mix upper case, lower case and
digits are further candidates. Each candidate's value is hashed, and the hashes are aggregated over the
corpus by distinct repositories (here: doc_id) and by distinct owners (here: source), each of them once, whatever
else it occurs with. A value seen with at least `example_owners`
owners or in at least `example_repos` repositories is a widely copied example; others look live.

The verdict becomes spans of its own over the values: `live` for each value that looks live, `example` for the
others where a base span holds them. Further candidates that are widely copied are no secrets and get none. Base
spans stay in any case, and a value that two patterns found has one verdict span.

Nulls: a null text is empty; a null owner or repository counts as one of its own. Repeated rows are scanned
one by one and do not raise the distinct counts. Very long texts are scanned whole. Counts that equal a threshold
reach it. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .pii import counts
from .spans import ITEM, SPAN, apart, find, joined, ordered, span

# The kinds, in this order.
KINDS = ["assign", "access", "hex"]
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+_=-]{20,}+(?![/])"


def base_spans(text: Column) -> Column:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6
    return ordered(find(text, ASSIGN, "assign", 0, value), find(text, ACCESS, "access", 1, cheap=F.contains(text, F.lit("AKIA"))), find(text, HEX, "hex", 2))


def mixed(m: Column) -> Column:
    return m.rlike("[A-Z]") & m.rlike("[a-z]") & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 3)


def secret_spans(docs: DataFrame, owner: str = "source", repo: str = "doc_id", example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """doc_id, base, more (the verdicts' spans) of every row."""
    text = text_or_empty()
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(owner).alias("owner"), F.col(repo).alias("repo"), base_spans(text).alias("base"), find(text, LONG, "token", len(KINDS), mixed).alias("long"))
    scanned = materialize(found.withColumn("long", apart(F.col("long"), F.col("base"), ITEM)), "secret-scan")
    each = scanned.select("rid", "owner", "repo", F.explode(F.concat("base", "long")).alias("x"))
    value = F.when(F.col("x.kind") == "assign", F.regexp_extract("x.value", ASSIGN, 1)).otherwise(F.col("x.value"))
    each = each.withColumn("value", value).select("rid", "owner", "repo", (F.col("x.e") - F.length("value")).alias("s"), F.col("x.e").alias("e"), (F.col("x.kind") != "token").alias("sure"), F.sha2("value", 256).alias("hash"))
    # each pair once (a value that is copied everywhere is one row per partition and pair), then counts by hash
    owners = each.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    repos = each.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("repos"))
    spread = owners.join(repos, "hash")
    copied = spread.where((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)).select("hash", F.lit(True).alias("copied"))
    judged = each.join(copied, "hash", "left").where("copied is null or sure")
    place = F.when(F.col("copied"), len(KINDS) + 1).otherwise(len(KINDS))
    verdict = span(F.col("s"), place, F.col("e"), F.when(F.col("copied"), "example").otherwise("live"), F.col("hash"))
    by_row = judged.groupBy("rid").agg(F.array_sort(F.collect_set(verdict)).alias("more"))
    return scanned.select("rid", "doc_id", "base").join(by_row, "rid", "left").select("doc_id", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def report(docs: DataFrame) -> DataFrame:
    base = F.col("base")
    return secret_spans(docs).select("doc_id", *counts(base, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(ordered(base, F.col("more"))).alias("spans"), *counts(F.col("more"), ["live", "example"]))
