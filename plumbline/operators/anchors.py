"""Control sets: noise floors from repeated scorings, stratified selection, coverage, freezing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import MIN_SD, decile, stratum


def noise_floor(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Within-scorer variability from K scorings of the same items. scores: keys, replicate, item_id, score.

    same_items says whether all replicates scored one item set; a floor of unlike sets means nothing.
    """
    keys = keys or []
    by_item = scores.groupBy(*keys, "item_id").agg(F.var_samp("score").alias("v"), F.count(F.lit(1)).alias("k"), (F.max("score") > F.min("score")).alias("moved"))
    by_run = scores.groupBy(*keys, "replicate").agg(F.avg("score").alias("m"))
    a = by_item.groupBy(*keys).agg(F.sqrt(F.avg("v")).alias("sd"), F.count(F.lit(1)).alias("n_items"), F.min("k").alias("least"), F.count_if("moved").alias("unstable_items"))
    b = by_run.groupBy(*keys).agg(F.stddev_samp("m").alias("run_sd"), F.count(F.lit(1)).alias("replicates"), (F.max("m") - F.min("m")).alias("run_mean_range"))
    both = a.join(b, keys) if keys else a.crossJoin(b)
    return both.select(
        *keys,
        F.greatest("sd", F.lit(MIN_SD)).alias("per_item_sd"),
        F.greatest("run_sd", F.lit(MIN_SD)).alias("run_mean_sd"),
        "replicates",
        "n_items",
        "unstable_items",
        "run_mean_range",
        (F.col("run_sd") <= 0).alias("degenerate"),
        (F.col("least") == F.col("replicates")).alias("same_items"),
        (F.greatest("run_sd", F.lit(MIN_SD)) * F.sqrt("n_items") / F.greatest("sd", F.lit(MIN_SD))).alias("independence_ratio"),
    )


def pairwise_agreement(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and largest absolute difference and the share of equal scores over all pairs of replicates of an item.

    No pair is made: with the scores of an item in order, each stands above those before it and below those after it, so
    the differences add up by ranks, and equal scores by their counts. Work is K log K for K replicates, and scores
    that repeat are counted before they are shuffled.
    """
    keys = keys or []
    item = [*keys, "item_id"]
    values = scores.where("score is not null").groupBy(*item, "score").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*item)
    below = F.coalesce(F.sum("c").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.select(*item, "score", "c", below.alias("below"), F.sum("c").over(w).alias("k")).where("k > 1")
    c, k = F.col("c"), F.col("k")
    apart = F.sum(c * F.col("score") * (2 * F.col("below") + c - k))
    each = ranked.groupBy(*item).agg(apart.alias("apart"), (F.max("score") - F.min("score")).alias("span"), F.sum(c * (c - 1) / 2).alias("equal"), F.first(k * (k - 1) / 2).alias("pairs"))
    pairs = F.sum("pairs")
    return each.groupBy(*keys).agg((F.sum("apart") / pairs).alias("mean_abs_diff"), F.max("span").alias("max_diff"), (F.sum("equal") / pairs).alias("agreement"), F.coalesce(pairs.cast("long"), F.lit(0)).alias("comparisons"))


def candidates(items: DataFrame, score: Column, tags: Column) -> DataFrame:
    return items.withColumn("score", score).withColumn("tags", tags).withColumn("stratum", stratum(score, tags))


BINS = 4096


def stratified_sample(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n items with proportional quotas, at least one of every stratum while there is room.

    items: item_id, stratum. The order inside a stratum is the hash of seed and id, so no stratum is sorted whole: a
    histogram of the hashes' first digits says in which bins a stratum's quota ends, rows of later bins go, and a rank
    is the rows in earlier bins and the place in its own. What trimming or filling touches is at most a row a stratum.
    """
    sizes = items.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy()  # a row a stratum
    quota = F.greatest(F.floor(F.col("size") * n / F.sum("size").over(every)), (F.lit(n) >= F.count(F.lit(1)).over(every)).cast("long"))
    sizes = sizes.withColumn("quota", F.least("size", quota).cast("long"))
    total, wanted = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.sum("quota")).first()
    if not 1 <= n <= total:
        raise ValueError(f"asked for {n} of {total} items")
    spare = max(n - wanted, 0)
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id")), 256)
    digits = F.coalesce(F.conv(F.substring("turn", 1, 3), 16, 10).cast("int"), F.lit(0))
    rows = items.select("item_id", "stratum", turn.alias("turn")).withColumn("bin", digits)
    earlier = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    bins = bins.join(sizes, "stratum").where(F.col("before") < F.col("quota") + spare).select("stratum", "bin", "before", "quota")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("stratum", "bin").orderBy("turn"))
    ranked = rows.join(bins, ["stratum", "bin"]).withColumn("rank", rank)
    chosen = ranked.where(F.col("rank") <= F.col("quota"))
    if wanted > n:  # members of the smallest strata stay
        last = chosen.orderBy(F.col("quota").desc(), F.col("rank").desc(), F.col("turn").desc()).limit(wanted - n)
        chosen = chosen.join(last.select("stratum", "rank"), ["stratum", "rank"], "left_anti")
    elif spare:
        chosen = chosen.unionByName(ranked.where(F.col("rank") > F.col("quota")).orderBy("turn").limit(spare))
    return chosen.select("item_id", "stratum")


def random_sample(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return items.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("item_id")), 256)).limit(n)


def coverage(suite: DataFrame, chosen: DataFrame) -> DataFrame:
    """How well chosen ids cover the suite's deciles and tags: shares covered, what is missing, the largest gap of shares.

    suite: item_id, score, tags. One pass over the suite, marked by a left join; then one row per decile or tag.
    """
    marked = suite.join(chosen.select("item_id").distinct().withColumn("in", F.lit(True)), "item_id", "left").withColumn("in", F.coalesce("in", F.lit(False)))
    values = F.array_union(F.array(F.concat(F.lit("d"), decile(F.col("score")).cast("string"))), F.transform(F.array_distinct("tags"), lambda t: F.concat(F.lit("t"), t)))
    each = marked.select("in", F.explode(values).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("a"), F.count_if("in").alias("b"))
    sizes = marked.agg(F.count(F.lit(1)).alias("suite_n"), F.count_if("in").alias("anchor_n"))
    is_decile = F.col("v").startswith("d")
    rows = each.crossJoin(F.broadcast(sizes)).withColumn("gap", F.abs(F.col("a") / F.col("suite_n") - F.col("b") / F.col("anchor_n")))
    name = F.substring("v", 2, 1 << 20)
    return rows.agg(
        F.avg(F.when(is_decile, (F.col("b") > 0).cast("double"))).alias("decile_coverage"),
        F.coalesce(F.avg(F.when(~is_decile, (F.col("b") > 0).cast("double"))), F.lit(1.0)).alias("tag_coverage"),
        F.array_sort(F.collect_list(F.when(is_decile & (F.col("b") == 0), name))).alias("missing_deciles"),
        F.array_sort(F.collect_list(F.when(~is_decile & (F.col("b") == 0), name))).alias("missing_tags"),
        F.max("gap").alias("max_marginal_gap"),
        F.first("anchor_n").alias("anchor_n"),
        F.first("suite_n").alias("suite_n"),
    )


def gold_agreement(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean absolute error of scores against gold labels where there are any, and their number."""
    both = scores.join(gold.where("gold is not null"), "item_id")
    return both.agg(F.avg(F.abs(F.col("score") - F.col("gold"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def freeze(scored: DataFrame) -> DataFrame:
    """item_id, base: the frozen baseline of K scorings."""
    return scored.groupBy("item_id").agg(F.avg("score").alias("base"))


def fill_from_cache(items: DataFrame, cache: DataFrame, score) -> DataFrame:
    """Cached scores where there are any; score() is asked for the rest only."""
    hits = items.join(cache, "item_id")
    misses = score(items.join(cache, "item_id", "left_anti"))
    return hits.unionByName(misses)


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of the rows with one key, the latest."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("r")).select(key, "r.*")


COVERED = 0.8
GAP = 0.15


def coverage_warnings(found: DataFrame) -> DataFrame:
    """coverage()'s row with adequate, and warnings: what the control set would not see."""
    adequate = (F.least("decile_coverage", "tag_coverage") >= COVERED) & (F.size("missing_tags") == 0)
    texts = [
        F.when(F.size("missing_tags") > 0, F.concat(F.lit("no control items tagged "), F.array_join("missing_tags", ", "))),
        F.when(F.size("missing_deciles") > 0, F.concat(F.lit("no control items in score deciles "), F.array_join("missing_deciles", ", "))),
        F.when(F.col("max_marginal_gap") > GAP, F.lit("the control set is made up unlike the suite")),
    ]
    return found.withColumn("adequate", adequate).withColumn("warnings", F.array_compact(F.array(*texts)))


def floor_warnings(floors: DataFrame) -> DataFrame:
    """noise_floor()'s rows with warnings: floors that say little about the scorer's noise."""
    texts = [
        F.when(F.col("degenerate"), F.lit("all replicates scored alike, any movement will read as drift")),
        F.when(F.col("replicates") < 3, F.lit("fewer than 3 replicates bound the floor loosely")),
    ]
    return floors.withColumn("warnings", F.array_compact(F.array(*texts)))


def first_items(items: DataFrame, n: int) -> DataFrame:
    """The first n items by id."""
    return items.orderBy("item_id").limit(n)


def head_per_stratum(items: DataFrame, n: int) -> DataFrame:
    """n items: the first n // strata of each stratum by id, and the rest from what the largest strata still have.

    items: item_id, stratum. Tasks keep no more of a stratum than could be chosen before it is shuffled (the rank is
    compared with a number known beforehand). Only what the top-up may touch gets an order over all strata.
    """
    sizes = items.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    quotas = sizes.withColumn("quota", F.floor(F.lit(n) / F.count(F.lit(1)).over(Window.partitionBy())))  # a row a stratum
    quota, have = quotas.agg(F.coalesce(F.max("quota"), F.lit(0)), F.coalesce(F.sum(F.least("size", "quota")), F.lit(0))).first()
    missing = max(n - have, 0)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("item_id"))
    ranked = items.select("item_id", "stratum", rank.alias("rank")).where(F.col("rank") <= quota + missing)
    chosen = ranked.where(F.col("rank") <= quota).select("item_id", "stratum")
    rest = ranked.where(F.col("rank") > quota).join(sizes, "stratum").orderBy(F.col("size").desc(), "stratum", "rank").limit(missing)
    return chosen.unionByName(rest.select("item_id", "stratum"))


def clipped(text: Column, most: int) -> Column:
    """A text's first characters, as prompts carry them."""
    return F.substring(text, 1, most)
