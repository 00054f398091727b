"""Temperature mixing of sources to target weights.

A source with share q of all tokens gets the weight q^a / sum(q^a). The exponent a in [0, 1] is found by
bisection: as flat as the repetition limit allows, or as steep as the target entropy asks. All candidate
exponents of one round are judged in one aggregation over the source table (a multi-way bisection), so the
number of sources is not bounded by the driver. Weights are then realised within a token budget: a source
gets whole epochs while they fit, then a last, partial epoch. Rows are dealt to blocks of about
`block_rows` by hash; each epoch takes the blocks in a seeded permutation of its own and stops where the
next row would pass the source's tokens. A running sum goes over block totals first, then over the rows of
each block, so no source is gathered row by row in one task.

The default budget is the least that takes every row of every source at least once: nothing is dropped,
and small sources repeat. Nulls: a null source is a source of its own; a null text has no tokens. Rows
that repeat doc_id, source and text move together, with their number in n_rows. A source without tokens
is taken once. A very long text is a row with many tokens, taken whole or not at all; equal hashes are ordered by
block number or row_key. An empty table gives no rows. Other columns pass `mix_rows` unchanged, names of working
columns included.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize

GRID = 33
ROUNDS = 6


def _profile(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """Of each exponent: the weights' entropy, the most repeats of any source, the budget that takes every row once, as a share of all tokens."""
    rows = sources.where("tokens > 0").select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("w", F.pow("share", F.col("a")))
    per_share = F.col("w") / F.col("share")
    got = rows.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("w")).alias("wl"), F.max(per_share).alias("up"), F.min(per_share).alias("down")).collect()
    return {r["a"]: (math.log(r["z"]) - r["wl"] / r["z"], r["up"] / r["down"], r["z"] / r["down"]) for r in got}


def fit_exponent(sources: DataFrame, max_repeats: float | None = 4.0, entropy_share: float | None = None) -> tuple[float, float]:
    """The exponent and the full budget's share of all tokens. The repetition limit wins over the entropy."""
    count = sources.where("tokens > 0").count()
    if not count:
        return 1.0, 1.0

    def search(low_ok) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / (GRID - 1) for i in range(GRID)]
            seen = _profile(sources, grid)
            fine = [low_ok(seen[a]) for a in grid]
            at = next((i for i, ok in enumerate(fine) if ok), GRID - 1)
            if at == 0:
                return lo
            lo, hi = grid[at - 1], grid[at]
        return hi

    a = 0.0
    if entropy_share is not None:  # the steepest exponent that still has the entropy
        a = search(lambda p: p[0] <= entropy_share * math.log(count) + 1e-12)
    if max_repeats is not None:
        a = max(a, search(lambda p: p[1] <= max_repeats + 1e-9))
    return a, _profile(sources, [a])[a][2]


def temperature_mix(docs: DataFrame, max_repeats: float | None = 4.0, entropy_share: float | None = None, budget_share: float | None = None, block_rows: int = 1024, seed: int = 17) -> DataFrame:
    """row_key, doc_id, source, n_tokens, n_rows, epoch, block, mix_point of every taken row.

    budget_share: tokens to take as a share of all there are; None takes every row at least once.
    mix_point in [0, 1): where in its source's tokens the row's block begins; sorting by it interleaves the
    sources so that every stretch of the mix has about the target weights.
    """
    spark = docs.sparkSession
    n_tokens = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")
    each = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("row_key"), n_tokens.alias("n_tokens"))
    tokens = materialize(each.groupBy("row_key", "doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-tokens")
    sums = materialize(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_keys")), "mix-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sums = sums.withColumn("share", F.when(F.col("tokens") > 0, F.col("tokens") / F.lit(float(max(total, 1)))))
    a, full = fit_exponent(sums, max_repeats, entropy_share)
    z = sums.where("tokens > 0").agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    budget = (full if budget_share is None else budget_share) * total
    target = F.when(F.col("tokens") > 0, F.round(F.pow("share", F.lit(a)) / z * budget)).otherwise(0)
    plan = sums.withColumn("target", target.cast("long"))
    plan = plan.select(
        F.col("source").alias("s"),
        "tokens",
        "target",
        F.greatest(F.lit(1), F.ceil(F.col("n_keys") / block_rows)).alias("n_blocks"),
        F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(1).cast("int").alias("epochs"),
    ).withColumn("rest", F.when(F.col("tokens") > 0, F.col("target") - F.col("epochs") * F.col("tokens")).otherwise(0))
    dealt = tokens.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("n_blocks")))
    # each source's blocks of every epoch, in that epoch's permutation, with the tokens before them
    by_block = ["s", "block"]
    totals = dealt.groupBy("s", "block", "epochs", "rest", "target", "tokens").agg(F.sum("n_tokens").alias("in_block"))
    ordered = totals.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    turn = Window.partitionBy("s", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    ordered = ordered.withColumn("before", F.coalesce(F.sum("in_block").over(turn), F.lit(0)))
    ordered = ordered.where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest")))
    ordered = ordered.select(F.col("s").alias("s2"), F.col("block").alias("b2"), "epoch", "before", (F.col("epoch") == F.col("epochs")).alias("partial"))
    within = Window.partitionBy(*by_block, "epoch").orderBy(F.xxhash64("row_key", "epoch", F.lit(seed)), "row_key").rowsBetween(Window.unboundedPreceding, 0)
    taken = dealt.join(ordered, F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))).withColumn("through", F.col("before") + F.sum("n_tokens").over(within))
    taken = taken.where(~F.col("partial") | (F.col("through") <= F.col("rest")))
    point = F.when(F.col("target") > 0, (F.col("epoch") * F.col("tokens") + F.col("before")) / F.col("target")).otherwise(0.0)
    return taken.select("row_key", "doc_id", "source", "n_tokens", "n_rows", "epoch", F.col("block").cast("long").alias("block"), F.round(point, 9).alias("mix_point"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, in its own columns."""
    taken = temperature_mix(docs, **options)
    copies = taken.groupBy(F.col("row_key").alias("key"), F.col("source").alias("of")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("source").alias("of"), F.struct(*columns(docs)).alias("row"))
    joined = keyed.alias("d").join(copies.alias("c"), (F.col("d.key") == F.col("c.key")) & F.col("d.of").eqNullSafe(F.col("c.of")))
    return joined.select(F.explode(F.array_repeat("d.row", F.col("c.times"))).alias("row")).select("row.*")
