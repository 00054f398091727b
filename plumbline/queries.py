"""Registered queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import power, scores, student
from .functions.power import Floor
from .operators import anchors, confseq, kernel, rivals, runs, tallies, wealth
from .plans import attribution, replay, study
from .sources import anchor_store, archives, generator, ingest, ledger, shared, tables
from .sources.score_cache import ScoreCache
from .sources.shared import written
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONFIG = attribution.Config(min_obs=10, backend="windows")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def monthly(spark: SparkSession, sf: str, shift: float = 0.0) -> DataFrame:
    return tables.monthly_discounts(spark, sf, shift)


def held_out(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs = monthly(spark, sf)
    return obs, runs.run_table(obs)


@query
def run_means(spark, sf):
    return runs.run_table(monthly(spark, sf)).select("kind", "run_index", "n", *r6("mean"), "suite_hash")


@query
def item_baseline(spark, sf):
    obs, every = held_out(spark, sf)
    return runs.item_baseline(obs, every, F.lit(8)).select("kind", "item_id", *r6("base"))


@query
def run_deviations(spark, sf):
    obs, every = held_out(spark, sf)
    return runs.deviations(obs, every, runs.item_baseline(obs, every, F.lit(8))).select("kind", "run_index", *r6("dev"))


@query
def paired_difference(spark, sf):
    floors = control_floor(spark, sf)
    _, legs = attribution.leg_table(monthly(spark, sf), floors, CONFIG)
    return legs.where("leg = 'corrected'").select("t", "run_index", *r6("dev", "sd"), "k")


def control_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The control set's noise floor from its first five months."""
    obs = monthly(spark, sf).where("kind = 'anchor' and run_index < 5").withColumnRenamed("run_index", "replicate")
    return anchors.noise_floor(obs, ["stream_id"])


@query
def noise_floor(spark, sf):
    out = anchors.noise_floor(tables.replicates(spark, sf))
    return out.select(*r6("per_item_sd", "run_mean_sd", "run_mean_range", "independence_ratio"), "replicates", "n_items", "unstable_items", "degenerate", "same_items")


@query
def pairwise_agreement(spark, sf):
    return anchors.pairwise_agreement(tables.replicates(spark, sf)).select(*r6("mean_abs_diff", "max_diff", "agreement"), "comparisons")


def _wealth(spark, sf, strategy: str) -> DataFrame:
    legs = tables.discount_legs(spark, sf)
    out = wealth.wealth_trajectory(legs, wealth.LEG, "t", "z", 0.5, strategy)
    return out.select("t", *r6("bet_up", "bet_down", "up", "down", "log_wealth"))


@query
def wealth_agrapa(spark, sf):
    return _wealth(spark, sf, "agrapa")


@query
def wealth_predmix(spark, sf):
    return _wealth(spark, sf, "predmix")


@query
def wealth_fixed(spark, sf):
    return _wealth(spark, sf, "fixed")


@query
def composite_wealth(spark, sf):
    legs = tables.discount_legs(spark, sf)
    return wealth.composite_trajectory(legs, wealth.LEG, "t", "z", F.col("null_lo"), F.col("null_hi")).select("t", *r6("up", "down", "log_e"))


@query
def edetector_trace(spark, sf):
    return wealth.detector_trace(tables.discount_legs(spark, sf), 0.025).select("t", *r6("log_e", "peak_log_e"), "alarm", "best_start", "direction")


@query
def edetector_alarm(spark, sf):
    legs = tables.discount_legs(spark, sf).withColumn("z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("z") - F.when(F.col("t") >= 30, 0.3).otherwise(0.0))))
    return wealth.alarm_times(wealth.detector_trace(legs, 0.025)).select("leg", "alarm_at", *r6("peak_log_e"))


@query
def arrow_detector(spark, sf):
    return kernel.detector_trace(tables.discount_legs(spark, sf), 0.025).select("t", *r6("log_e", "peak_log_e"), "alarm", "best_start", "direction")


@query
def streamed_detector(spark, sf):
    """The detector over a folder that the runs of table streams arrive in, 40 runs a file."""
    at = f"{shared.folder(spark)}/plumbline/stream-{uuid.uuid4().hex}"
    legs = tables.discount_legs(spark, sf).withColumn("epoch", F.lit(0).cast("long")).select(*(c.split()[0] for c in live.IN.split(", ")))
    legs.withColumn("part", F.floor(F.col("t") / 40)).repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(f"{at}/in")
    for part in sorted(r["part"] for r in spark.read.parquet(f"{at}/in").select("part").distinct().collect()):
        spark.read.schema(live.IN).parquet(f"{at}/in/part={part}").write.mode("append").parquet(f"{at}/landing")
        live.detect_folder(spark, f"{at}/landing", f"{at}/out", 0.025)
    return spark.read.schema(live.OUT).parquet(f"{at}/out/trace").select("t", *r6("log_e", "peak_log_e"), "alarm", "best_start", "direction")


@query
def eb_confidence_sequence(spark, sf):
    return confseq.empirical_bernstein(tables.discount_legs(spark, sf), wealth.LEG, "t", "z", 0.025).select("t", *r6("cs_lo", "cs_hi"))


@query
def hedged_confidence_sequence(spark, sf):
    return confseq.hedged(tables.discount_legs(spark, sf), wealth.LEG, "t", "z", 0.05).select("t", *r6("cs_lo", "cs_hi"))


@query
def estimated_baseline_null(spark, sf):
    base = tables.discount_legs(spark, sf).where("t < 8")
    return confseq.estimated_null(base, wealth.LEG, "t", "z", 0.05, 200).select("leg", *r6("null_lo", "null_hi", "point"))


def monitored(spark: SparkSession, sf: str, baseline: int = 8) -> DataFrame:
    every = runs.run_table(monthly(spark, sf).withColumn("kind", F.lit("system")))
    base = every.where(F.col("place") < baseline).groupBy("stream_id").agg(F.avg("mean").alias("base_mean"), F.stddev_samp("mean").alias("base_sd"))
    return every.where(F.col("place") >= baseline).join(base, "stream_id").select("stream_id", (F.col("place") - baseline).cast("long").alias("t"), "mean", "base_mean", "base_sd")


@query
def cusum_trace(spark, sf):
    return rivals.cusum_trace(monitored(spark, sf), 0.005).select("t", *r6("high", "low"))


@query
def cusum_alarm(spark, sf):
    return rivals.cusum(monitored(spark, sf), 0.005, 1.5)


@query
def fixed_threshold(spark, sf):
    return rivals.threshold(monitored(spark, sf), 0.015)


def welch_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs = monthly(spark, sf).withColumn("kind", F.lit("system"))
    per = obs.groupBy("stream_id", "run_index").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    per = per.withColumn("t", F.row_number().over(Window.partitionBy("stream_id").orderBy("run_index")) - 9)
    base = obs.join(per.where("t < 0").select("stream_id", "run_index"), ["stream_id", "run_index"], "left_semi")
    return per.where("t >= 0"), base.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n0"), F.avg("score").alias("mean0"), F.var_samp("score").alias("var0"))


@query
def welch_t_stat(spark, sf):
    return rivals.welch_trace(*welch_inputs(spark, sf)).select("t", *(F.round(c, 4).alias(c) for c in ("t_stat", "df")))


@query
def peeking_t_test(spark, sf):
    return rivals.t_test(*welch_inputs(spark, sf))


@query
def bonferroni_t_test(spark, sf):
    return rivals.t_test(*welch_inputs(spark, sf), bonferroni=True)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    obs = monthly(spark, sf).withColumn("i", F.col("run_index") * 20 + F.col("item_id").cast("int"))
    return obs.select("stream_id", (F.col("run_index") - 8).alias("t"), "i", (F.col("score") < 0.5).cast("int").alias("fail"), "score")


@query
def ddm_stat(spark, sf):
    rows = rivals.ddm_trace(outcomes(spark, sf))
    return rows.select("i", *r6("rate", "sd"), F.round("best.level", 6).alias("least_level"))


@query
def ddm_alarm(spark, sf):
    return rivals.ddm(outcomes(spark, sf), 1.0)


@query
def adwin_alarm(spark, sf):
    return rivals.adwin(outcomes(spark, sf))


@query
def adwin_buckets_alarm(spark, sf):
    moved = outcomes(spark, sf).withColumn("score", F.col("score") * F.when(F.col("t") >= 30, 0.4).otherwise(1.0))
    return rivals.adwin_buckets(outcomes(spark, sf).unionByName(moved.withColumn("stream_id", F.lit("moved"))))


@query
def min_detectable_shift(spark, sf):
    sizes = spark.range(1, 11).select((F.col("id") * 40).alias("n"))
    mds = power.min_shift_column(F.col("n"), F.lit(0.08), F.lit(0.0057), F.lit(200.0), student.dead_factor(F.lit(5), 0.05), F.lit(50), 0.05, 0.05)
    return sizes.select("n", F.round(mds, 6).alias("min_shift"))


@query
def plan_size(spark, sf):
    floor = Floor(0.08, 0.08 / 260**0.5, 5, 260)
    rows = [(t, power.min_items(t, floor, 0.05, 50, 40), power.min_horizon(0.05)) for t in (0.10, 0.05, 0.03, 0.02, 0.015, 0.01)]
    return spark.createDataFrame(rows, "target double, n long, min_horizon long")


EVIDENCE = "n_runs int, last_n int, pin_changed boolean, suite_agrees boolean, anchor_crossed boolean, corrected_crossed boolean, system_crossed boolean, adequate boolean"


def evidence_grid(spark: SparkSession) -> DataFrame:
    """Every combination of the facts the rules read."""
    df = spark.range(1).drop("id")
    for c in EVIDENCE.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, (False, True)))) if kind == "boolean" else F.explode(F.array(F.lit(5), F.lit(30))))
    return df


@query
def lattice_decision(spark, sf):
    grid = evidence_grid(spark)
    rule = scores.rule({c: F.col(c) for c in grid.columns}, 8, 30)
    out = grid.withColumn("rule_id", rule).withColumn("verdict", scores.verdict_of(F.col("rule_id")))
    return out.withColumn("exit_code", scores.exit_code(F.coalesce("verdict", F.lit("")), ["system", "both"], ["judge", "indeterminate"], F.col("verdict").isNull()))


def moved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return monthly(spark, sf, -0.1), control_floor(spark, sf)


@query
def verdict_by_stream(spark, sf):
    d = attribution.decide(*moved(spark, sf), CONFIG)
    return d.select("stream_id", "rule_id", "verdict", "n_runs", "system_crossed_at", "anchor_crossed_at", "corrected_crossed_at", *r6("system_peak_log_e", "anchor_peak_log_e", "corrected_peak_log_e", "system_shift_lo", "system_shift_hi", "corrected_lo", "corrected_hi", "min_shift"))


@query
def replay_all_prefixes(spark, sf):
    d = attribution.every_prefix(*moved(spark, sf), CONFIG)
    return d.select("stream_id", "at", "rule_id", "verdict", *r6("system_peak_log_e", "min_shift"))


@query
def replay_by_settings(spark, sf):
    """Verdicts of ten pairs of alpha and target after every tenth run, each by its own settings, from one trace."""
    obs, floors = moved(spark, sf)
    pairs = [(a, t) for a in (0.2, 0.1, 0.05, 0.02, 0.01) for t in (0.05, 0.1)]
    ends = obs.where("kind = 'system' and run_index % 10 = 9").select("stream_id", F.col("run_index").alias("at")).distinct()
    asked = ends.withColumn("p", F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("target")) for a, t in pairs)))).select("stream_id", "at", "p.*")
    return attribution.by_settings(obs, floors, asked, CONFIG).select("stream_id", "at", "alpha", "target", "rule_id", "verdict", *r6("system_peak_log_e", "min_shift"))


@query
def replay_divergence(spark, sf):
    """Recorded verdicts, two of them altered, against those derived again."""
    derived = attribution.every_prefix(*moved(spark, sf), CONFIG)
    wrong = F.when(F.col("at").isin(60, 70), "judge").otherwise(F.col("verdict"))
    recorded = derived.select("stream_id", "at", wrong.alias("verdict"), "rule_id", F.when(F.col("at") == 70, 0).otherwise(1).alias("semantics_version"))
    return replay.divergences(recorded, derived, 1)


@query
def suite_hash(spark, sf):
    return runs.run_table(tables.daily_values(spark, sf)).select("run_index", "n", "suite_hash", *r6("mean"))


@query
def suite_drift(spark, sf):
    every = runs.run_table(tables.daily_values(spark, sf, 20, 12))
    return every.groupBy("stream_id").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("suite_hash").alias("suites"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    score = (F.col("doc_id") * 37 % 101) / 100.0
    return anchors.candidates(docs.withColumn("item_id", F.col("doc_id").cast("string")), score, F.array("lang")).select("item_id", "score", "tags", "stratum", "source")


@query
def strata(spark, sf):
    return labelled(spark, sf).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_pick(spark, sf):
    return anchors.stratified_sample(labelled(spark, sf), 120, 7)


@query
def random_pick(spark, sf):
    return anchors.random_sample(labelled(spark, sf), 50, 7).select("item_id", "stratum")


@query
def anchor_coverage(spark, sf):
    suite = labelled(spark, sf)
    out = anchors.coverage(suite, suite.where("score < 0.85 and not array_contains(tags, 'es')"))
    return out.select(*r6("decile_coverage", "tag_coverage", "max_marginal_gap"), F.array_join("missing_deciles", ",").alias("missing_deciles"), F.array_join("missing_tags", ",").alias("missing_tags"), "anchor_n", "suite_n")


@query
def gold_agreement(spark, sf):
    gold = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("double").alias("gold"))
    return anchors.gold_agreement(labelled(spark, sf).select("item_id", "score"), gold).select(*r6("mae"), "n")


@query
def cached_scores(spark, sf):
    """Labels as a cache; unlabelled items get the scorer's fixed opinion of their id."""
    cache = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("item_id"), F.col("quality").cast("double").alias("score"))
    items = labelled(spark, sf).select("item_id")
    return anchors.fill_from_cache(items, cache, lambda m: m.withColumn("score", generator.latent_level(F.col("item_id")))).select("item_id", *r6("score"))


@query
def ingest_issues(spark, sf):
    """lineitem as score lines: repeated ids, empty ids, scores out of the declared range."""
    rows = tables.read(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.col("l_tax").alias("score"))
    return ingest.validate(rows, 0.0, 0.07).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_lines(spark, sf):
    """lineitem as score lines, a file a ship year, some of them comments or broken: every issue with its lines."""
    at = f"{shared.folder(spark)}/plumbline/lines-{uuid.uuid4().hex}"
    rows = tables.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.year("l_shipdate").alias("year"))
    record = F.to_json(F.struct(F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 3).alias("item_id"), F.col("l_tax").alias("score")))
    value = F.when(F.col("l_quantity") == 13, "// left out").when(F.col("l_quantity") == 17, F.concat(F.lit("{"), record)).when(F.col("l_quantity") == 19, "").otherwise(record)
    ordered = rows.repartition("year").sortWithinPartitions("year", "l_orderkey", "l_linenumber", "l_tax", "l_quantity")
    ordered.select("year", value.alias("value")).write.partitionBy("year").text(at)
    found = ingest.load(spark, "jsonl", f"{at}/*", 0.0, 0.07)
    year = F.regexp_extract("source", "year=([0-9]+)", 1).cast("int").alias("year")
    return found.groupBy(year, F.array_join("issues", ", ").alias("issues")).agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.coalesce(F.sum("first_line"), F.lit(0)).alias("first_lines"))


@query
def archived_logs(spark, sf):
    """documents as score logs, an archive for every 2,000 ids of a source: its last member with samples is what counts."""
    at = f"{shared.folder(spark)}/plumbline/archives-{uuid.uuid4().hex}"
    docs = tables.read(spark, sf, "documents").withColumn("archive", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 2000), F.lit(".eval")))
    score = F.when(F.col("doc_id") % 11 == 0, 1.5).otherwise(F.col("n_chars") % 101 / 100.0)
    sample = lambda value: F.struct(F.col("doc_id").cast("string").alias("id"), F.struct(F.struct(value.alias("value")).alias("acc")).alias("scores"))
    logs = docs.groupBy("archive").agg(F.collect_list(sample(F.lit(0.0))).alias("first"), F.collect_list(sample(score)).alias("last"))
    told = {"a.json": F.struct(F.col("first").alias("samples")), "b.json": F.struct(F.col("last").alias("samples")), "header.json": F.struct(F.lit(2).alias("version"))}
    files = F.array(*(F.struct(F.lit(name).alias("member"), F.to_json(value).alias("value")) for name, value in told.items()))
    archives.write(logs.select("archive", F.inline(files)), at).agg(F.sum("members")).collect()
    source = F.regexp_extract("source", r"([^/]+)-[0-9]+\.eval$", 1).alias("source")
    return ingest.load(spark, "inspect", at, 0.0, 1.0).groupBy(source, F.coalesce("issue", F.lit("")).alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("normalised"), F.lit(0.0)), 4).alias("scores"))


@query
def scale_suggestion(spark, sf):
    rows = tables.read(spark, sf, "lineitem")
    each = rows.select(F.explode(F.create_map(F.lit("discount"), "l_discount", F.lit("quantity"), "l_quantity", F.lit("tax"), "l_tax")).alias("name", "x"))
    out = each.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("s", scores.suggest_scale(F.col("lo"), F.col("hi")))
    return out.select("name", "lo", "hi", F.col("s.lo").alias("scale_lo"), F.col("s.hi").alias("scale_hi"))


@query
def kept_scores(spark, sf):
    """A cache over three runs: labels go in, all documents are filled from it and the scorer, then toxic ones are corrected to 0."""
    cache = ScoreCache(spark, f"{shared.folder(spark)}/plumbline/cache-{uuid.uuid4().hex}", 64)
    labels = tables.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("double").alias("score"), "toxic")
    cache.upsert(labels.where("score is not null").withColumn("at", F.lit(0)))
    items = tables.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"))
    cache.fill(items, lambda m: m.withColumn("score", generator.latent_level(F.col("key"))), 1)
    cache.upsert(labels.where("toxic = 1").select("key", F.lit(0.0).alias("score"), F.lit(2).alias("at")))
    return cache.lookup(items).select(F.col("key").alias("item_id"), *r6("score"))


@query
def reply_scores(spark, sf):
    """The first number in each turn of a conversation, if it lies on the scale 0 to 10."""
    rows = tables.read(spark, sf, "conversations")
    return rows.select("conv_id", "turn", scores.first_number(F.col("text"), 0.0, 10.0).alias("score"))


@query
def scoring_within_a_limit(spark, sf):
    """Documents scored in sixteen waves, at a millionth of a unit a character, until a third of what all would cost is spent; toxic ones fail."""
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("text").alias("output"), F.length("text").alias("n")).dropDuplicates(["doc_id"])
    toxic = tables.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    items = docs.join(toxic, "doc_id", "left").select(F.col("doc_id").cast("string").alias("item_id"), F.coalesce("toxic", F.lit(0)).cast("string").alias("prompt_input"), "output", "n")
    limit = items.agg(F.sum("n")).first()[0] / 3e6

    def score(toxic: str, text: str) -> tuple[float, float]:
        if toxic == "1":
            raise ValueError("refused")
        return len(text) % 101 / 100, len(text) / 1e6

    out = anchor_store.score_within(items.drop("n"), score, limit, raises=ValueError, retries=1, pause=0.0)
    return out.groupBy("wave", F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 2).alias("scores"))


@query
def call_costs(spark, sf):
    """Cost of one call per document by the longest matching price prefix of its source."""
    docs = tables.read(spark, sf, "documents")
    price = scores.longest_prefix_price(F.col("source"), {"src": 1.0, "src1": 2.0, "src12": 4.0})
    cost = scores.call_cost(F.col("n_chars") / 4.0, F.lit(10.0), price, price * 5.0)
    return docs.groupBy("source").agg(F.round(F.sum(cost), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query
def refusal_rates(spark, sf):
    calls = tables.read(spark, sf, "labels").join(tables.read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return tallies.refusal_rates(calls.select(F.col("source").alias("config"), (F.col("toxic") == 1).alias("refused")), "src0").select("config", "n", *r6("rate", "multiple"))


@query
def letter_grades(spark, sf):
    flags = tables.read(spark, sf, "orders").select(F.translate("o_orderstatus", "OFP", "CIP").alias("g"))
    return flags.groupBy("g").agg(F.round(F.avg(scores.grade(F.col("g"))), 6).alias("score"), F.count(F.lit(1)).alias("n"))


@query
def chain_verify(spark, sf):
    """A hash chain over daily event counts, with one payload altered: what verification finds."""
    days = tables.read(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    payloads = days.orderBy("d").select(F.to_json(F.struct("d", "n")).alias("payload"))
    lines = ledger.chain(spark, [("run", r["payload"]) for r in payloads.collect()])
    broken = lines.withColumn("payload", F.when(F.col("seq") == 10, F.regexp_replace("payload", '"n":', '"n":1')).otherwise(F.col("payload")))
    return ledger.verify(broken).select("seq", "hash_ok", "link_ok", "seq_ok")


@query
def verdict_counts(spark, sf):
    d = attribution.every_prefix(*moved(spark, sf), CONFIG)
    return tallies.verdict_counts(d.select("stream_id", F.coalesce("verdict", F.lit("refused")).alias("verdict")), ["stream_id"], [*scores.VERDICTS, "refused"])


def simulated(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Decisions of a small grid of simulated streams, with their truth."""
    specs = generator.grid(spark, 2, judge_shift=[0.0, -0.1], system_shift=[0.0, -0.1], n_runs=[60], system_items=[60], anchor_items=[200])
    obs = generator.observations(specs)
    d = attribution.decide(obs, generator.floors(specs), attribution.Config(backend="kernel"))
    joined = d.select("stream_id", "verdict", "rule_id", F.col("system_crossed_at").alias("alarm_at")).join(generator.truth(specs), "stream_id").join(specs.select(F.col("name").alias("stream_id"), "cell"), "stream_id")
    return joined, specs


@query
def simulation_tally(spark, sf):
    return tallies.tally(simulated(spark)[0], ["truth"], 12)


@query
def simulation_misattribution(spark, sf):
    return tallies.misattribution(simulated(spark)[0].withColumn("method", F.lit("full")), ["method"])


@query
def simulation_modal_verdict(spark, sf):
    return tallies.modal_verdict(simulated(spark)[0], ["cell"])


@query
def simulation_arl0(spark, sf):
    return tallies.arl0(simulated(spark)[0].withColumn("method", F.lit("full")), ["method"], 52)


WATCHED = {
    "threshold": lambda rows: rivals.threshold(rows, 0.2503),
    "cusum": lambda rows: rivals.cusum(rows, 0.1),
    "cusum_tight": lambda rows: rivals.cusum(rows, 0.1, 2.5),
}
MOVED_AT, WATCHED_RUNS = 24, 72


def outcomes_table(spark: SparkSession, sf: str) -> DataFrame:
    """cell, truth, shift, method, alarm_at, verdict of the monthly discounts of parts under known changes: what the tallies are of."""
    return study.leg_outcomes(tables.moved_discounts(spark, sf, since=MOVED_AT), ["cell", "truth", "shift"], WATCHED)


@query
def tally_rates(spark, sf):
    out = tallies.tally(outcomes_table(spark, sf), ["method", "truth"], MOVED_AT)
    return out.select("method", "truth", "n", "alarms", *r6("false_alarm_rate", "detection_rate", "median_delay", "mean_delay"))


@query
def tally_misattribution(spark, sf):
    return tallies.misattribution(outcomes_table(spark, sf), ["method"]).select("method", *r6("judge_as_system", "system_as_judge", "indeterminate_rate", "accuracy"))


@query
def tally_modal_verdict(spark, sf):
    return tallies.modal_verdict(outcomes_table(spark, sf), ["cell"])


@query
def tally_arl0(spark, sf):
    return tallies.arl0(outcomes_table(spark, sf), ["method"], WATCHED_RUNS).select("method", *r6("arl0"))


@query
def tally_worst_cell(spark, sf):
    rates = tallies.misattribution(outcomes_table(spark, sf).where("truth = 'judge'"), ["cell"])
    return tallies.worst_cell(rates, "cell", "judge_as_system").select(*r6("mean_rate", "worst_rate"), "worst_cell")


@query
def delay_by_shift(spark, sf):
    return study.delay_by_shift(outcomes_table(spark, sf), MOVED_AT).select("method", "shift", *r6("median_delay", "mean_delay"), "n")


@query
def delay_ratio(spark, sf):
    return study.delay_ratio(study.delay_by_shift(outcomes_table(spark, sf), MOVED_AT), "threshold", "cusum").select(*r6("mean_delay", "mean_delay_against", "ratio"))


@query
def headline_guard(spark, sf):
    rows = outcomes_table(spark, sf).where("method = 'cusum'")
    share = lambda truth, hit: F.avg(F.when(F.col("truth") == truth, hit.cast("double")))
    said = F.col("verdict")
    rates = rows.agg(share("stable", F.col("alarm_at").isNotNull()).alias("false_alarm_rate"), share("judge", said == "judge").alias("judge_correct"), share("judge", said == "system").alias("judge_as_system"))
    return study.guard(rates).select("failure", *r6("value"), "bound")


def supplier_pool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as items, return flags and the tax as configurations, line numbers as repeated scorings."""
    rows = tables.read(spark, sf, "lineitem").withColumn("item_id", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    named = F.create_map(*(F.lit(x) for pair in (("A", "a-baseline"), ("N", "b-other-snapshot"), ("R", "c-strict-rubric")) for x in pair))
    flags = rows.groupBy(named[F.col("l_returnflag")].alias("config"), "item_id").agg((F.avg("l_discount") / 0.1).alias("score"))
    effort = rows.groupBy(F.lit("d-effort").alias("config"), "item_id").agg((F.avg("l_tax") / 0.08).alias("score"))
    repeats = rows.groupBy((F.col("l_linenumber") % 5).alias("replicate"), "item_id").agg((F.avg("l_discount") / 0.1).alias("score"))
    return flags.unionByName(effort), repeats


@query
def composed_streams(spark, sf):
    """Six scenarios spliced from a pool: every run's size and mean."""
    obs, _ = study.compose(spark, *supplier_pool(spark, sf), anchor_n=40, system_n=40)
    return obs.groupBy("stream_id", "kind", "run_index").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean")).select("stream_id", "kind", "run_index", "n", *r6("mean"))


@query
def pool_floor(spark, sf):
    pool, repeats = supplier_pool(spark, sf)
    return study.pool_floor(repeats, study.halves(study.common_items(pool), 40, 40)).select(*r6("per_item_sd", "run_mean_sd"), "replicates", "n_items")


@query
def scenario_verdicts(spark, sf):
    return study.scenario_verdicts(*study.compose(spark, *supplier_pool(spark, sf), anchor_n=40, system_n=40), attribution.Config())


@query
def pool_common_items(spark, sf):
    """Customers with orders of every priority."""
    orders = tables.read(spark, sf, "orders")
    return study.common_items(orders.select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("item_id")))


@query
def pool_halves(spark, sf):
    pool, _ = supplier_pool(spark, sf)
    return study.halves(study.common_items(pool), 40, 40)


@query
def coverage_warnings(spark, sf):
    suite = labelled(spark, sf)
    out = anchors.coverage_warnings(anchors.coverage(suite, suite.where("score < 0.85 and not array_contains(tags, 'es')")))
    return out.select("adequate", F.array_join("warnings", "; ").alias("warnings"))


@query
def noise_floor_warnings(spark, sf):
    rows = tables.replicates(spark, sf).withColumn("set", F.explode(F.array(F.lit("all"), F.lit("two"), F.lit("flat"))))
    rows = rows.where("set <> 'two' or replicate < 2").withColumn("score", F.when(F.col("set") == "flat", 0.5).otherwise(F.col("score")))
    return anchors.floor_warnings(anchors.noise_floor(rows, ["set"])).select("set", F.array_join("warnings", "; ").alias("warnings"))


@query
def head_per_stratum(spark, sf):
    docs = tables.read(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("item_id"), F.col("lang").alias("stratum"))
    return anchors.head_per_stratum(docs, 450)


@query
def first_items(spark, sf):
    return anchors.first_items(tables.read(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("item_id"), "lang"), 30)


@query
def clipped_texts(spark, sf):
    docs = tables.read(spark, sf, "documents")
    return docs.select("doc_id", F.length(anchors.clipped(F.col("text"), 1200)).alias("n"), F.sha2(anchors.clipped(F.col("text"), 2400), 256).alias("sha256"))


@query
def run_means_reordered(spark, sf):
    """The order of observations within a run changes nothing."""
    obs = monthly(spark, sf).repartition(3, "score").sortWithinPartitions(F.col("score").desc())
    return runs.run_table(obs).select("kind", "run_index", "n", *r6("mean"), "suite_hash")


@query
def point_null_wealth(spark, sf):
    legs = tables.discount_legs(spark, sf)
    base = legs.where("t < 8").groupBy("stream_id").agg(F.avg("z").alias("m0"))
    rows = study.point_null(legs.where("t >= 8").join(base, "stream_id"), wealth.LEG, "t", "z", F.col("m0"), 0.05)
    return rows.select("t", *r6("log_wealth"), "alarm")


def many_streams(spark: SparkSession, seeds: int = 13) -> tuple[DataFrame, DataFrame]:
    """Eight methods on 8 cells of simulated streams: outcomes with truth, shift and cell; and the specs."""
    specs = generator.grid(spark, seeds, judge_shift=[0.0, -0.1], system_shift=[0.0, -0.02, -0.05, -0.1], n_runs=[60], system_items=[60], anchor_items=[200])
    obs = written(generator.observations(specs), "simulated")  # made once, read by every method
    said = study.alarms(obs, generator.floors(specs), attribution.Config())
    about = specs.select(F.col("name").alias("stream_id"), "cell", F.abs("system_shift").alias("shift"))
    return said.join(generator.truth(specs), "stream_id").join(about, "stream_id"), specs


@query
def simulation_methods(spark, sf):
    """Every method's rates over 104 streams."""
    return tallies.tally(many_streams(spark)[0], ["method"], 12)
