"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns give the base spans (email, ip, card, phone). They seed the bootstrap: base spans,
and all other tokens of at least six characters with four digits or an @, are instances; the one and the
two whole words before the word that an instance begins in, lower-cased, are its lexical patterns, for seeds and
candidates alike. On the graph of patterns and instances, scores are updated in turn:

* A pattern's confidence for a kind is the belief in its instances, as a mean over the pattern's occurrences.
  Patterns below `least_confidence`, or with fewer than `least_seeds` different believed instances, count 0.
* An occurrence takes the more confident of its two patterns (ties: the kind listed first). An instance's belief
  is the mean of that over all its occurrences, so one that mostly stands elsewhere is refused; seeds keep 1.

After `rounds` rounds, occurrences of believed instances that stand behind a confident pattern of the same kind
become spans of that kind; those that touch a base span never do.

Scanning happens once; the graph is built from its result, a narrow table in the shared folder. A pattern
or instance that holds a third of all occurrences is one row per partition after the partial aggregation.

Nulls: a null text is empty and has no spans; a null doc_id stays. Repeated rows are scanned one by one and
count one by one in the graph. Very long texts are scanned whole, words of any length kept whole. Ties between
kinds go to the one listed first. Tables may be empty; other columns are ignored by `pii_spans` and kept by
`redact`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, text_or_empty
from .spans import ITEM, SPAN, apart, find, joined, matches, ordered, redacted, running, span

# The kinds, in this order.
KINDS = ["email", "ip", "card", "phone"]

# What a leftmost search for the plain patterns finds, written so that no start is tried twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_OK = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + v - F.when(v > 9, 9).otherwise(0)

    n = F.length(d)
    return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    return ordered(
        find(text, EMAIL, "email", 0, cheap=F.contains(text, F.lit("@"))),
        find(text, IP, "ip", 1, lambda m: m.rlike(IP_OK)),
        find(text, CARD, "card", 2, luhn),
        find(text, PHONE, "phone", 3, lambda m: F.length(digits(m)).between(9, 15), cheap=F.contains(text, F.lit("+"))),
    )


INSTANCE = "struct<s:int,e:int,token:string,one:string,two:string,o:int>"
WORD = "struct<ws:int,we:int,s:int,e:int,token:string,one:string,two:string,ok:boolean>"


def instance(s: Column, e: Column, token: Column, one: Column, two: Column, o: Column) -> Column:
    """One place in a text, with the one and the two words before it."""
    one, two = (F.coalesce(x, F.lit("")).alias(n) for x, n in ((one, "one"), (two, "two")))
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lower(token).alias("token"), one, two, o.cast("int").alias("o"))


def marked_words(text: Column) -> Column:
    """All words with a digit or @: where they are, what is left without marks around it, and the words before."""

    def step(acc: Column, x: Column) -> tuple[Column, Column, Column]:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["m"])
        before = F.reverse(F.concat(acc["tail"], x["gap"]))
        last, other = (F.lower(F.reverse(F.regexp_extract(before, r"^\s+(\S+)(?:\s+(\S+))?", g))) for g in (1, 2))
        bare = F.regexp_replace(x["m"], r"^[\"'(\[<]+|[\"')\]>.,;:!?]+$", "")
        lead = F.length(F.regexp_extract(x["m"], r"^[\"'(\[<]*", 0))
        ok = (F.length(bare) >= 6) & ((F.length(digits(bare)) >= 4) | F.contains(bare, F.lit("@")))
        two = F.when(other != "", F.concat(other, F.lit(" "), last)).otherwise("")
        new = F.struct(s.alias("ws"), e.alias("we"), (s + lead).alias("s"), (s + lead + F.length(bare)).alias("e"), bare.alias("token"), last.alias("one"), two.alias("two"), ok.alias("ok"))
        after = F.struct(F.coalesce(e, s).cast("int").alias("at"), F.coalesce(F.concat(last, F.lit(" "), x["m"]), F.lit("")).alias("tail"))
        return after, new.cast(WORD), x["m"].isNotNull()

    found = running(matches(text, TOKEN), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), WORD, step)["out"]
    return F.when(text.rlike(TOKEN), found).otherwise(F.array().cast(f"array<{WORD}>"))


def seeds_in(base: Column, words: Column) -> Column:
    """Base spans as instances, in order. Each has a digit or an @, so it begins in a marked word."""
    nothing = F.lit(None).cast(ITEM).alias("b")
    places = F.concat(
        F.transform(words, lambda w: F.struct(w["ws"].alias("at"), F.lit(-1).alias("o"), w["one"].alias("one"), w["two"].alias("two"), nothing)),
        F.transform(base, lambda b: F.struct(b["s"].alias("at"), b["o"].alias("o"), F.lit(None).cast("string").alias("one"), F.lit(None).cast("string").alias("two"), b.alias("b"))),
    )

    def step(word: Column, p: Column) -> tuple[Column, Column, Column]:
        here = F.struct(p["one"].alias("one"), p["two"].alias("two"))
        return F.when(p["o"] < 0, here).otherwise(word), instance(p["b"]["s"], p["b"]["e"], p["b"]["value"], word["one"], word["two"], p["o"]), p["o"] >= 0

    return running(F.array_sort(places), F.struct(F.lit("").alias("one"), F.lit("").alias("two")), INSTANCE, step)["out"]


def scan(docs: DataFrame, *keys: Column) -> DataFrame:
    """The keys, base, and t: base spans and other tokens as instances, of every row, as a narrow table."""
    names = [f"k{i}" for i in range(len(keys))]
    text = text_or_empty()
    found = docs.select(*(k.alias(n) for k, n in zip(keys, names)), base_spans(text).alias("base"), marked_words(text).alias("w"))

    free = apart(F.filter("w", lambda w: w["ok"]), F.col("base"), WORD)
    others = F.transform(free, lambda w: instance(w["s"], w["e"], w["token"], w["one"], w["two"], F.lit(None)))
    seeds = F.when(F.size("base") > 0, seeds_in(F.col("base"), F.col("w"))).otherwise(F.array().cast(f"array<{INSTANCE}>"))
    return materialize(found.select(*names, "base", F.concat(seeds, others).cast(f"array<{INSTANCE}>").alias("t")), "pii-scan")


def judged(places: DataFrame, patterns: DataFrame) -> DataFrame:
    """places (one, two, ...) with kind and belief: of the more confident pattern, null and 0 without one."""
    behind = places
    for side in ("one", "two"):
        known = patterns.select(F.col("pattern").alias(side), F.col("o").alias(f"o_{side}"), F.col("confidence").alias(f"c_{side}"))
        behind = behind.join(known, side, "left")
    one, two = F.coalesce("c_one", F.lit(0.0)), F.coalesce("c_two", F.lit(0.0))
    first = (one > two) | ((one == two) & (F.coalesce("o_one", F.lit(99)) <= F.coalesce("o_two", F.lit(99))))
    return behind.withColumn("kind", F.when(first, F.col("o_one")).otherwise(F.col("o_two"))).withColumn("belief", F.greatest(one, two)).drop("o_one", "o_two", "c_one", "c_two")


def bootstrap(scanned: DataFrame, least_confidence: float = 0.6, least_seeds: int = 3, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pattern, o, confidence) and (token, o, belief): what has been learnt, seeds included in the second."""
    each = scanned.select(F.explode("t").alias("t")).select("t.*")
    places = materialize(each.groupBy("token", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o")), "pii-places")
    links = places.select("token", "n", F.explode(F.array_distinct(F.array("one", "two"))).alias("pattern")).where("pattern <> ''").groupBy("pattern", "token").agg(F.sum("n").alias("n"))
    links = materialize(links, "pii-graph")
    seeds = materialize(places.where("o is not null").groupBy("token").agg(F.min("o").alias("o")).withColumn("belief", F.lit(1.0)), "pii-seeds")
    totals = links.groupBy("pattern").agg(F.sum("n").alias("total"))
    believed, patterns = seeds, None
    for _ in range(rounds):
        hits = links.join(believed, "token").groupBy("pattern", "o").agg(F.sum(F.col("n") * F.col("belief")).alias("hit"), F.count(F.lit(1)).alias("seeds"))
        good = hits.where(F.col("seeds") >= least_seeds).join(totals, "pattern").withColumn("confidence", F.col("hit") / F.col("total"))
        good = good.where(F.col("confidence") >= least_confidence).groupBy("pattern").agg(F.max(F.struct("confidence", -F.col("o"))).alias("best"))
        patterns = materialize(good.select("pattern", (-F.col("best.col2")).alias("o"), F.col("best.confidence").alias("confidence")), "pii-patterns")
        sums = [F.sum(F.when(F.col("kind") == i, F.col("n") * F.col("belief")).otherwise(0.0)).alias("up") for i in range(len(KINDS))]
        means = judged(places, patterns).groupBy("token").agg(F.sum("n").alias("n"), *(c.alias(f"up{i}") for i, c in enumerate(sums)))
        best = F.array_max(F.array(*(F.struct((F.col(f"up{i}") / F.col("n")).alias("belief"), F.lit(-i).alias("minus")) for i in range(len(KINDS)))))
        learnt = means.select("token", best.alias("best")).where(F.col("best.belief") >= least_confidence).join(seeds, "token", "left_anti")
        believed = materialize(learnt.select("token", (-F.col("best.minus")).alias("o"), F.col("best.belief").alias("belief")).unionByName(seeds), "pii-believed")
    return patterns, believed


def added_spans(scanned: DataFrame, key: str, patterns: DataFrame, believed: DataFrame) -> DataFrame:
    """key, more: the spans that the bootstrap adds, for rows that have any."""
    each = scanned.select(key, F.explode("t").alias("t")).where("t.o is null").select(key, "t.s", "t.e", "t.token", "t.one", "t.two")
    found = judged(each, patterns).where("kind is not null").join(believed.select("token", F.col("o").alias("kind")), ["token", "kind"])
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.groupBy(key).agg(F.array_sort(F.collect_list(span(F.col("s"), F.col("kind"), F.col("e"), name, F.col("token")))).alias("more"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, more of every row: arrays of spans, sorted."""
    scanned = scan(docs, F.col("doc_id"), F.monotonically_increasing_id())
    more = added_spans(scanned, "k1", *bootstrap(scanned))
    return scanned.select("k1", "k0", "base").join(more, "k1", "left").select(F.col("k0").alias("doc_id"), "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind. Rows find their spans by the text's hash."""
    key = F.sha2(text_or_empty(), 256)
    scanned = scan(docs, key)
    once = scanned.dropDuplicates(["k0"])
    more = added_spans(once, "k0", *bootstrap(scanned))
    spans = once.join(more, "k0", "left").select("k0", ordered(F.col("base"), F.coalesce("more", F.array().cast(SPAN))).alias("spans")).where(F.size("spans") > 0)
    rows = docs.select(F.struct(*columns(docs)).alias("row"), key.alias("k0")).join(spans, "k0", "left")
    clean = F.when(F.col("spans").isNotNull() & F.col("row.text").isNotNull(), redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    return rows.select(*(clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def counts(base: Column, kinds: list[str]) -> list[Column]:
    def of(k: str) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")

    return [of(k) for k in kinds]


def report(docs: DataFrame) -> DataFrame:
    base = F.col("base")
    return pii_spans(docs).select("doc_id", *counts(base, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(ordered(base, F.col("more"))).alias("spans"), F.size("more").cast("long").alias("n_added"))
