"""Repair of conversation structure by a fold in Spark SQL's higher-order functions.

Window functions place the turns of each conversation and flag their faults; the places' codes are collected, sorted,
and aggregate() folds them, carrying four (cost, audit) structs: the cheapest edits so far that leave the roles at
the start, after a system, a user, or an assistant turn. Each step takes least() of the ways into every state, so
that ties go to the ASCII-least audit. An audit that is a proper prefix of another of the same turns is cheaper, so the
least of the beginnings stays the least of the wholes.

A conversation of any length is folded in chunks of `CHUNK` turns, the later ones from each of the four states, and
the chunks are folded in turn; nothing but codes of two letters is collected, and all windows and chunks have the
conversation in their key. The repaired text's digest is a digest of one byte string, so its rows are read in
order by one task, row by row (hashlib over Arrow batches), never held together. Texts are shuffled once.

Order of a conversation's turns: turn (nulls first), role, SHA-256 of the text, each before its own repetition.
Nulls: null roles and texts are one space, and so is a null conv_id or turn where it is named; a null conv_id is a
conversation. Repeated rows are turns like others (duplicates, if not blank). Roles count by their first
character; an empty or unknown one is neither kept nor legal. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACES = " \t\n\x0b\x0c\r"
CHUNK = 1024
# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STATE = "struct<cost:bigint,audit:string>"


def name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy: the turns after damage by the checksum of conversation and turn."""
    rows = conversations.select(name("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2("text", 256)).alias("place"), F.explode(copies).alias("copy"))


def flagged(turns: DataFrame) -> DataFrame:
    """conv, pos, turn, initial, fault, and what a conversation's sums need, of every turn; no texts."""
    tail = F.rtrim(F.col("text"), F.lit(SPACES))
    ending = F.when(tail == "", "b").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    narrow = turns.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("hash"), ending.alias("ending"), "place", "copy")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "place", "copy")
    before = F.lag("turn").over(order)
    initial = F.substring("role", 1, 1)
    placed = narrow.select(
        "conv",
        "turn",
        "role",
        "hash",
        "ending",
        initial.alias("initial"),
        F.row_number().over(order).cast("long").alias("pos"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before)).alias("new_turn"),
        F.lag(initial).over(order).alias("last"),
    )
    again = F.row_number().over(Window.partitionBy("conv", "role", "hash").orderBy("pos")) > 1
    fault = F.when(F.col("ending") == "b", "b").when(again, "d").otherwise(F.col("ending"))
    illegal = F.col("last").isNotNull() & ~F.concat("last", "initial").isin("su", "ua", "au")
    return placed.select("conv", "turn", "pos", "new_turn", "initial", fault.alias("fault"), illegal.alias("illegal"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def edit(state: Column, cost: Column | int, letter: str, allowed: Column | None = None) -> Column:
    """The state after one more edit; null where there is none, or where it isn't allowed."""
    cost = F.lit(cost) if isinstance(cost, int) else cost
    ok = state.isNotNull() if allowed is None else state.isNotNull() & allowed
    return F.when(ok, F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit")))


def states(s: list[Column]) -> Column:
    return F.struct(*(x.cast(STATE).alias(f"s{i}") for i, x in enumerate(s)))


def inserted(acc: Column) -> Column:
    """The four states once as many turns as pay were inserted."""
    user = F.least(acc["s2"], *(edit(acc[f"s{i}"], INSERT, "I") for i in (0, 1, 3)))
    return let(user, lambda u: states([acc["s0"], acc["s1"], u, F.least(acc["s3"], edit(u, INSERT, "I"))]))


def step(acc: Column, x: Column) -> Column:
    """The four states after turn x, a struct of pos, initial, fault."""
    live = ~x["fault"].isin("b", "d")
    extra = F.when(x["fault"] == "t", TRUNCATED).otherwise(0)

    def keep(state: Column, initial: str) -> Column:
        return edit(state, extra, "K", live & (x["initial"] == initial))

    def turned(s: Column) -> Column:
        return states(
            [
                edit(s["s0"], DELETE, "D"),
                F.least(edit(s["s1"], DELETE, "D"), keep(s["s0"], "s")),
                F.least(edit(s["s2"], DELETE, "D"), *(way for i in (0, 1, 3) for way in (keep(s[f"s{i}"], "u"), edit(s[f"s{i}"], extra + REROLE, "R", live)))),
                F.least(edit(s["s3"], DELETE, "D"), keep(s["s2"], "a"), edit(s["s2"], extra + REROLE, "R", live)),
            ]
        )

    return let(inserted(acc), turned)


def begun(at: int) -> Column:
    """The four states where only one is possible."""
    return states([F.struct(F.lit(0).alias("cost"), F.lit("").alias("audit")) if i == at else F.lit(None) for i in range(4)])


def joined(acc: Column, x: Column) -> Column:
    """The four states after a chunk x, whose field f<i> has those that follow from state i."""

    def both(i: int, j: int) -> Column:
        a, b = acc[f"s{i}"], x[f"f{i}"][f"s{j}"]
        return F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")))

    return states([F.least(*(both(i, j) for i in range(4))) for j in range(4)])


def audits(flags: DataFrame) -> DataFrame:
    """conv, cost, audit: the cheapest repair of every conversation with turns."""
    code = F.struct("pos", "initial", "fault")
    chunks = flags.groupBy("conv", F.expr(f"(pos - 1) div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(code)).alias("turns"))
    folded = [F.when((F.col("chunk") > 0) | F.lit(i == 0), F.aggregate("turns", begun(i), step)).alias(f"f{i}") for i in range(4)]
    chains = chunks.select("conv", F.struct("chunk", *folded).alias("x")).groupBy("conv").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    whole = F.aggregate("xs", begun(0), joined, lambda acc: let(inserted(acc), lambda s: F.least(s["s0"], s["s3"])))
    return chains.select("conv", whole.alias("best")).select("conv", "best.cost", "best.audit")


SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = f"conv_id long, {', '.join(f'{c} long' for c in SUMS)}, audit string, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's head row (counts, and the audit as text), then its turns in order."""
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    done: list[tuple] = []
    head, digest, at, users, lines = None, None, 0, 0, 0

    def line(role: str, text: str) -> None:
        nonlocal users, lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
        lines += 1
        users += role[:1] != "s"

    def inserts() -> None:
        nonlocal at
        while head[-1][at : at + 1] == "I":
            line("assistant" if users % 2 else "user", "")
            at += 1

    def finish() -> None:
        inserts()
        done.append((*head, digest.hexdigest()))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        done.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("head", "conv_id", *SUMS, "role", "text"))):
            if row[0]:
                if head is not None:
                    finish()
                head, digest, at, users, lines = (*row[1:8], row[9]), hashlib.sha256(), 0, 0, 0
                continue
            inserts()
            letter = head[-1][at]
            at += 1
            if letter != "D":
                line(row[8] if letter == "K" else "assistant" if users % 2 else "user", row[9])
        if done:
            yield flush()
    if head is not None:
        finish()
        yield flush()


def repair(conversations: DataFrame) -> DataFrame:
    """The columns of REPAIRED of every conv_id, gone ones included."""
    turns = damaged(conversations)
    flags = materialize(flagged(turns), "turns")
    counts = flags.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps"),
        *(F.count_if(F.col("fault") == c).alias(n) for c, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))),
        F.count_if("illegal").alias("illegal"),
    )
    known = conversations.select(name("conv_id").alias("conv"), F.col("conv_id").cast("long").alias("conv_id")).distinct()
    heads = known.join(counts, "conv", "left").join(audits(flags), "conv", "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS]
    nothing = [F.lit(None).cast("long").alias(c) for c in ("conv_id", *SUMS)]
    first = heads.select("conv", F.lit(True).alias("head"), "conv_id", *sums, F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.coalesce("audit", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("place"), F.lit(0).alias("copy"))
    rest = turns.select("conv", F.lit(False).alias("head"), *nothing, "turn", "role", "text", "place", "copy")
    rows = first.unionByName(rest).repartition("conv").sortWithinPartitions("conv", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "place", "copy")
    return rows.mapInArrow(_digest, REPAIRED)
