"""Spans of regular-expression matches in whole texts, in DataFrame functions only.

A span is struct<s:int, o:int, e:int, kind:string, value:string>: start and end in code points (end
exclusive), o the kind's place in its list. Matches are those of the leftmost non-overlapping search; the
texts between them (`split` by the same pattern) give the positions. Patterns must not match empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<s:int,o:int,e:int,kind:string,value:string>"
SPAN = f"array<{ITEM}>"
CHUNKS = (16384, 128)
BLOCK = 8192


def span(s: Column, o: int | Column, e: Column, kind: str | Column, value: Column) -> Column:
    o = F.lit(o) if isinstance(o, int) else o
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(s.cast("int").alias("s"), o.cast("int").alias("o"), e.cast("int").alias("e"), kind.alias("kind"), value.alias("value"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """struct<state, out>: what a fold over items emits, and the state it ends in.

    step(state, item) gives the next state, a value, and whether it is emitted. An array that grows by one is copied
    whole, and a slice is counted off from the start, so items are folded in chunks of chunks (`CHUNKS`): work is
    about linear in their number. out: type of the values.
    """

    def emitted(state: Column, kind: str) -> Column:
        return F.struct(state.alias("state"), F.array().cast(kind).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new, value, emits = step(acc["state"], x)
        return F.struct(new.alias("state"), F.when(emits, F.array_append(acc["out"], value)).otherwise(acc["out"]).cast(f"array<{out}>").alias("out"))

    def fold(some: Column, state: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.aggregate(some, emitted(state, f"array<{out}>"), one)

        def chunks(some: Column) -> Column:
            def chunk(acc: Column, at: Column) -> Column:
                inner = fold(F.slice(some, at, F.lit(sizes[0])), acc["state"], sizes[1:])
                return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out")))

            starts = F.sequence(F.lit(1), F.greatest(F.size(some), F.lit(1)), F.lit(sizes[0]))
            return F.aggregate(starts, emitted(state, f"array<array<{out}>>"), chunk, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

        return let(some, chunks)

    return fold(items, state, CHUNKS)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, gap>>: matches, each with the text between it and the one before, and a last one without m."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    return F.transform(found, lambda z: F.struct(z["m"].alias("m"), z["gap"].alias("gap")))


def find(text: Column, pattern: str, kind: str, order: int, keep: Callable[[Column], Column] | None = None, cheap: Column | None = None) -> Column:
    """Spans of the pattern's matches that keep() accepts. cheap: a test that texts with a match pass."""

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["m"])
        ok = x["m"].isNotNull() if keep is None else x["m"].isNotNull() & keep(x["m"])
        return F.coalesce(e, s), span(s, order, e, kind, x["m"]), ok

    found = running(matches(text, pattern), F.lit(0), ITEM, step)["out"]
    test = text.rlike(pattern) if cheap is None else cheap & text.rlike(pattern)
    return F.when(test, found).otherwise(F.array().cast(SPAN))


def apart(items: Column, spans: Column, item: str) -> Column:
    """The items (structs with s and e, disjoint and in order; type item) that no span overlaps."""
    places = F.concat(
        F.transform(items, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("of"), x["s"].alias("s"), x.alias("x"))),
        F.transform(spans, lambda x: F.struct(x["s"].alias("at"), F.lit(1).alias("of"), x["e"].alias("s"), F.lit(None).cast(item).alias("x"))),
    )

    def step(reach: Column, p: Column) -> tuple[Column, Column, Column]:  # reach: the furthest end of the spans that begin before here
        return F.when(p["of"] == 1, F.greatest(reach, p["s"])).otherwise(reach), p["x"], (p["of"] == 0) & (reach <= p["s"])

    free = running(F.array_sort(places), F.lit(0), item, step)["out"]
    return F.when((F.size(items) > 0) & (F.size(spans) > 0), free).otherwise(items)


def ordered(*arrays: Column) -> Column:
    return F.array_sort(F.concat(*arrays))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def merged(spans: Column) -> Column:
    """Overlapping spans of a sorted array made one, with the first one's kind."""

    def step(last: Column, x: Column) -> tuple[Column, Column, Column]:
        over = last["e"] > x["s"]
        one = span(last["s"], last["o"], F.greatest(last["e"], x["e"]), last["kind"], last["value"])
        return F.when(over, one).otherwise(x), last, last["s"].isNotNull() & ~F.coalesce(over, F.lit(False))

    done = running(spans, F.lit(None).cast(ITEM), ITEM, step)
    return F.when(F.size(spans) < 2, spans).otherwise(let(done, lambda d: F.array_append(d["out"], d["state"])))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets. It is cut in blocks, so that no place is sought from the start."""

    def cut(blocks: Column, whole: Column) -> Column:
        def block(i: Column) -> Column:
            return F.coalesce(F.try_element_at(blocks, i + 1), F.lit(""))

        def between(s: Column, e: Column) -> Column:
            b, c = F.floor(s / BLOCK).cast("int"), F.floor(e / BLOCK).cast("int")
            across = F.concat(F.substring(block(b), s - b * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, b + 2, F.greatest(c - b - 1, F.lit(0))), ""), F.substring(block(c), F.lit(1), e - c * BLOCK))
            return F.when(b == c, F.substring(block(b), s - b * BLOCK + 1, e - s)).otherwise(across)

        def piece(x: Column, i: Column) -> Column:
            return F.concat(between(F.when(i == 0, 0).otherwise(F.try_element_at(whole, i)["e"]), x["s"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))

        return F.concat(F.array_join(F.transform(whole, piece), ""), between(F.element_at(whole, -1)["e"], F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = let(blocks, lambda b: let(merged(spans), lambda m: cut(b, m)))
    return F.when(F.size(spans) > 0, clean).otherwise(text)
