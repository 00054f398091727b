"""Expressions over scores, scales, strata, pins and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard score ranges, tightest first; letter grades; which verdict ends a gate how.
STANDARD_SCALES = [(0.0, 1.0), (-1.0, 1.0), (1.0, 5.0), (0.0, 5.0), (1.0, 10.0), (0.0, 10.0), (0.0, 100.0)]
LETTER_GRADES = {"C": 1.0, "I": 0.0, "P": 0.5, "N": 0.0}
PIN_FIELDS = ["provider", "model", "rubric_hash", "params_hash", "scale"]

MIN_SD = 1e-6


def normalise(raw: Column, lo: Column | float, hi: Column | float) -> Column:
    return (raw - F.lit(lo)) / (F.lit(hi) - F.lit(lo))


def denormalise(score: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.lit(lo) + score * (F.lit(hi) - F.lit(lo))


def suggest_scale(lo: Column, hi: Column) -> Column:
    """The first standard range that holds both, as a struct; null if none does."""
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for a, b in reversed(STANDARD_SCALES):
        out = F.when((lo >= a) & (hi <= b), F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"))).otherwise(out)
    return out


def grade(value: Column) -> Column:
    """A letter grade or a number as a double; null for anything else."""
    letter = F.element_at(F.create_map(*(F.lit(x) for kv in LETTER_GRADES.items() for x in kv)), F.upper(F.trim(value)))
    return F.coalesce(letter, value.try_cast("double"))


def decile(score: Column) -> Column:
    return F.least(F.floor(score * 10).cast("int"), F.lit(9))


def stratum(score: Column, tags: Column) -> Column:
    return F.concat(F.lit("d"), decile(score).cast("string"), F.lit("/"), F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit("-")))


def to_unit(deviation: Column, half_width: Column | float) -> Column:
    return F.least(F.greatest(F.lit(0.5) + deviation / (F.lit(2.0) * half_width), F.lit(0.0)), F.lit(1.0))


def from_unit(unit: Column, half_width: Column | float) -> Column:
    return (unit - 0.5) * 2.0 * half_width


def detection_width(target: float, sd: Column) -> Column:
    return F.greatest(F.lit(target), sd * 4.0)


def estimation_width(target: float, sd: Column) -> Column:
    return F.greatest(F.lit(4.0 * target), sd * 20.0)


def log_mix(a: Column, b: Column, theta: float = 0.5) -> Column:
    """ln(theta e^a + (1 - theta) e^b) without overflow."""
    top = F.greatest(a, b)
    return top + F.ln(theta * F.exp(a - top) + (1.0 - theta) * F.exp(b - top))


def quantise(latent: Column, score_type: str) -> Column:
    clipped = F.least(F.greatest(latent, F.lit(0.0)), F.lit(1.0))
    if score_type == "binary":
        return F.when(clipped >= 0.5, 1.0).otherwise(0.0)
    if score_type == "likert5":
        return F.bround(clipped * 4.0) / 4.0
    return clipped


def differing_fields(pin: Column, reference: Column) -> Column:
    """Names of the pin's fields that differ from the reference's, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~pin[f].eqNullSafe(reference[f]), F.lit(f)) for f in PIN_FIELDS))))


def id_set_hash(ids: Column) -> Column:
    """SHA-256 of the JSON list of sorted ids: the order of arrival doesn't matter."""
    return F.sha2(F.to_json(F.array_sort(ids)), 256)


def exit_code(verdict: Column, fail_on: list[str], warn_on: list[str], refused: Column | None = None) -> Column:
    code = F.when(verdict.isin(*fail_on), 1).when(verdict.isin(*warn_on), 2).otherwise(0)
    return code if refused is None else F.when(refused, 3).otherwise(code)


def first_number(text: Column, lo: float, hi: float) -> Column:
    """The first number in a reply, if it lies on the scale."""
    x = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(x.between(lo, hi), x)


def longest_prefix_price(model: Column, prices: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for prefix in sorted(prices, key=len):
        out = F.when(model.startswith(prefix), F.lit(prices[prefix])).otherwise(out)
    return out


def call_cost(tokens_in: Column, tokens_out: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return tokens_in / 1e6 * per_million_in + tokens_out / 1e6 * per_million_out


VERDICTS = ["stable", "system", "judge", "both", "indeterminate"]


def rule(e: dict[str, Column], min_runs: int, min_obs: int) -> Column:
    """The eight rules in order, first match; e names the evidence columns. Rules 1 and 2 refuse."""
    return (
        F.when(e["pin_changed"], "pin_violation")
        .when(~e["suite_agrees"], "suite_drift")
        .when((e["n_runs"] < min_runs) | (e["last_n"] < min_obs), "insufficient_data")
        .when(e["anchor_crossed"] & e["corrected_crossed"], "both_crossed")
        .when(e["anchor_crossed"], "judge_only")
        .when(e["system_crossed"] & ~e["adequate"], "race_failed")
        .when(e["system_crossed"], "system_only")
        .otherwise("no_crossing")
    )


def verdict_of(rule_id: Column) -> Column:
    """Null where the rule refuses."""
    return (
        F.when(rule_id.isin("insufficient_data", "no_crossing"), "stable")
        .when(rule_id == "both_crossed", "both")
        .when(rule_id == "judge_only", "judge")
        .when(rule_id == "race_failed", "indeterminate")
        .when(rule_id == "system_only", "system")
    )
