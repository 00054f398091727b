"""Student's t without scipy: cdf by the incomplete beta's continued fraction, quantile by bisection.

`two_sided_p_column` and `quantile_column` are the same as expressions, folds of aggregate() that stay in the JVM.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coefficient / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _fraction(a, b, x) / a
    return 1.0 - front * _fraction(b, a, 1.0 - x) / b


def cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return tail if t < 0 else 1.0 - tail


def two_sided_p(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=4096)
def quantile(p: float, df: float) -> float:
    if not 0.0 < p < 1.0:
        raise ValueError(f"probability must lie inside (0, 1), got {p}")
    if p < 0.5:
        return -quantile(1.0 - p, df)
    lo, hi = 0.0, 1.0
    while cdf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if cdf(mid, df) < p else (lo, mid)
    return 0.5 * (lo + hi)


def dead_zone_factor(k: int, alpha: float, share: float = 0.5) -> float:
    """t quantile over sqrt(K): a snapshot of K runs is known to this many run-mean SDs."""
    if k < 2:
        raise ValueError(f"a frozen snapshot needs at least 2 replicates, got {k}")
    return quantile(1.0 - alpha * share / 2.0, k - 1) / math.sqrt(k)


# Lanczos' coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 0.5 and more."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2.0 * math.pi) + (x - 0.5) * F.ln(t) - t + F.ln(series)


def _fraction_column(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """_fraction, as a fold over its terms."""
    tiny = 1e-300
    whole = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)

    def half(acc: Column, coefficient: Column) -> Column:
        d = 1.0 / whole(1.0 + coefficient * acc["d"])
        return let(F.struct(whole(1.0 + coefficient / acc["c"]).alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (acc["h"] * n["c"] * n["d"]).alias("h")))

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        return let(half(acc, even), lambda one: half(one, odd))

    first = 1.0 / whole(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["h"])


def two_sided_p_column(t: Column, df: Column) -> Column:
    """two_sided_p as an expression; null where t or df is."""

    def side(v: Column) -> Column:
        a = v["df"] / 2.0
        x, rest = v["df"] / (v["df"] + v["t"] * v["t"]), v["t"] * v["t"] / (v["df"] + v["t"] * v["t"])
        turned = x >= (a + 1.0) / (a + 2.5)
        front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.ln(x) + 0.5 * F.ln(rest))
        half = F.lit(0.5)
        return F.struct(F.when(turned, half).otherwise(a).alias("p"), F.when(turned, a).otherwise(half).alias("q"), F.when(turned, rest).otherwise(x).alias("y"), front.alias("front"), turned.alias("turned"))

    def tail(v: Column) -> Column:
        terms = F.least(F.lit(400), F.lit(40) + F.ceil(6.0 * F.sqrt(F.greatest(v["p"], v["q"])))).cast("int")
        got = v["front"] * _fraction_column(v["p"], v["q"], v["y"], terms) / v["p"]
        return F.when(v["turned"], 1.0 - got).otherwise(got)

    known = F.struct(t.cast("double").alias("t"), df.cast("double").alias("df"))
    return F.when(t == 0, 1.0).when(t.isNotNull() & df.isNotNull(), let(let(known, side), tail))


def quantile_column(two_sided: Column, df: Column, steps: int = 12) -> Column:
    """The t > 0 beyond which, on both sides, a share of two_sided lies: Newton's steps on the logarithms of tail and t."""

    def search(v: Column) -> Column:
        constant = log_gamma((v["df"] + 1.0) / 2.0) - log_gamma(v["df"] / 2.0) - 0.5 * F.ln(v["df"] * math.pi)

        begun = F.sqrt(v["df"] * F.expm1(-2.0 * F.ln(v["share"]) / v["df"]))
        bound = F.struct(v["df"].alias("df"), v["share"].alias("share"), constant.alias("constant"), begun.alias("begun"))
        return let(bound, newton)

    def newton(w: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            density = F.exp(w["constant"] - (w["df"] + 1.0) / 2.0 * F.log1p(t * t / w["df"]))
            moved = lambda p: t * F.exp(F.least(F.greatest(F.ln(p / w["share"]) * p / (2.0 * t * density), F.lit(-1.0)), F.lit(1.0)))
            return let(two_sided_p_column(t, w["df"]), moved)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), w["begun"], step)

    known = F.struct(two_sided.cast("double").alias("share"), df.cast("double").alias("df"))
    return F.when(two_sided.isNotNull() & df.isNotNull(), let(known, search))


def dead_factor(k: Column, alpha: Column | float) -> Column:
    """dead_zone_factor as an expression, with alpha a number or a column."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return quantile_column(alpha / 2.0, k - 1.0) / F.sqrt(k)
