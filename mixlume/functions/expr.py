"""Column helpers. Missing is a state: every helper keeps NULL as NULL and turns NaN or infinity into NULL first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and ±infinity."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def all_finite(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)) | x.isNull())


def expected_class(v: Column) -> Column:
    """Mean class index under the softmax of the logits; a vector of one is its own score; NULL if an element is missing."""
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.transform(e, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x) / total
    return F.when(all_finite(v), F.when(F.size(v) == 1, v[0].cast("double")).otherwise(mean))


def argmax_class(v: Column) -> Column:
    """Index of the largest logit, the first of equal ones; a vector of one is its own score; NULL if an element is missing."""
    return F.when(all_finite(v), F.when(F.size(v) == 1, v[0].cast("double")).otherwise((F.array_position(v, F.array_max(v)) - 1).cast("double")))


def log_count(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def mean_present(columns: list[Column]) -> Column:
    """Mean of those that aren't NULL; NULL if none is."""
    number = total([c.isNotNull().cast("int") for c in columns])
    return F.when(number > 0, total([F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns]) / number)


def bounded_logit(s: Column, floor: float = 0.001) -> Column:
    """Logit of a score from 0 to 100, kept ``floor`` away from both ends."""
    p = F.when(s.isNotNull(), F.least(F.greatest(s / 100, F.lit(floor)), F.lit(1 - floor)))
    return F.ln(p / (1 - p))


def score_of_logit(z: Column) -> Column:
    return 100 / (1 + F.exp(-z))


def number(s: Column) -> Column:
    """Text to double: blank or garbage is NULL, "0" is 0."""
    return finite(F.trim(s).try_cast("double"))


def hash_uniform(*parts: Column | int | str) -> Column:
    """A uniform number in [0, 1) from a SHA-256 of the parts: the same in any partitioning, and in any SQL engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / float(2**48)


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number, up to 6."""
    out, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(6):
        total += p
        out = out + (u >= total).cast("int")
        p /= k + 1
    return out


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def quality_cost(q: Column, family: Column) -> Column:
    """Cost of quality q: exp e^q - 1, power q^2, log ln(1 + q)."""
    return F.when(family == "exp", F.exp(q) - 1).when(family == "power", q * q).when(family == "log", F.log1p(q))
