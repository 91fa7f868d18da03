"""Spending a budget on size and tokens: the constrained optimum as a column expression, choices over recipes with their regret, free quality, and where along a scan the answer changes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import quality_cost

#: Halvings of the bracket of ln n: far below the precision of a double.
HALVINGS = 60


def quality_price(q: Column, q0: Column | float, family: Column) -> Column:
    """What a token costs more for quality q than for q0 (nothing at or below q0: the kink)."""
    base = q0 if isinstance(q0, Column) else F.lit(float(q0))
    return F.greatest(F.lit(0.0), quality_cost(q, family) - quality_cost(base, family))


def solve(budget: Column, c: Column, h: Column, law: tuple[Column | float, ...], sizes: tuple[float, float], tokens: tuple[float, float], tolerance: float = 1e-8) -> Column:
    """struct(status, n, d, active): the least a n^-alpha + b d^-beta with d (c n + h) <= budget, n in sizes, d in tokens; law: (a, alpha, b, beta).

    The budget gives d for each n, cut at the most tokens; the loss is convex in ln n then, and its slope's sign is bisected. ``active`` names the bounds that the optimum meets, to a relative tolerance ("N_min;budget");
    status is INFEASIBLE where not even the smallest size and fewest tokens can be paid, INVALID for missing or non-positive budgets or negative prices.
    """
    a, alpha, b, beta = (x if isinstance(x, Column) else F.lit(float(x)) for x in law)
    (n_min, n_max), (d_min, d_max) = sizes, tokens
    top = F.least(F.lit(float(n_max)), (budget / d_min - h) / c)

    def slope(x: Column) -> Column:
        n = F.exp(x)
        d = budget / (c * n + h)
        return -alpha * a * F.pow(n, -alpha) + F.when(d >= d_max, 0.0).otherwise(beta * b * F.pow(d, -beta) * c * n / (c * n + h))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        return F.when(slope(middle) < 0, F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    lo, hi = F.ln(F.lit(float(n_min))), F.ln(F.greatest(F.lit(float(n_min)), top))
    bracket = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)
    n = F.when(slope(lo) >= 0, F.lit(float(n_min))).when(slope(hi) <= 0, F.greatest(F.lit(float(n_min)), top)).otherwise(F.exp(bracket))
    invalid = budget.isNull() | F.isnan(budget) | (budget <= 0) | c.isNull() | (c <= 0) | h.isNull() | (h < 0)
    status = F.when(invalid, "INVALID").when(budget < d_min * (c * n_min + h) * (1 - 1e-12), "INFEASIBLE").otherwise("OK")
    found = F.when(status == "OK", n)

    def rest(n: Column) -> Column:
        d = F.greatest(F.lit(float(d_min)), F.least(F.lit(float(d_max)), budget / (c * n + h)))
        near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))
        marks = [(near(n, F.lit(float(n_min))), "N_min"), (near(n, F.lit(float(n_max))), "N_max"), (near(d, F.lit(float(d_min))), "D_min"), (near(d, F.lit(float(d_max))), "D_max"), (near(d * (c * n + h), budget), "budget")]
        return F.struct(status.alias("status"), n.alias("n"), F.when(n.isNotNull(), d).alias("d"), F.when(n.isNotNull(), F.concat_ws(";", *[F.when(m, name) for m, name in marks])).alias("active"))

    return F.element_at(F.transform(F.array(found), rest), 1)  # n is worked out once


STATES = np.array(["OK", "INFEASIBLE", "INVALID"])
MARKS = ["N_min", "N_max", "D_min", "D_max", "budget"]
_ACTIVE = pa.array([";".join(m for k, m in enumerate(MARKS) if code >> k & 1) for code in range(1 << len(MARKS))])


def _found(budget: np.ndarray, c: np.ndarray, h: np.ndarray, law: tuple[Any, ...], sizes: tuple[float, float], tokens: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in STATES, n, d) of solve() for arrays of one length; n and d are NaN where the state isn't OK. Only rows whose optimum lies between the ends of the bracket are halved."""
    law = [np.broadcast_to(np.asarray(x, float), budget.shape) for x in law]
    (n_min, n_max), (d_min, d_max) = sizes, tokens
    missing = np.isnan(budget) | np.isnan(c) | np.isnan(h) | np.isnan(law).any(axis=0)
    with np.errstate(all="ignore"):
        state = np.where(missing | (budget <= 0) | (c <= 0) | (h < 0), 2, np.where(budget < d_min * (c * n_min + h) * (1 - 1e-12), 1, 0))
        top = np.maximum(n_min, np.minimum(n_max, (budget / d_min - h) / c))

        def slope(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            a, alpha, b, beta = (v[at] for v in law)
            paid = c[at] * np.exp(x)
            d = budget[at] / (paid + h[at])
            return -alpha * a * np.exp(-alpha * x) + np.where(d >= d_max, 0.0, beta * b * np.exp(-beta * np.log(d)) * paid / (paid + h[at]))

        n = np.full(budget.shape, np.nan)
        ok = np.flatnonzero(state == 0)
        lo, hi = np.full(len(ok), np.log(n_min)), np.log(top[ok])
        low, high = slope(lo, ok) >= 0, slope(hi, ok) <= 0
        n[ok] = np.where(low, n_min, top[ok])
        inside = ~(low | high)
        ok, lo, hi = ok[inside], lo[inside], hi[inside]
        for _ in range(HALVINGS):
            middle = (lo + hi) / 2
            falls = slope(middle, ok) < 0
            lo, hi = np.where(falls, middle, lo), np.where(falls, hi, middle)
        n[ok] = np.exp((lo + hi) / 2)
        return state, n, np.where(state == 0, np.maximum(d_min, np.minimum(d_max, budget / (c * n + h))), np.nan)


def _doubles(x: pa.Array) -> np.ndarray:
    """Its numbers; NaN for missing ones."""
    return x.to_numpy(zero_copy_only=False).astype(float, copy=False)


def solved(budget: Column, c: Column, h: Column, law: tuple[Column | float, ...], sizes: tuple[float, float], tokens: tuple[float, float], tolerance: float = 1e-8) -> Column:
    """solve() for whole batches: the same halvings over arrays, for tables of many rows (an expression of lambdas is interpreted for every halving of every row). Missing parts of the law are INVALID, too."""
    (n_min, n_max), (d_min, d_max) = sizes, tokens
    sent = [k for k, x in enumerate(law) if isinstance(x, Column)]
    fixed = [None if isinstance(x, Column) else float(x) for x in law]

    @F.arrow_udf("status string, n double, d double, active string")
    def run(*columns: pa.Array) -> pa.Array:
        budget, c, h, *own = (_doubles(x) for x in columns)
        known: list[Any] = list(fixed)
        for k, x in zip(sent, own):
            known[k] = x
        state, n, d = _found(budget, c, h, tuple(known), sizes, tokens)
        with np.errstate(all="ignore"):
            near = lambda x, y: np.abs(x - y) <= tolerance * np.maximum(np.abs(x), np.abs(y))
            code = sum(m.astype(int) << k for k, m in enumerate((near(n, n_min), near(n, n_max), near(d, d_min), near(d, d_max), near(d * (c * n + h), budget))))
        none = state != 0
        figures = [pa.array(STATES[state]), pa.array(n, mask=none), pa.array(d, mask=none), _ACTIVE.take(pa.array(code, mask=none))]
        return pa.StructArray.from_arrays(figures, ["status", "n", "d", "active"])

    return run(budget.cast("double"), c.cast("double"), h.cast("double"), *[law[k].cast("double") for k in sent])


def bounded_optimum(scenarios: DataFrame, law: tuple[float, ...], sizes: tuple[float, float], tokens: tuple[float, float], attention: float = 0.1) -> DataFrame:
    """scenarios (budget, context) with status, n, d, active, loss, slack: spending is (6 + attention * context) n d; slack where even the largest size and most tokens leave budget."""
    e, a, alpha, b, beta = law
    c = 6 + attention * F.col("context")
    x = scenarios.withColumn("_x", solved(F.col("budget"), c, F.lit(0.0), (a, alpha, b, beta), sizes, tokens)).select("*", "_x.*").drop("_x")
    loss = e + a * F.pow("n", F.lit(-alpha)) + b * F.pow("d", F.lit(-beta))
    return x.withColumn("loss", loss).withColumn("slack", c * F.col("n") * F.col("d") < F.col("budget") * (1 - 1e-9))


def allocate(recipes: DataFrame, scenarios: list[dict], law: tuple[float, ...], sizes: tuple[float, float], tokens: tuple[float, float], attention: float, bridge: float) -> DataFrame:
    """A row for each recipe (idx, q, effect) and scenario (budget, context, family, q0): status, n, d, active, loss.

    Loss is (e + a n^-alpha + b d^-beta exp(-gamma q)) exp(bridge * effect): quality lowers the part of the tokens, the recipe's own effect scales all. A recipe below q0 has BELOW_Q0. Scenarios
    are a parameter list that each row is exploded by.
    """
    e, a, alpha, b, beta, gamma = law
    each = F.array(*[F.struct(*[F.lit(float(s[k])).alias(k) for k in ("budget", "context", "q0")], F.lit(s["family"]).alias("family")) for s in scenarios])
    x = recipes.select("idx", "q", "effect", F.inline(each))
    weight = b * F.exp(-gamma * F.col("q"))
    found = solved(F.col("budget"), 6 + attention * F.col("context"), quality_price(F.col("q"), F.col("q0"), F.col("family")), (a, alpha, weight, beta), sizes, tokens)
    below = F.col("q") < F.col("q0") - 1e-12
    x = x.withColumn("_x", F.when(~below, found)).select("*", F.when(F.col("q").isNull(), "INVALID").when(below, "BELOW_Q0").otherwise(F.col("_x.status")).alias("status"), "_x.n", "_x.d", "_x.active").drop("_x")
    loss = (F.lit(e) + a * F.pow("n", F.lit(-alpha)) + weight * F.pow("d", F.lit(-beta))) * F.exp(bridge * F.col("effect"))
    return x.withColumn("loss", loss)


KEYS = ["budget", "context", "family", "q0"]


def best_recipe(allocated: DataFrame, fixed: int) -> DataFrame:
    """A row for each scenario: status, how many recipes it leaves, the best (idx; ties to 12 digits go to the smaller), its n, d, q, active set and loss, and what staying with the ``fixed`` recipe loses."""
    ok = F.col("status") == "OK"
    key = F.when(ok, F.struct(F.round("loss", 12), F.col("idx")))
    own = F.col("idx") == fixed
    g = allocated.groupBy(*KEYS).agg(
        F.count_if(F.col("status").isin("OK", "INFEASIBLE")).alias("eligible"), F.count_if(ok).alias("feasible"), F.min_by(F.struct("idx", "n", "d", "q", "active", "loss"), key).alias("_b"),
        F.max(F.when(own, F.col("status"))).alias("fixed_status"), F.max(F.when(own & ok, F.col("loss"))).alias("fixed_loss"),
    )
    best = lambda c: F.when(F.col("feasible") > 0, F.col(f"_b.{c}")).alias(c)
    status = F.when(F.col("feasible") > 0, "OK").when(F.col("eligible") > 0, "INFEASIBLE").otherwise("NO_ELIGIBLE_RECIPE")
    return g.select(*KEYS, status.alias("status"), "eligible", "feasible", *[best(c) for c in ("idx", "n", "d", "q", "active", "loss")], "fixed_status", (F.col("fixed_loss") - best("loss")).alias("regret"))


_COSTS = {"exp": lambda q: np.exp(q) - 1, "power": lambda q: q * q, "log": np.log1p}


def free_quality(scenarios: DataFrame, law: tuple[float, ...], sizes: tuple[float, float], tokens: tuple[float, float], attention: float, points: int = 17, passes: int = 5) -> DataFrame:
    """scenarios (budget, context, family, q0) with status, q, n, d, loss: quality between q0 and 1 is chosen, too, on a grid that zooms in around its best point. A batch's grids are worked out as arrays."""
    e, a, alpha, b, beta, gamma = law

    @F.arrow_udf("status string, q double, n double, d double, loss double")
    def run(budget: pa.Array, context: pa.Array, family: pa.Array, q0: pa.Array) -> pa.Array:
        budget, context, q0 = _doubles(budget), _doubles(context), _doubles(q0)
        families = np.array(family.to_pylist(), object)
        width, rows = (len(budget), points), np.arange(len(budget))
        wide = lambda x: np.broadcast_to(x[:, None], width).ravel()
        lo, hi = q0, np.ones(len(budget))
        for _ in range(passes):
            step = (hi - lo) / (points - 1)
            q = lo[:, None] + (hi - lo)[:, None] * np.arange(points) / (points - 1)
            price = np.zeros(width)
            for name, cost in _COSTS.items():
                own = families == name
                price[own] = np.maximum(0.0, cost(q[own]) - cost(q0[own])[:, None])
            weight = (b * np.exp(-gamma * q)).ravel()
            state, n, d = _found(wide(budget), wide(6 + attention * context), price.ravel(), (a, alpha, weight, beta), sizes, tokens)
            loss = np.where(state == 0, e + a * n**-alpha + weight * d**-beta, np.inf).reshape(width)
            at = rows, np.argmin(loss, axis=1)
            best = [x.reshape(width)[at] for x in (state, q, n, d, loss)]
            lo, hi = np.maximum(q0, best[1] - step), np.minimum(1.0, best[1] + step)
        figures = [pa.array(x, mask=best[0] != 0) for x in best[1:]]
        return pa.StructArray.from_arrays([pa.array(STATES[best[0]]), *figures], ["status", "q", "n", "d", "loss"])

    figures = run(*[F.col(c).cast("double") for c in ("budget", "context")], F.col("family"), F.col("q0").cast("double"))
    return scenarios.withColumn("_best", figures).select(*scenarios.columns, "_best.*")


def transitions(rows: DataFrame, left: Column, right: Column, state: Callable[[Column], Column], width: float, points: int = 161) -> DataFrame:
    """A row for each place between left and right where the state changes: rows' columns, lo, hi (narrower than ``width``), from_state, to_state, in order of lo.

    ``points`` states find brackets; a bracket is halved, and kept on either side on which the middle's state differs, so one bracket may lead to several changes. States that last for less than a
    step and come back to the one before aren't seen. All work is inside the row.
    """
    null = "NULL"
    known = lambda x: F.coalesce(state(x), F.lit(null))
    at = lambda k: left + (right - left) * k / (points - 1)
    scan = rows.withColumn("_s", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(at(k).cast("double").alias("x"), known(at(k)).alias("s"))))
    pairs = F.zip_with(F.slice("_s", 1, points - 1), F.slice("_s", 2, points - 1), lambda p, q: F.struct(p["x"].alias("lo"), q["x"].alias("hi"), p["s"].alias("a"), q["s"].alias("b")))
    found = scan.withColumn("_w", F.filter(pairs, lambda x: x["a"] != x["b"])).drop("_s")

    def split(x: Column) -> Column:
        wide = (x["hi"] - x["lo"]) > width
        middle = (x["lo"] + x["hi"]) / 2

        def parts(s: Column) -> Column:
            low, high = F.struct(x["lo"].alias("lo"), middle.alias("hi"), x["a"].alias("a"), s.alias("b")), F.struct(middle.alias("lo"), x["hi"].alias("hi"), s.alias("a"), x["b"].alias("b"))
            return F.when(~wide, F.array(x)).otherwise(F.filter(F.array(low, high), lambda y: y["a"] != y["b"]))

        return F.flatten(F.transform(F.array(known(middle)), parts))  # the middle's state is worked out once

    halved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.col("_w"), lambda w, _: F.when(F.exists(w, lambda x: (x["hi"] - x["lo"]) > width), F.flatten(F.transform(w, split))).otherwise(w))
    out = found.withColumn("_t", F.explode(halved)).drop("_w")
    missing = lambda c: F.nullif(F.col(c), F.lit(null))
    return out.select(*rows.columns, "_t.lo", "_t.hi", missing("_t.a").alias("from_state"), missing("_t.b").alias("to_state"))


def move_contrasts(recipes: DataFrame, domains: list[str], loss: Callable[[dict[str, Column]], Column], donor: str, pairs: list[tuple[str, str]], steps: list[float], tolerance: float = 1e-10) -> DataFrame:
    """A row for each recipe, pair of domains and step: what moving ``step`` of the donor's share to the first domain, to the second, and to both does to the loss, and how the joint effect
    differs from the sum (contrast): COMPLEMENTARY below zero, SUBSTITUTIVE above, NEUTRAL within the tolerance; DONOR_SHORT without figures where the donor can't give both steps."""

    def moved(left: str, right: str, step: float, on: tuple[bool, bool]) -> Column:
        share = {m: F.col(m) for m in domains}
        for name, active in zip((left, right), on):
            if active:
                share[name], share[donor] = share[name] + step, share[donor] - step
        return loss(share)

    cases = []
    for left, right in pairs:
        for step in steps:
            l00, l10, l01, l11 = (moved(left, right, step, on) for on in ((False, False), (True, False), (False, True), (True, True)))
            short = F.col(donor) < 2 * step
            cases.append(F.struct(F.lit(left).alias("left_domain"), F.lit(right).alias("right_domain"), F.lit(float(step)).alias("step"), *[F.when(~short, v).alias(k) for k, v in (("delta_left", l10 - l00), ("delta_right", l01 - l00), ("delta_joint", l11 - l00), ("contrast", l11 - l10 - l01 + l00))], short.alias("_short")))
    out = recipes.select("idx", F.inline(F.array(*cases)))
    label = F.when(F.col("_short"), "DONOR_SHORT").when(F.col("contrast") < -tolerance, "COMPLEMENTARY").when(F.col("contrast") > tolerance, "SUBSTITUTIVE").otherwise("NEUTRAL")
    return out.withColumn("label", label).drop("_short")
