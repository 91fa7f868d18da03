"""Calibration of scales and the decay of slopes against numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, poisson_one
from mixlume.operators import transfer

SIZES = {"s": 1e6, "m": 6e7, "l": 1e9}
SCHEMA = "key string, scale string, pa double, ya double, pb double, yb double"
PAIRS = {"a": ("pa", "ya"), "b": ("pb", "yb")}


def _rows(n=60, noise=0.05, sign=1.0):
    rng = np.random.default_rng(3)
    out = []
    for s, size in SIZES.items():
        k = (size / 1e6) ** -0.08
        for i in range(n):
            p, q = rng.normal(5, 1, 2)
            out.append((f"{'' if s != 'l' else 'l/'}{i}", s, float(p), float(1 + 0.9 * k * p + noise * rng.normal()), float(q), float(3 + sign * 0.5 * k * q + noise * rng.normal())))
    return out


def _drawn(spark, keys, reps, seed):
    df = spark.createDataFrame([(k,) for k in sorted(keys)], "key string").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return {(r["key"], r["rep"]): r["w"] for r in df.withColumn("w", poisson_one(hash_uniform(seed, F.col("rep"), F.col("key")))).collect()}


def _fit(p, y, w):
    p, y, w = np.array(p), np.array(y), np.array(w, float)
    if not w.sum() or (w > 0).sum() < 2:
        return None
    mp, my = (w @ p) / w.sum(), (w @ y) / w.sum()
    b = (w @ ((p - mp) * (y - my))) / (w @ (p - mp) ** 2)
    return b, my - b * mp, np.sqrt(w @ (y - my - b * (p - mp)) ** 2 / w.sum()), b * np.sqrt(w @ (p - mp) ** 2 / (w @ (y - my) ** 2))


def test_calibrations_share_draws(spark):
    rows, reps = _rows(25), 12
    extra = [(None, "s", 1.0, 1.0, 1.0, 1.0), ("x", None, 1.0, 1.0, 1.0, 1.0), ("nan", "s", float("nan"), 1.0, 2.0, 9.0), ("inf", "m", 4.0, None, 2.0, float("inf"))]
    df = spark.createDataFrame(rows + extra, SCHEMA).repartition(5)
    got = {(r["scale"], r["target"], r["rep"]): r for r in transfer.calibrations(df, "key", "scale", PAIRS, reps, "t").collect()}
    use = [r for r in rows + extra if r[0] and r[1]]
    w = _drawn(spark, {r[0] for r in use}, reps, "t")
    for s in SIZES:
        for t, at in (("a", 2), ("b", 4)):
            mine = [r for r in use if r[1] == s and r[at] is not None and r[at + 1] is not None and np.isfinite([r[at], r[at + 1]]).all()]
            for rep in range(reps + 1):
                b, a, rmse, pearson = _fit([r[at] for r in mine], [r[at + 1] for r in mine], [1 if not rep else w[r[0], rep] for r in mine])
                r = got[s, t, rep]
                assert abs(r["slope"] - b) < 1e-9 and abs(r["intercept"] - a) < 1e-8 and abs(r["rmse"] - rmse) < 1e-8 and abs(r["pearson"] - pearson) < 1e-9
    out = {(r["scale"], r["target"]): r for r in transfer.intervals(transfer.calibrations(df, "key", "scale", PAIRS, reps, "t"), "scale", reps).collect()}
    slopes = [got["s", "b", k]["slope"] for k in range(1, reps + 1)]
    assert out["s", "b"]["n"] == 26 and out["s", "b"]["invalid"] == sum(x <= 0 for x in slopes) and abs(out["s", "b"]["low"] - np.quantile(slopes, 0.025)) < 1e-9
    assert out["m", "a"]["n"] == 25


def test_decay_recovers_the_planted_one(spark):
    reps = 60
    fits = transfer.calibrations(spark.createDataFrame(_rows(), SCHEMA), "key", "scale", PAIRS, reps, "t").cache()
    slope = {(r["scale"], r["target"], r["rep"]): r["slope"] for r in fits.collect()}
    x = np.array([math.log(v) for v in SIZES.values()])
    xc = x - x.mean()

    def eta(rep, drawn):
        return -sum(xc @ np.log([slope[s, t, rep] for s in SIZES]) for t in drawn) / (len(drawn) * xc @ xc)

    df = spark.range(1, reps + 1).select(F.col("id").alias("rep"), *[F.floor(hash_uniform("d-target", F.col("id"), j) * 2).alias(f"j{j}") for j in range(2)])
    draws = {r["rep"]: ["ab"[r["j0"]], "ab"[r["j1"]]] for r in df.collect()}
    got = {r["drawn"]: r for r in transfer.pooled_decay(fits, "scale", SIZES, ["a", "b"], reps, "d").collect()}
    for kind, at in (("targets", lambda rep: 0), ("targets_and_rows", lambda rep: rep)):
        values = [eta(at(rep), draws[rep]) for rep in range(1, reps + 1)]
        r = got[kind]
        assert r["status"] == "OK" and (r["valid"], r["invalid"]) == (reps, 0)
        assert abs(r["eta"] - eta(0, "ab")) < 1e-9 and abs(r["eta"] - 0.08) < 0.01 and 0.9 < r["r2"] <= 1
        assert np.allclose([r["low"], r["median"], r["high"]], np.quantile(values, [0.025, 0.5, 0.975]), atol=1e-9)
    assert got["targets_and_rows"]["high"] - got["targets_and_rows"]["low"] > got["targets"]["high"] - got["targets"]["low"]
    each = {r["target"]: r["eta"] for r in transfer.target_decays(fits, "scale", SIZES).where("rep = 0").collect()}
    assert abs(each["a"] - eta(0, "a")) < 1e-9 and abs(each["b"] - eta(0, "b")) < 1e-9


def test_invalid_draws_are_counted(spark):
    reps = 20
    fits = transfer.calibrations(spark.createDataFrame(_rows(sign=-1.0), SCHEMA), "key", "scale", PAIRS, reps, "t")
    got = {r["drawn"]: r for r in transfer.pooled_decay(fits, "scale", SIZES, ["a", "b"], reps, "d").collect()}
    for r in got.values():  # target b falls: only draws of a twice are valid
        assert r["status"] == "NOT_POSITIVE" and r["eta"] is None and 0 < r["valid"] < reps / 2 and r["invalid"] == reps - r["valid"] and r["low"] is None
    flat = spark.createDataFrame([(str(i), s, 0.1, float(i), float(i), 2.0) for i in range(5) for s in SIZES], SCHEMA)
    rows = {(r["scale"], r["target"]): r for r in transfer.calibrations(flat, "key", "scale", PAIRS).collect()}
    assert rows["s", "a"]["slope"] is None and rows["s", "b"]["slope"] == 0 and rows["s", "b"]["pearson"] is None
    empty = transfer.calibrations(flat.limit(0), "key", "scale", PAIRS, 3, "t")
    assert empty.count() == 0
    assert [r["status"] for r in transfer.pooled_decay(empty, "scale", SIZES, ["a", "b"], 3, "d").collect()] == ["NOT_POSITIVE"] * 2
