"""Bridges and their leave-one-row-out errors against refits in numpy."""

from __future__ import annotations

import numpy as np

from mixlume.operators import bridges


def _line(x, z):
    b = 0.0 if np.ptp(x) == 0 else min(0.0, float(np.polyfit(x, z, 1)[0]))
    return z.mean() - b * x.mean(), b


def test_each_row_is_tested_without_itself(spark):
    rng = np.random.default_rng(2)
    groups = {"falls": (rng.uniform(1, 3, 40), -1), "rises": (rng.uniform(1, 3, 30), 1), "few": (np.array([1.0, 2.0, 3.0]), -1), "two": (np.repeat([1.0, 2.0], 5), -1), "one": (np.array([2.0]), -1), "lone": (np.array([1.0, 1, 1, 1, 2, 1.5]), -1), None: (rng.uniform(1, 3, 9), -1)}
    rows = []
    for g, (x, sign) in groups.items():
        s = 100 / (1 + np.exp(-(sign * 1.2 * (x - 2) + 0.2 * rng.normal(size=len(x)))))
        rows += [(g, float(a), float(b)) for a, b in zip(x, s)]
    extra = [("falls", None, 3.0), ("falls", 1.0, None), ("falls", float("nan"), 3.0), ("falls", 2.0, float("inf")), ("falls", 3.0, 0.0), ("falls", 1.0, 100.0)]
    got = {r["g"]: r for r in bridges.leave_one_row_out(spark.createDataFrame(rows + extra, "g string, x double, s double").repartition(5), ["g"], "x", "s").collect()}
    rows += extra[-2:]
    assert got.keys() == groups.keys()
    for g in groups:
        x, s = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        p = np.clip(s / 100, 0.001, 0.999)
        z, r = np.log(p / (1 - p)), got[g]
        a, b = _line(x, z)
        assert r["n"] == len(x) and abs(r["slope"] - b) < 1e-9 and abs(r["intercept"] - a) < 1e-9
        if len(x) < 4 or len(set(x)) < 3:
            assert r["status"] == "insufficient" and r["rmse"] is None
            continue
        errors = []
        for i in range(len(x)):
            keep = np.arange(len(x)) != i
            a, b = _line(x[keep], z[keep])
            errors.append((100 / (1 + np.exp(-(a + b * x[i]))) - s[i], 100 / (1 + np.exp(-z[keep].mean())) - s[i]))
        e, k = np.sqrt(np.mean(np.array(errors) ** 2, axis=0))
        assert abs(r["rmse"] - e) < 1e-8 and abs(r["constant_rmse"] - k) < 1e-8 and abs(r["r2"] - (1 - e * e / s.var())) < 1e-9
        assert r["status"] == ("accepted" if r["slope"] < 0 and e < k else "not_accepted")
    assert got["falls"]["status"] == "accepted" and got["rises"]["slope"] == 0
    df = spark.createDataFrame(rows, "g string, x double, s double")
    assert bridges.leave_one_row_out(df, [], "x", "s").first()["n"] == len(rows)
    assert bridges.leave_one_row_out(df.limit(0), ["g"], "x", "s").count() == 0
