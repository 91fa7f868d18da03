"""Quality families, folds and increments of scaling laws: planted parameters, least squares redone in numpy, and a constraint that binds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlume.operators import budget, laws

def axes():
    return {"n_level": F.col("n"), "d_level": F.col("d"), "q_level": F.col("q")}


def grid(noise=0.0, gain=0.4, seed=1):
    rng = np.random.default_rng(seed)
    return [(float(n), float(d), q, 1.2 + 2 * n**-0.35 + 1.5 * d**-0.55 + gain * (1 - q) + noise * rng.normal()) for n in (0.1, 0.5, 2, 8, 30) for d in (1, 5, 25, 125) for q in (0.2, 0.5, 0.8, 1.0)]


def design(x, alpha, beta, family):
    n, d, q = x[:, 0], x[:, 1], x[:, 2]
    return np.column_stack([np.ones(len(n)), n**-alpha, d**-beta, *([1 - q] if family == "linear" else [-np.log(q)] if family == "log" else [])])


def test_families_recover_planted_exponents(spark):
    points = spark.createDataFrame(grid(), "n double, d double, q double, y double")
    fits, scores = laws.family_panel(points, axes())
    full = {r["family"]: r for r in fits.where("axis = 'full'").collect()}
    r = full["linear"]
    assert abs(r["alpha"] - 0.35) < 1e-3 and abs(r["beta"] - 0.55) < 1e-3 and abs(r["g"] - 0.4) < 1e-3 and r["rmse"] < 1e-4 and r["train_rows"] == 80
    assert [x["family"] for x in scores.where("selected").collect()] == ["linear"]
    assert fits.groupBy("family").count().where("count = 14").count() == 3  # 5 + 4 + 4 held levels and the full fit


def test_each_fold_is_the_least_squares_fit_of_its_training_rows(spark):
    rows = np.array(grid(0.02))
    points = spark.createDataFrame([tuple(map(float, r)) for r in rows], "n double, d double, q double, y double").repartition(3)
    for f in laws.fit_folds(points, ["none", "linear", "log"], axes()):
        if f["status"] == "NO_POSITIVE_FIT":
            continue
        held = np.zeros(len(rows), bool) if f["axis"] == "full" else rows[:, "ndq".index(f["axis"][0])] == float(f["level"])
        train, test = rows[~held], rows[held] if held.any() else rows
        assert f["train_rows"] == len(train) and f["test_rows"] == len(test)

        def sse(alpha, beta, train=train, f=f):
            m = design(train, alpha, beta, f["family"])
            x = np.linalg.lstsq(m, train[:, 3], rcond=None)[0]
            return ((m @ x - train[:, 3]) ** 2).sum(), x

        value, x = sse(f["alpha"], f["beta"])
        assert np.allclose(x, [f["e"], f["a"], f["b"], *([f["g"]] if f["g"] is not None else [])], rtol=1e-3)
        assert abs(f["rmse"] - np.sqrt(((design(test, f["alpha"], f["beta"], f["family"]) @ x - test[:, 3]) ** 2).mean())) < 1e-5
        if f["status"] == "OK":
            around = [sse(f["alpha"] * s, f["beta"] * t) for s in (0.99, 1, 1.01) for t in (0.99, 1, 1.01)]
            assert value <= min(v for v, beta in around if (beta > 0).all()) * (1 + 1e-6)


def test_replicates_draw_whole_clusters(spark):
    points = spark.createDataFrame(grid(0.01), "n double, d double, q double, y double")
    fits = [f for f in laws.fit_folds(points, ["linear"], {}, reps=8, cluster=F.concat_ws("/", "n", "d")) if f["axis"] == "replicate" and f["status"] == "OK"]
    again = [f for f in laws.fit_folds(points.repartition(5), ["linear"], {}, reps=8, cluster=F.concat_ws("/", "n", "d")) if f["axis"] == "replicate" and f["status"] == "OK"]
    assert len(fits) >= 6 and len({round(f["alpha"], 4) for f in fits}) > 3
    assert sorted(round(f["e"], 6) for f in fits) == sorted(round(f["e"], 6) for f in again)


def test_laws_without_a_fit(spark):
    falling = spark.createDataFrame([(r[0], r[1], r[2], 5 - r[3]) for r in grid()], "n double, d double, q double, y double")
    assert {f["status"] for f in laws.fit_folds(falling, ["none"], {})} == {"NO_POSITIVE_FIT"}
    assert laws.fit_folds(falling.limit(0), ["none"], {}) == []
    with pytest.raises(ValueError, match="levels"):
        laws.fit_folds(spark.range(1200).select(F.col("id").cast("double").alias("y"), F.lit(1.0).alias("n"), F.lit(1.0).alias("d"), F.col("id").alias("k")), ["none"], {"k": F.col("k")})


CORNERS = np.array([[1.0, np.log(n), np.log(d / 100)] for n in (0.1, 30) for d in (1, 125)])


def constrained(z, y, ridge, least=1e-8):
    """By penalty: gradient steps on the squared violation, ever harder."""
    h, c = z.T @ z + np.diag([0, ridge, ridge]), z.T @ y
    x = np.linalg.solve(h, c)
    for k in range(6, 13):
        for _ in range(60):
            bad = CORNERS[CORNERS @ x < least]
            x = np.linalg.solve(h + 10.0**k * bad.T @ bad, c + 10.0**k * bad.T @ np.full(len(bad), least))
    return x


@pytest.mark.parametrize("tilt", [0.0, 0.3])
def test_quality_increment(spark, tilt):
    rng = np.random.default_rng(5)
    rows = [(n, d, q, 1.0 + (1 - q) * (0.3 + tilt * np.log(n) - 0.02 * np.log(d / 100)) + 0.01 * rng.normal()) for n, d, q, _ in grid()]
    x = np.array(rows)
    points = spark.createDataFrame([tuple(map(float, r)) for r in rows], "n double, d double, q double, y double").repartition(3)
    ridges = (0.0, 0.1, 10.0)
    got = {(r["axis"], r["level"]): r for r in laws.quality_increment(points, F.lit(1.0), ridges, {"n_level": F.col("n"), "d_level": F.col("d")}, (0.1, 30.0), (1.0, 125.0)).collect()}
    z, y = (1 - x[:, 2])[:, None] * np.column_stack([np.ones(len(x)), np.log(x[:, 0]), np.log(x[:, 1] / 100)]), x[:, 3] - 1.0

    def fit(rows, ridge):
        g = np.linalg.solve(z[rows].T @ z[rows] + np.diag([0, ridge, ridge]), z[rows].T @ y[rows])
        return g if (CORNERS @ g).min() >= 1e-8 else constrained(z[rows], y[rows], ridge)

    rmse = lambda rows, g: float(np.sqrt(((z[rows] @ g - y[rows]) ** 2).mean()))
    assert len(got) == 10
    for (axis, level), r in got.items():
        column = {"n_level": 0, "d_level": 1}.get(axis)
        outer = np.zeros(len(x), bool) if column is None else x[:, column] == float(level)
        scores = {}
        for ridge in ridges:
            inner = [(k, v) for k in ((0, 1) if column is None else (column,)) for v in np.unique(x[:, k]) if not (x[outer, k] == v).any()]
            scores[ridge] = np.mean([rmse(x[:, k] == v, fit(~outer & (x[:, k] != v), ridge)) for k, v in inner])
        best = min(ridges, key=lambda s: (round(scores[s], 12), s))
        assert r["ridge"] == best or abs(scores[r["ridge"]] - scores[best]) < 1e-7
        g = fit(~outer, r["ridge"])
        assert np.allclose([r["g0"], r["g1"], r["g2"]], g, atol=2e-5)
        assert abs(r["rmse"] - rmse(outer if outer.any() else ~outer, g)) < 1e-5
        assert (CORNERS @ [r["g0"], r["g1"], r["g2"]]).min() > -1e-8 and r["active"] == bool((CORNERS @ g).min() < 2e-7)
    assert got["full", "all"]["active"] == (tilt > 0)
    assert laws.quality_increment(points.limit(0), F.lit(1.0), ridges, {}, (0.1, 30.0), (1.0, 125.0)).count() == 0


def test_held_out_sizes_and_token_tail(spark):
    rows = [(n, d, 1.2 + 2 * n**-0.35 + 1.5 * d**-0.55) for n in (0.1, 0.5, 2.0, 8.0, 30.0) for d in (1.0, 2.0, 5.0, 12.0, 25.0, 60.0, 125.0, 300.0)]
    points = spark.createDataFrame(rows, "n double, d double, loss double")
    got = {(r["axis"], r["level"]): r for r in budget.validate_classic(points).collect()}
    assert {k for k, _ in got} == {"size", "tail", "full"} and len(got) == 7
    assert all(r["status"] == "OK" and r["rmse"] < 1e-3 and abs(r["alpha"] - 0.35) < 2e-3 for r in got.values())
    assert got["tail", "tail"]["train_rows"] == 25 and got["tail", "tail"]["test_rows"] == 15
