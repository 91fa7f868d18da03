"""Refitted interaction models against numpy."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform
from mixlume.operators import extensions, refits

D, T = ["a", "b", "c", "d"], ["u", "v"]
SCHEMA = "id long, a double, b double, c double, d double, u double, v double, ok boolean"


def _rows(n=83):
    rng = np.random.default_rng(8)
    x = rng.dirichlet([1, 2, 3, 1], n)
    u = 2 + x[:, 0] - 3 * x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=n)
    v = 3 - x[:, 3] + 0.1 * rng.normal(size=n)
    return [(int(k) * 3, *map(float, x[k]), float(u[k]), float(v[k]), bool(k % 2)) for k in range(n)]


def _ridge(z, y, alpha):
    m = z.mean(axis=0)
    b = np.linalg.solve((z - m).T @ (z - m) + alpha * np.eye(z.shape[1]), (z - m).T @ (y - y.mean()))
    return y.mean() - m @ b, b


def _model(x, y, fold, varied=3):
    at = sorted(np.argsort(-x.var(axis=0), kind="stable")[:varied])
    make = lambda x: np.column_stack([x, *[x[:, i] * x[:, j] for i, j in combinations(at, 2)]])
    z, out = make(x), []
    for t in range(y.shape[1]):
        score = []
        for alpha in refits.ALPHAS:
            errors = []
            for f in range(5):
                a, b = _ridge(z[fold != f], y[fold != f, t], alpha)
                errors.append(np.sqrt(np.mean((a + z[fold == f] @ b - y[fold == f, t]) ** 2)))
            score.append(np.mean(errors))
        k = int(np.argmin(score))
        out.append((refits.ALPHAS[k], score[k], *_ridge(z, y[:, t], refits.ALPHAS[k])))
    return at, make, out


def test_refits_and_choices(spark):
    rows, reps = _rows(), 4
    bad = [(None, 0.1, 0.2, 0.3, 0.4, -9.0, -9.0, True), (7, None, 0.2, 0.3, 0.4, -9.0, -9.0, True), (8, 0.1, 0.2, 0.3, float("nan"), -9.0, -9.0, True)]
    df = spark.createDataFrame(rows + bad, SCHEMA).repartition(6)
    fitted = refits.fits(df, "id", D, T, reps, varied=3).cache()
    got = {(r["rep"], r["target"]): r for r in fitted.collect()}
    keys, x, y = np.array([r[0] for r in rows]), np.array([r[1:5] for r in rows]), np.array([r[5:7] for r in rows])
    fold = np.repeat(np.arange(5), [17, 17, 17, 16, 16])
    u = {(r["id"], r["rep"]): r["u"] for r in spark.createDataFrame([(int(k),) for k in keys], "id long").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("u", hash_uniform("refit", F.col("rep"), F.col("id"))).collect()}
    models = {}
    for rep in range(reps + 1):
        inside = np.ones(len(keys), bool) if not rep else np.isin(keys, sorted(keys, key=lambda k: u[int(k), rep])[: int(0.8 * len(keys))])
        at, make, out = models[rep] = _model(x[inside], y[inside], fold[inside])
        for t, (alpha, score, a, b) in zip(T, out):
            r = got[rep, t]
            assert r["alpha"] == alpha and abs(r["cv_rmse"] - score) < 1e-9 and r["varied"] == [D[j] for j in at]
            assert np.allclose(r["beta"], [a, *b], atol=1e-7) and np.allclose(r["center"], x[inside].mean(axis=0))
    policies = {"all": ("mean", F.lit(True)), "ok": ("mean", F.col("ok")), "worst": ("max", F.lit(True)), "none": ("mean", F.lit(False))}
    found = refits.choices(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", D, T, fitted, policies)
    chosen = {(r["rep"], r["policy"]): r for r in found.collect()}
    assert len(chosen) == reps * 3

    def score(rep, kind):
        center, (_, make, out) = np.array(got[rep, "u"]["center"])[None], models[rep]
        rel = np.column_stack([(a + make(x) @ b) / (a + make(center) @ b) - 1 for _, _, a, b in out])
        return np.round(rel.mean(axis=1) if kind == "mean" else rel.max(axis=1), 9)

    ok = np.array([r[7] for r in rows])
    for p, (kind, allowed) in {"all": ("mean", ok | True), "ok": ("mean", ok), "worst": ("max", ok | True)}.items():
        ids = np.flatnonzero(allowed)
        base = ids[score(0, kind)[ids].argmin()]
        for rep in range(1, reps + 1):
            s, r = score(rep, kind), chosen[rep, p]
            i = ids[s[ids].argmin()]
            assert (r["pick"], r["frozen_pick"], r["same"]) == (keys[i], keys[base], i == base)
            assert abs(r["refit_regret"] - (s[base] - s[i])) < 1e-8 and abs(r["frozen_regret"] - (score(0, kind)[i] - score(0, kind)[base])) < 1e-8
    total = {r["policy"]: r for r in refits.summary(found).collect()}
    assert total["all"]["repeats"] == reps and abs(total["all"]["max_regret"] - max(chosen[k, "all"]["refit_regret"] for k in range(1, reps + 1))) < 1e-12
    terms = [r["term"] for r in refits.coefficients(fitted, D).where("rep = 0 and target = 'u'").collect()]
    at = models[0][0]
    assert terms == ["intercept", *D, *[f"{D[i]}_x_{D[j]}" for i, j in combinations(at, 2)]]


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    fitted = refits.fits(empty, "id", D, T, 2)
    assert fitted.count() == 0
    assert refits.choices(empty, "id", D, T, fitted, {"all": ("mean", F.lit(True))}).count() == 0


def test_nested_panel(spark):
    rows = _rows(90)
    models = {"plain": ["a", "b", "c"], "more": ["a", "b", "c", "bc"]}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("bc", F.col("b") * F.col("c"))
    inner = {r["id"]: int(r["u"] * 5) for r in df.withColumn("u", hash_uniform("inner", F.col("id"))).select("id", "u").collect()}
    panel = extensions.nested_panel(df, "id", models, T, (0.001, 0.1))
    got = {(r["target"], r["outer"], r["model"]): r for r in panel.collect()}
    assert len(got) == 2 * 5 * 2
    x, y = np.array([r[1:4] for r in rows]), np.array([r[5:7] for r in rows])
    z = {"plain": x, "more": np.column_stack([x, x[:, 1] * x[:, 2]])}
    fold, i = np.repeat(np.arange(5), 18), np.array([inner[r[0]] for r in rows])
    for t, target in enumerate(T):
        for o in range(5):
            best = {}
            for m in models:
                errors = []
                for alpha in (0.001, 0.1):
                    e = 0.0
                    for k in set(i[fold != o]):
                        a, b = _ridge(z[m][(fold != o) & (i != k)], y[(fold != o) & (i != k), t], alpha)
                        at = (fold != o) & (i == k)
                        e += ((a + z[m][at] @ b - y[at, t]) ** 2).sum()
                    errors.append(e)
                k = int(np.argmin(errors))
                a, b = _ridge(z[m][fold != o], y[fold != o, t], (0.001, 0.1)[k])
                r = got[target, o, m]
                assert r["alpha"] == (0.001, 0.1)[k] and abs(r["inner_sse"] - errors[k]) < 1e-8
                assert abs(r["rmse"] - np.sqrt(np.mean((a + z[m][fold == o] @ b - y[fold == o, t]) ** 2))) < 1e-8
                best[m] = errors[k]
            assert [m for m in models if got[target, o, m]["chosen"]] == [min(models, key=best.get)]
    out = {(r["target"], r["model"]): r for r in extensions.compare_models(panel).collect()}
    assert out["u", "more"]["folds"] == 5 and out["u", "more"]["wins"] + out["u", "plain"]["wins"] == 5
    assert out["u", "more"]["median_rmse"] == np.median([got["u", o, "more"]["rmse"] for o in range(5)]) and out["u", "more"]["median_rmse"] < out["u", "plain"]["median_rmse"]
    assert extensions.nested_panel(df.limit(0), "id", models, T, (0.1,)).count() == 0
