"""Selection under weightings against numpy; bridged losses against differences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlume.operators import allocation, selection


def test_gamma_draws_follow_their_law(spark):
    for shape in (0.2, 0.7, 1, 5):
        g = np.array([r[0] for r in spark.range(4000).select(selection.gamma_draw(shape, "law", F.col("id"))).collect()])
        assert (g > 0).all() and abs(g.mean() - shape) < 5 * np.sqrt(shape / 4000) and abs(g.var() / shape - 1) < 0.35
    with pytest.raises(ValueError):
        selection.gamma_draw(1.5, "law")


def test_scenarios_are_weights(spark):
    rows = selection.weight_scenarios(spark, ["a", "b", "c"], draws=50).collect()
    assert len({r["scenario"] for r in rows}) == len(rows) == 1 + 3 + 100
    w = {r["scenario"]: np.array(r["w"]) for r in rows}
    assert all(abs(x.sum() - 1) < 1e-12 and (x >= 0).all() for x in w.values()) and w["only_b"].tolist() == [0, 1, 0]
    top = {kind: np.mean([x.max() for s, x in w.items() if s.startswith(kind)]) for kind in ("sparse", "balanced")}
    assert top["sparse"] > 0.75 > 0.6 > top["balanced"]


def test_best_rows(spark):
    rng = np.random.default_rng(4)
    y = np.round(rng.random((500, 3)), 1)  # many ties
    z = np.round(rng.random((500, 3)), 1)
    rows = [(int(k), *map(float, y[k]), *map(float, z[k]), bool(k % 3)) for k in range(500)]
    rows += [(None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True), (900, None, 0.0, 0.0, 0.0, 0.0, 0.0, True), (901, 0.0, float("nan"), 0.0, 9.0, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, f double, ok boolean").repartition(7)
    weights = [(r["scenario"], list(r["w"])) for r in selection.weight_scenarios(spark, ["a", "b", "c"], draws=4).collect()]
    models = {"one": [F.col(x) for x in "abc"], "two": [F.col(x) for x in "def"]}
    policies = {"all": F.lit(True), "ok": F.col("ok"), "none": F.lit(False)}
    picks = selection.best_rows(df, "id", models, policies, weights)
    got = {(r["scenario"], r["policy"], r["model"]): (r["pick"], r["objective"], r["feasible"]) for r in picks.collect()}
    expected = {}
    for s, w in weights:
        for m, cols in (("one", slice(1, 4)), ("two", slice(4, 7))):
            for p in ("all", "ok"):
                found = [(round(float(np.array(r[cols]) @ w), 9), r[0]) for r in rows if r[0] is not None and None not in r[cols] and not np.isnan(r[cols]).any() and (p == "all" or r[7])]
                expected[s, p, m] = (min(found)[1], min(found)[0], len(found))
    assert got.keys() == expected.keys()
    assert all(got[k][0] == expected[k][0] and abs(got[k][1] - expected[k][1]) < 1e-8 and got[k][2] == expected[k][2] for k in got)
    out = {r["policy"]: r for r in selection.stability(picks, "one", "two").collect()}
    for p in ("all", "ok"):
        a, b = ({s: got[s, p, m][0] for s, _ in weights} for m in ("one", "two"))
        assert out[p]["scenarios"] == len(weights) and abs(out[p]["agreement"] - np.mean([a[s] == b[s] for s in a])) < 1e-12
        assert out[p]["flips_one"] == sum(x != a["equal"] for x in a.values()) and out[p]["picks_two"] == len(set(b.values()))
    assert selection.best_rows(df.limit(0), "id", models, policies, weights).count() == 0


def test_bridged_loss_against_differences(spark):
    law = (1.05, 2.5, 0.9, 0.1, 0.3, 0.4)
    rng = np.random.default_rng(6)
    points = [(*map(float, rng.uniform([1, 20, 0.1, -0.4], [10, 90, 0.9, 0.4])), 1.5, e, m) for e in (0.0, 0.3) for m in ("exp", "linear") for _ in range(5)]
    bad = [(2.0, 30.0, 0.5, -2.0, 1.0, 0.0, "linear"), (2.0, 30.0, 0.5, 0.1, -1.0, 0.0, "exp"), (2.0, 30.0, 0.5, 900.0, 1.0, 0.0, "exp"), (2.0, 30.0, 0.5, 0.1, 1.0, 0.0, "cubic"), (2.0, None, 0.5, 0.1, 1.0, 0.0, "exp")]

    def run(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n double, d double, q double, effect double, lam double, eta double, model string")
        out = allocation.bridged_loss(*[F.col(c) for c in ("n", "d", "q", "effect", "lam", "eta", "model")], law)
        return [r.asDict() for r in df.select("i", *[v.alias(k) for k, v in out.items()]).orderBy("i").collect()]

    here, h = run(points), 1e-5
    for k, x in enumerate("ndq"):
        up, down = (run([(*p[:k], p[k] + s, *p[k + 1 :]) for p in points]) for s in (h, -h))
        for p, r, a, b in zip(points, here, up, down):
            slope = (a["loss"] - b["loss"]) / (2 * h)
            assert r["status"] == "OK" and abs(r[f"d{x}"] - slope) < 1e-6 and abs(r[f"elasticity_{x}"] - p[k] * slope / r["loss"]) < 1e-4
    got = run(bad)
    assert [r["status"] for r in got] == ["OUT_OF_RANGE", "NEGATIVE_LAMBDA", "OUT_OF_RANGE", "UNKNOWN_MODEL", "MISSING"]
    assert all(r[c] is None for r in got for c in r if c not in ("i", "status"))
