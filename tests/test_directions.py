"""Envelopes of ranks and rules of directions against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from mixlume.operators import conflict, quality

FAMILIES = {"one": ["a", "b"], "two": ["c"]}


def test_rank_envelope(spark):
    rng = np.random.default_rng(5)
    z = pd.DataFrame(rng.normal(size=(120, 3)), columns=list("abc"))
    z["domain"] = rng.choice(["x", "y", "w"], 120)
    z.loc[::7, "a"] = None
    z.loc[3:5, ["a", "b", "c"]] = None
    signs = [(rep, m, int(s)) for rep in range(6) for m, s in zip("abc", rng.choice([-1, 1], 3))]
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in z[["domain", "a", "b", "c"]].itertuples(index=False)] + [("empty", None, None, None)]
    df = spark.createDataFrame(plain, "domain string, a double, b double, c double").repartition(4)
    got = {r["domain"]: r for r in quality.rank_envelope(df, spark.createDataFrame(signs, "rep int, metric string, sign int"), FAMILIES).collect()}
    ranks, medians = {}, {}
    for rep in range(6):
        s = {m: v for r, m, v in signs if r == rep}
        f = pd.concat([(z[ms] * [s[m] for m in ms]).mean(axis=1) for ms in FAMILIES.values()], axis=1).mean(axis=1)
        medians[rep] = f.groupby(z["domain"]).median()
        ranks[rep] = medians[rep].rank(ascending=False, method="min").astype(int)
        n = f.groupby(z["domain"]).count()
    assert set(got) == {"x", "y", "w"}
    for k, r in got.items():
        others = [ranks[rep][k] for rep in range(1, 6)]
        assert (r["n"], r["rank"]) == (n[k], ranks[0][k]) and (r["rank_min"], r["rank_median"], r["rank_max"]) == (min(others), np.median(others), max(others))
        assert abs(r["median_min"] - min(medians[rep][k] for rep in range(1, 6))) < 1e-12
    with pytest.raises(Exception, match="no sign for c"):
        quality.rank_envelope(df, spark.createDataFrame([s for s in signs if s[1] != "c"], "rep int, metric string, sign int"), FAMILIES).collect()


def test_direction_rules(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    whole = make([("a", 0.5), ("b", -0.2), ("c", 0.01), ("d", None)], "metric string, rho double")
    reps = make([(k, m, v) for k in range(10) for m, v in (("a", 0.4), ("b", 0.1 if k < 1 else -0.3), ("c", 0.2), ("d", None))], "rep int, metric string, rho double")
    each = make([("x", "a", 0.1), ("y", "a", -0.1), ("x", "b", -0.5), ("y", "b", -0.5), ("x", "c", 0.3)], "domain string, metric string, rho double")
    left = make([("x", "a", 0.3), ("y", "a", 0.2), ("x", "b", -0.1), ("x", "c", 0.2), ("x", "d", -0.5)], "held_out string, metric string, rho double")
    lack = make([("a", 0.0), ("b", 0.25), ("c", 0.0)], "metric string, missing_rate double")
    got = {r["metric"]: r for r in quality.direction_rules(whole, reps, each, left, lack, {"one": ["a", "b", "d"], "two": ["c"]}).collect()}
    assert [got[m]["weak_or_unstable"] for m in "abcd"] == [False, True, True, True]  # b flips in a tenth, c is weak, d flips without x
    assert (got["a"]["sign"], got["b"]["sign"], got["d"]["sign"]) == (1, -1, 1) and abs(got["b"]["flip_rate"] - 0.1) < 1e-12
    assert got["a"]["domain_agreement"] == 0.5 and got["d"]["domain_agreement"] is None and got["d"]["missing_rate"] is None
    assert abs(got["a"]["weight"] - 1 / 6) < 1e-12 and got["c"]["weight"] == 0.5 and got["d"]["loo_flip"]


def test_conflict_graph(spark):
    pooled = [("a", "b", -0.4, 0.001, True), ("a", "c", -0.3, 0.01, True), ("b", "c", 0.2, 0.3, False), ("b", "d", None, None, False)]
    inside = [("x", "a", "b", -0.5, True), ("y", "a", "b", -0.1, False), ("x", "a", "c", -0.3, True), ("y", "a", "c", -0.4, True), (None, "a", "b", -0.9, True), ("x", "b", "c", None, False)]
    outside = [("x", "a", "b", -0.2, True), ("y", "a", "b", 0.2, False), ("x", "a", "c", -0.1, False), (None, "a", "c", -0.9, True), ("y", "b", "c", -0.4, True)]
    schema = "metric_a string, metric_b string, rho double"
    tables = [spark.createDataFrame(pooled, schema + ", q double, conflict boolean"), *[spark.createDataFrame(t, f"s string, {schema}, conflict boolean") for t in (inside, outside)]]
    got = {r["metric_a"] + r["metric_b"]: r for r in conflict.conflict_graph(*tables, "s", "s", 2).collect()}
    counts = ["domains_negative", "domains_significant", "domains_valid", "scopes_valid", "scopes_replicated"]
    assert {k: [r[c] for c in counts] for k, r in got.items()} == {"ab": [2, 1, 2, 2, 1], "ac": [2, 2, 2, 1, 0], "bc": [0, 0, 0, 1, 1], "bd": [0, 0, 0, 0, 0]}
    assert {k: (r["stable"], r["cause"]) for k, r in got.items()} == {"ab": (True, "domain_specific"), "ac": (False, "multi_domain"), "bc": (False, "pooled_only"), "bd": (False, "pooled_only")}
