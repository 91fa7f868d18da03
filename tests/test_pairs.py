"""Counts over ordered pairs, fronts and nearest rows against all pairs in numpy, with hot values, ties, repeated rows, NULL and empty tables, in many small blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixlume.operators import pairs


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), float(n), float(d), round(float(v), 9)) for f, n, d, v in zip(rng.integers(0, 2, 700), rng.integers(1, 6, 700), rng.integers(0, 40, 700) / 2, rng.integers(0, 30, 700) / 7)]
    rows += [(0, 3.0, 7.0, 1.0)] * 150 + [(None, 1.0, 1.0, 1.0), (None, 2.0, 9.0, 0.5), (5, 1.0, 1.0, 1.0), (0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "fam int, n double, d double, loss double")


def arrays(rows, family):
    chosen = [r for r in rows if r[0] == family and r[1] is not None and r[1] == r[1]]
    return [np.array([r[k] for r in chosen]) for k in (1, 2, 3)]


@pytest.mark.parametrize("block", [16, 16384])
def test_dominance_pairs(points, block):
    rows, df = points
    expected = {}
    for f in {r[0] for r in rows}:
        n, d, loss = arrays(rows, f)
        over = (n[None, :] > n[:, None]) & (d[None, :] >= d[:, None] + 3)
        if over.sum():
            expected[f] = (int(over.sum()), int((over & (loss[None, :] < loss[:, None] - 5e-10)).sum()))
    got = {r["fam"]: (r["pairs"], r["agree"]) for r in pairs.dominance_pairs(df, "fam", 3.0, block).collect()}
    assert got == expected and None in got
    assert pairs.dominance_pairs(df.limit(0), "fam", 3.0, block).count() == 0


@pytest.mark.parametrize("block", [24, 16384])
def test_order_concordance(points, block):
    rows, df = points
    expected = {}
    for f in {r[0] for r in rows}:
        n, d, loss = arrays(rows, f)
        later = d[None, :] > d[:, None]
        if later.sum():
            fall, drop = loss[None, :] < loss[:, None] - 5e-10, n[None, :] < n[:, None]
            apart = later & (abs(loss[None, :] - loss[:, None]) > 5e-10) & (n[None, :] != n[:, None])
            expected[f] = (int(later.sum()), round(float((later & (fall == drop)).sum() / later.sum()), 9), int(apart.sum()), round(float((apart & (fall == drop)).sum() / apart.sum()), 9))
    got = {r["fam"]: (r["pairs"], round(r["concordance"], 9), r["scored"], round(r["order_share"], 9)) for r in pairs.order_concordance(df, "fam", "d", "loss", "n", block).collect()}
    assert got == expected


def test_slope_signs(points, monkeypatch):
    from mixlume.operators import stats

    monkeypatch.setattr(stats, "RANGES", 5)
    rows, df = points
    got = {r["fam"]: (r["slopes"], round(r["accuracy"], 9)) for r in pairs.slope_signs(df, "fam", "d", "loss", "n").collect()}
    for f in (0, 1):
        chosen = [r for r in rows if r[0] == f]
        mean = lambda d, k: float(np.mean([v for v in (r[k] for r in chosen if r[2] == d) if v is not None]))
        at = sorted({r[2] for r in chosen})
        a, p = np.diff([mean(d, 3) for d in at]), np.diff([mean(d, 1) for d in at])
        moved = abs(a) > 1e-9
        assert got[f][0] == int(moved.sum())
        if not np.isnan(p).any():
            assert got[f][1] == round(float((np.sign(a) == np.sign(p))[moved].mean()), 9)
    assert 5 not in got


@pytest.mark.parametrize("block,filters", [(32, 4), (16384, 256)])
def test_front(spark, block, filters):
    rng = np.random.default_rng(4)
    x = rng.random((400, 2))
    rows = [(i, float(a), float(b), float(2 - a - b)) for i, (a, b) in enumerate(x)]  # a plane: all on the front
    rows += [(1000 + i, float(a), float(b), float(2.1 - a - b + c)) for i, (a, b, c) in enumerate(rng.integers(0, 9, (300, 3)) / 9)]
    rows += [(5000, *rows[0][1:]), (5001, None, 0.0, 0.0), (5002, 0.5, float("nan"), 9.0), (5003, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    v = np.array([[np.nan if c is None else c for c in r[1:]] for r in rows])
    expected = {r[0] for r, x in zip(rows, v) if not ((v <= x).all(axis=1) & (v < x).any(axis=1)).any()}
    out = pairs.front(df, ["a", "b", "c"], block, filters)
    assert out.columns == df.columns and {r["id"] for r in out.collect()} == expected and {0, 399, 5000, 5001, 5002} <= expected
    assert pairs.front(df.limit(0), ["a", "b", "c"]).count() == 0
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_counts_of_one_value(spark):
    """A value that all rows share is spread over blocks."""
    df = spark.range(500).select("id", F.lit(1.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    less = {r["id"]: r["n"] for r in pairs.counts_below(df, [], [("x", "x", False), ("y", "y", True)], "id", block=16).collect()}
    y = np.arange(500) % 7
    assert less == {i: int((y < y[i]).sum()) for i in range(500)}
    assert sum(r["n"] for r in pairs.counts_below(df, [], [("x", "x", True)], "id", block=16).collect()) == 0


@pytest.mark.parametrize("leaf", [16, 2048])
def test_nearest(spark, leaf):
    from mixlume.operators import nearest

    rng = np.random.default_rng(6)
    x = np.round(rng.dirichlet(np.ones(4), 500), 3)
    x[100:160] = x[100]  # a hot vector
    x[160:162] = x[160]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(900, None, 0.1, 0.1, 0.1), (901, 0.1, float("nan"), 0.1, 0.1), (902, -0.0, 0.0, 0.5, 0.5), (903, 0.0, 0.0, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {r["id"]: (r["nearest"], r["distance"]) for r in nearest.nearest(df, df, "id", ["a", "b", "c", "d"], leaf).collect()}
    good = [r for r in rows if r[0] not in (900, 901)]
    v = np.array([r[1:] for r in good])
    for r in good:
        d = np.round(np.sqrt(((v - np.array(r[1:])) ** 2).sum(axis=1)), 9)
        best = min((d[j], other[0]) for j, other in enumerate(good) if other[0] != r[0])
        assert got[r[0]][0] == best[1] and abs(got[r[0]][1] - best[0]) < 1e-8
    assert got[900] == got[901] == (None, None) and len(got) == len(rows)
    some = df.where("id % 50 = 0").withColumn("id", F.col("id") + 1000)  # queries that the reference doesn't hold
    assert {r["nearest"] % 50 for r in nearest.nearest(some, df.where("id < 500"), "id", ["a", "b", "c", "d"], leaf).where("nearest is not null and distance = 0").collect()} <= set(range(50))
    assert [tuple(r) for r in nearest.nearest(df.limit(1), df.limit(1), "id", ["a", "b", "c", "d"], leaf).collect()] == [(0, None, None)]
    assert nearest.nearest(df.limit(0), df, "id", ["a", "b", "c", "d"]).count() == 0
