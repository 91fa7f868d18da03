"""The panel of origins against plain pandas: what each origin could see, anchors, trends, planes, predictions and scenarios."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixlume.operators import origins


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 900
    day = pd.Timestamp("2020-01-03") + pd.to_timedelta(rng.integers(0, 420, n), "D")
    model = rng.integers(0, 350, n)
    log_n = np.round(rng.uniform(-1, 2, n), 2)
    t = (day - pd.Timestamp("2020-01-01")).days / 30.4375
    score = np.clip(30 + 8 * log_n + 1.1 * t + rng.normal(0, 6, n), 1, 99).round(3)
    return pd.DataFrame({"row_no": np.arange(n), "model": model, "day": day, "t": t, "kind": np.where(model % 3 == 0, "a", "b"), "developer": model % 17, "log_n": log_n, "score": score})


@pytest.fixture(scope="module")
def versions(spark, table):
    return spark.createDataFrame(table.assign(day=table.day.dt.date)).repartition(3)


logit = lambda s: np.log(np.clip(s / 100, 0.001, 0.999) / (1 - np.clip(s / 100, 0.001, 0.999)))


def plain(table, growth):
    out = []
    for kind, group in table.groupby("kind"):
        for origin in pd.date_range(group.day.min().replace(day=1), group.day.max(), freq="MS"):
            stop = origin + pd.DateOffset(months=2)
            newest = lambda x: x.sort_values(["day", "row_no"]).drop_duplicates("model", keep="last")
            train, test = newest(group[group.day < origin]), newest(group[(group.day >= origin) & (group.day < stop)])
            if len(train) < 30 or len(test) < 10 or stop - pd.Timedelta(days=1) > group.day.max() or origin < group.day.min().replace(day=1) + pd.DateOffset(months=4):
                continue

            def anchor(x):
                recent = x[x.day > x.day.max() - pd.DateOffset(months=2)]
                return recent.score.quantile(0.9), len(recent)

            monthly = []
            for month in sorted(train.day.dt.to_period("M").unique()):
                seen = train[train.day.dt.to_period("M") <= month]
                s, n = anchor(seen)
                if n >= 10:
                    monthly.append((seen.t.max(), logit(s)))
            drift = np.polyfit(*zip(*monthly), 1)[0] if len(monthly) >= 3 else 0.0
            x = np.column_stack([np.ones(len(train)), train.log_n, train.t])
            mean = np.linalg.lstsq(x, logit(train.score.to_numpy()), rcond=None)[0]
            s = anchor(train)[0]
            h = ((stop - pd.Timedelta(days=1)) - train.day.max()).days / (365.25 / 12)
            move = {"constant": 0.0, "frontier_trend": drift * h, "mean_resource": mean[1] * 0.5 * growth * h / 12 + mean[2] * h}
            for name, dz in move.items():
                out.append((origin.date(), kind, name, len(train), len(test), test.score.quantile(0.9), 100 / (1 + np.exp(-logit(s) - dz)), test.model.isin(set(train.model)).mean(), test.developer.isin(set(train.developer)).mean()))
    return out


def test_backtest(versions, table):
    tested = origins.backtest(versions, 0.4)
    got = {(r["origin"], r["kind"], r["candidate"]): r for r in tested.collect()}
    expected = plain(table, 0.4)
    assert len(expected) > 20 and len(got) == len(expected) * 4 // 3
    for origin, kind, name, train, test, actual, value, models, developers in expected:
        r = got[origin, kind, name]
        assert (r["train_n"], r["test_n"]) == (train, test)
        assert np.allclose([r["actual"], r["predicted"], r["model_overlap"], r["developer_overlap"]], [actual, value, models, developers], atol=1e-6), (origin, kind, name)
    assert origins.backtest(versions.limit(0), 0.4).count() == 0


def test_quantile_planes_minimise_check_loss(versions, table):
    rows = versions.withColumn("half", F.col("model") % 2)
    for r in origins.plane_fits(rows, ["half"], 0.9).collect():
        part = table[table.model % 2 == r["half"]]
        z, x = logit(part.score.to_numpy()), np.column_stack([np.ones(len(part)), part.log_n, part.t])
        loss = lambda b: float(np.where(z - x @ b > 0, 0.9, -0.1) @ (z - x @ b))
        own = loss(np.array([r["b0"], r["b_size"], r["b_t"]]))
        rng = np.random.default_rng(1)
        best = min(loss(np.array([r["b0"], r["b_size"], r["b_t"]]) + rng.normal(0, s, 3) * [1, 0.5, 0.1]) for s in (1e-3, 5e-3, 2e-2, 0.1) for _ in range(300))
        assert own <= best * 1.002 and abs((z <= x @ [r["b0"], r["b_size"], r["b_t"]]).mean() - 0.9) < 0.01


def test_comparison_and_scenarios(versions):
    tested = origins.backtest(versions, 0.4)
    rows = tested.toPandas()
    best = {}
    for r in origins.compare(tested).collect():
        own = rows[(rows.kind == r["kind"]) & (rows.candidate == r["candidate"])]
        assert r["origins"] == len(own) and abs(r["rmse"] - np.sqrt(((own.predicted - own.actual) ** 2).mean())) < 1e-9 and abs(r["worst"] - (own.predicted - own.actual).abs().max()) < 1e-9
        best.setdefault(r["kind"], []).append((r["rmse"], r["candidate"], r["selected"]))
    assert all(sorted(v)[0][2] and sum(x[2] for x in v) == 1 for v in best.values())
    span = origins.scenarios(versions, tested, 0.4, [12.0], {"historical": 1.0, "stopped": 0.0}, [0.25, 0.75], [0.0, 1.0], [1.0]).collect()
    assert len(span) == 2 * 2 * 4
    for r in span:
        same = [x for x in span if (x["kind"], x["scenario"]) == (r["kind"], r["scenario"])]
        assert r["low"] <= r["point"] <= r["high"] and r["union_low"] == min(x["low"] for x in same) and r["union_high"] == max(x["high"] for x in same)
        worst = max(abs(x.predicted - x.actual) for x in rows[rows.kind == r["kind"]].itertuples())
        assert abs(r["stress_low"] - max(0, r["union_low"] - worst)) < 1e-9 and abs(r["stress_high"] - min(100, r["union_high"] + worst)) < 1e-9
        if r["candidate"] == "constant":
            assert abs(r["low"] - r["high"]) < 1e-9


def test_part_quantiles(spark):
    """Exact quantiles of groups whose rows lie in several parts, equal scores across parts and missing scores too; no sketch in the plan."""
    rng = np.random.default_rng(3)
    score = np.sort(np.concatenate([rng.integers(0, 40, 500) / 4, np.full(200, 5.0)]))
    part = np.arange(700) // 50
    rows = [(int(g), float(s), int(p)) for s, p, g in zip(score, part, rng.integers(0, 6, 700))] + [(2, None, 0), (9, None, 0)]
    got = {r["g"]: (r["n"], r["q"]) for r in origins.part_quantiles(spark.createDataFrame(rows, "g int, score double, _part int").repartition(3), ["g"], 0.9).collect()}
    for g in {r[0] for r in rows}:
        own = [s for k, s, _ in rows if k == g]
        known = [s for s in own if s is not None]
        assert got[g][0] == len(own) and (abs(got[g][1] - np.quantile(known, 0.9)) < 1e-12 if known else got[g][1] is None)


def test_planes_of_spans(spark, versions, table, monkeypatch):
    """Rows held by many origins are written once, not for each of them; their planes are those of exploded rows, and the check loss is that of many more reweightings."""
    written, write = [], origins.cut
    monkeypatch.setattr(origins, "cut", lambda df, name: written.append((name, out := write(df, name))) or out)
    tested = origins.backtest(versions, 0.4)
    planes = [x.count() for name, x in written if name == "plane"]
    assert tested.count() and planes and sum(planes) <= len(table)
    rows = versions.withColumns({"_a": F.month("day") - 1, "_z": F.month("day") + F.col("model") % 4})
    groups = spark.createDataFrame([(k, a) for k in "ab" for a in range(2, 10)], "kind string, at int")
    check, mean = origins.span_planes(rows, ["kind"], [0.9, None], groups)
    long = rows.withColumn("at", F.explode(F.sequence("_a", "_z"))).join(groups, ["kind", "at"])
    coefficients = lambda df: {(r["kind"], r["at"]): np.array([r["b0"], r["b_size"], r["b_t"]]) for r in df.collect()}
    got, own, squares = coefficients(check), long.toPandas(), coefficients(mean)
    assert got.keys() == squares.keys() == {(r["kind"], r["at"]) for r in groups.collect()}
    for key, part in own.groupby(["kind", "at"]):
        z, x = logit(part.score.to_numpy()), np.column_stack([np.ones(len(part)), part.log_n, part.t])
        assert np.allclose(squares[key], np.linalg.lstsq(x, z, rcond=None)[0], atol=1e-7)
        loss = lambda b: float(np.where(z - x @ b > 0, 0.9, -0.1) @ (z - x @ b))
        best = squares[key]
        for _ in range(400):
            w = np.where(z - x @ best > 0, 0.9, 0.1) / np.maximum(np.abs(z - x @ best), 1e-3)
            best = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * z))
        assert loss(got[key]) <= loss(best) * 1.002


@pytest.mark.parametrize(("close", "groups"), [(300, 1), (1500, 3)])
def test_quantile_planes_are_finished(versions, table, monkeypatch, close, groups):
    """Planes are those that thousands of reweightings end at, whether a group's rows are gathered whole or only next to its plane."""
    monkeypatch.setattr(origins, "CLOSE", close, raising=False)
    for r in origins.plane_fits(versions.withColumn("part", F.col("model") % groups), ["part"], 0.9).collect():
        part = table[table.model % groups == r["part"]]
        z, x = logit(part.score.to_numpy()), np.column_stack([np.ones(len(part)), part.log_n, part.t])
        best = np.linalg.lstsq(x, z, rcond=None)[0]
        for _ in range(20000):
            w = np.where(z - x @ best > 0, 0.9, 0.1) / np.maximum(np.abs(z - x @ best), 1e-3)
            best = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * z))
        got = np.array([r["b0"], r["b_size"], r["b_t"]])
        cost = lambda b: (np.where(z - x @ b > 0, 0.9, 0.1) * np.where(np.abs(z - x @ b) > 1e-3, np.abs(z - x @ b) - 5e-4, (z - x @ b) ** 2 / 2e-3)).sum()
        assert cost(got) <= cost(best) * (1 + 1e-6), (got, best, cost(got) / cost(best))
        assert groups == 1 or np.allclose(got, best, atol=5e-4)
