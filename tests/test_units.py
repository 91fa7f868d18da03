"""Literal unit cases, properties of the operators without SQL, sources and streams."""

from __future__ import annotations

import json
import lzma
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixlume.functions import expr
from mixlume.operators import budget, conflict, extensions, frontier, mixture, moments, pairs, quality, resample, stats, validate
from mixlume.plans import registry
from mixlume.plans.entities import recipes, runs
from mixlume.sources import io
from mixlume.streaming import scoring


def one(df, column):
    return [r[column] for r in df.collect()]


def test_list_signals(spark):
    v = spark.createDataFrame([([None, None],), ([0.0, None],), ([float("inf"), 0.0],), ([0.0, 0.0],), ([1.0, 3.0],), ([],), (None,)], "v array<double>")
    assert one(v.select(expr.expected_class(F.col("v")).alias("x")), "x")[:4] == [None, None, None, 0.5]
    assert one(v.select(expr.argmax_class(F.col("v")).alias("x")), "x") == [None, None, None, 0.0, 1.0, None, None]


def test_numbers_and_clip(spark):
    s = spark.createDataFrame([("",), ("  ",), ("0",), ("3.5",), ("x",), ("NaN",), (None,)], "s string")
    assert one(s.select(expr.number(F.col("s")).alias("x")), "x") == [None, None, 0.0, 3.5, None, None, None]
    c = spark.createDataFrame([(None,), (9.0,), (-9.0,), (1.0,)], "x double")
    assert one(c.select(expr.clip(F.col("x"), -5, 5).alias("y")), "y") == [None, 5.0, -5.0, 1.0]
    assert one(c.select(expr.mean_present([F.col("x"), F.lit(None).cast("double")]).alias("y")), "y") == [None, 9.0, -9.0, 1.0]


def test_decisions(spark):
    rows = spark.createDataFrame([(2.0, 3.0), (-1.0, 0.5), (1.0, None), (None, 1.0), (None, None), (1.0, 1.0), (-1.0, 5.0)], "q double, d double")
    got = one(rows.select(quality.decide(F.col("q"), F.col("d"), F.lit(0.0), F.lit(2.0)).alias("x")), "x")
    assert got == ["RETAIN_FLAG_REVIEW", "LOW_PRIORITY", "REVIEW_MISSING_D", "REVIEW_MISSING_Q", "REVIEW_MISSING_Q_AND_D", "RETAIN", "LOW_PRIORITY_REVIEW"]


def test_scale_is_frozen_and_signs_are_checked(spark):
    a = spark.createDataFrame([(-1.0, 5.0), (0.0, 5.0), (1.0, 5.0), (None, None)], "x double, y double")
    params = quality.fit_scale(a, ["x", "y"])
    assert {r["metric"]: (r["center"], round(r["scale"], 4)) for r in params.collect()} == {"x": (0.0, 1.4826), "y": (5.0, 1.0)}
    z = quality.apply_scale(a.withColumn("x", F.col("x") + 2), params, ["x", "y"])
    assert one(z.agg(F.avg("x").alias("m")), "m")[0] > 1
    signs = spark.createDataFrame([("x", -1), ("y", 1)], "metric string, sign int")
    assert one(quality.orient(z, signs, ["x", "y"]).where("x is not null").agg(F.max("x").alias("m")), "m")[0] < 0
    for bad in ([("x", 0), ("y", 1)], [("x", 1)]):
        with pytest.raises(Exception, match="signs must be"):
            quality.orient(z, spark.createDataFrame(bad, "metric string, sign int"), ["x", "y"]).collect()
    kept, dropped = quality.subset_families({"rps": ["a"], "dsir": ["b"]}, ["a"])
    assert kept == {"rps": ["a"]} and dropped == ["dsir"]


def test_conflict(spark):
    rows = spark.createDataFrame([(k, float(k), -float(k), 1.0) for k in range(40)], "id long, a double, b double, c double")
    pairs = {(r["metric_a"], r["metric_b"]): r["rho"] for r in conflict.pair_correlations(rows, ["a", "b", "c"]).collect()}
    assert round(pairs["a", "b"], 9) == -1 and pairs["a", "c"] is None
    tested = {(r["metric_a"], r["metric_b"]): r for r in conflict.tested_pairs(conflict.pair_correlations(rows, ["a", "b", "c"])).collect()}
    assert tested["a", "b"]["conflict"] and tested["a", "c"]["q"] is None
    p = spark.createDataFrame([(0.3, 32), (0.0, 12)], "r double, n long").select(conflict.t_tail(F.col("r"), F.col("n")).alias("p"))
    assert [round(x, 4) for x in one(p, "p")] == [0.0953, 1.0]
    none = spark.createDataFrame([(None, None)], "a double, b double")
    assert one(none.select(conflict.conflict_degree(none, [("a", "b", 1.0)]).alias("d")), "d") == [None]


def test_adjusted_p_values(spark):
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,), (0.5,)], "p double")
    assert sorted(round(x, 6) for x in one(stats.benjamini_hochberg(p, "p"), "q") if x is not None) == [0.04, 0.053333, 0.053333, 0.5]


def test_adjusted_p_values_of_large_groups(spark, monkeypatch):
    """A hot value, a NULL group, missing values and many distinct ones against numpy; no window reads on to its rows' end, which Spark does anew for each row."""
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.uniform(0, 1, 3000)] + [("b", 0.25)] * 900 + [("b", float(v)) for v in rng.integers(1, 40, 500) / 40] + [(None, 0.2), (None, 0.1), ("a", None), ("c", None)]
    plans, write = [], stats.cut
    monkeypatch.setattr(stats, "cut", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or write(df, name))
    adjusted = stats.benjamini_hochberg(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g string, p double").repartition(5), "p", ["g"])
    assert not any(re.search(r"(?<!unboundedpreceding\$\(\)), unboundedfollowing", x) for x in [*plans, adjusted._jdf.queryExecution().toString()])
    got = {r["id"]: r["q"] for r in adjusted.collect()}
    assert adjusted.columns == ["id", "g", "p", "q"] and len(got) == len(rows) == adjusted.count()
    for g in {r[0] for r in rows}:
        own = sorted(((r[1], i) for i, r in enumerate(rows) if r[0] == g and r[1] is not None), reverse=True)
        low = 1.0
        for place, (p, i) in enumerate(own):
            low = min(low, p * len(own) / (len(own) - place))
            assert abs(got[i] - low) < 1e-12
    assert all(got[i] is None for i, r in enumerate(rows) if r[1] is None)


def test_ids_and_keys(spark):
    ids = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", " "), ("b", "1")], "domain string, id string")
    got = {r["domain"]: (r["blank_ids"], r["repeated_ids"]) for r in stats.id_integrity(ids, "domain", "id").collect()}
    assert got == {"a": (1, 1), "b": (0, 0)}
    with pytest.raises(Exception, match="repeats"):
        validate.many_to_one(ids, ids, "id").collect()


def test_coverage_and_compositions(spark):
    mapping = spark.createDataFrame([("arxiv", "direct", -0.5), ("web", "inferred", 0.9)], "domain string, mapping_type string, quality double")
    shares = spark.createDataFrame([(1, "arxiv", 1.0), (2, "arxiv", 0.1), (2, "web", 0.9), (3, "web", 1.0)], "idx int, domain string, share double")
    got = {r["idx"]: (r["quality"], round(r["unknown_share"], 9), r["status"]) for r in mixture.quality_coverage(shares, mapping).collect()}
    assert got == {1: (-0.5, 0.0, "COMPLETE"), 2: (-0.5, 0.9, "PARTIAL_UNKNOWN"), 3: (None, 1.0, "PARTIAL_UNKNOWN")}
    c = spark.createDataFrame([(0.5, 0.5), (0.5, 0.6), (-0.1, 1.1), (None, 1.0)], "a double, b double")
    assert one(c.select(mixture.is_composition(["a", "b"]).alias("ok")), "ok") == [True, False, False, False]
    with pytest.raises(Exception, match="positive sum"):
        mixture.normalised(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"]).collect()


def test_least_squares(spark):
    rows = spark.createDataFrame([(k, float(k), float(k % 7), 1 + 2.0 * k - 3.0 * (k % 7)) for k in range(50)], "id long, x double, z double, y double")
    beta = {r["term"]: r["beta"] for r in moments.fit(moments.gram(rows, [], ["x", "z"], ["y"]), [], ["x", "z"], ["y"]).collect()}
    assert {k: round(v, 6) for k, v in beta.items()} == {"intercept": 1.0, "x": 2.0, "z": -3.0}
    with pytest.raises(Exception, match="rank-deficient"):
        moments.fit(moments.gram(rows.withColumn("x", F.lit(1.0)), [], ["x"], ["y"]), [], ["x"], ["y"]).collect()
    folds = moments.gram(resample.contiguous_folds(rows, ["id"], 5), ["fold"], ["x"], ["y"]).withColumn("one", F.lit(1))
    train = {r["fold"]: (r["n"], round(r["g"][2], 6)) for r in moments.subtract_folds(folds, ["one"]).collect()}
    brute = resample.contiguous_folds(rows, ["id"], 5)
    assert train == {k: (40, round(brute.where(F.col("fold") != k).agg(F.sum("y")).first()[0], 6)) for k in range(5)}
    cv = {r["alpha"]: r["rmse"] for r in mixture.cross_validate(rows, "id", ["x", "z"], ["y"], (1e-6, 1000.0), 5).collect()}
    assert cv[1e-6] < 1e-3 < cv[1000.0]
    with pytest.raises(ValueError, match="one column"):
        resample.contiguous_folds(rows, ["z", "id"], 4)


def test_records_and_boundaries(spark):
    rows = spark.createDataFrame([("m", "2024-01-01", 60.0), ("m", "2024-02-01", 40.0), ("n", "2024-02-01", 55.0), ("o", "2024-02-02", float("inf"))], "model string, d string, score double").withColumn("day", F.to_date("d")).withColumn("kind", F.lit("x"))
    assert one(frontier.running_record(rows, ["kind"]).orderBy("day"), "record") == [60.0, 60.0]
    b = spark.createDataFrame([(40.0, 51.0, 6.0), (55.0, 51.0, 6.0), (98.0, 95.0, 5.0)], "q double, r double, g double")
    assert one(b.select(frontier.record_boundary(F.col("q"), F.col("r"), F.col("g")).alias("x")), "x") == [51.0, 61.0, 100.0]
    with pytest.raises(Exception, match="boundary"):
        b.select(frontier.record_boundary(F.lit(float("nan")), F.col("r"), F.col("g"))).collect()


def test_past_snapshots_do_not_leak(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1, 50.0), ("a", "2024-10-05", 2, 90.0), ("b", "2024-03-01", 3, 70.0)], "model string, d string, row_no long, score double").withColumn("day", F.to_date("d"))
    origins = spark.sql("select date'2024-06-01' as origin union all select date'2024-12-01'")
    got = {(str(r["origin"]), r["model"]): r["score"] for r in frontier.past_snapshots(rows, origins).collect()}
    assert got == {("2024-06-01", "a"): 50.0, ("2024-06-01", "b"): 70.0, ("2024-12-01", "a"): 90.0, ("2024-12-01", "b"): 70.0}


def test_decomposition_adds_up(spark):
    rows = [("early", 0.1, 10.0)] * 6 + [("early", 1.1, 50.0)] * 2 + [("late", 0.1, 10.0)] * 2 + [("late", 1.1, 60.0)] * 6
    r = frontier.decompose(spark.createDataFrame(rows, "era string, log_n double, score double"), [1.0]).first()
    assert round(r["mix"] + r["within_cells"] - r["change"], 9) == 0 and r["cells"] == 2


def test_shapley_and_bridge(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (-1.0, -2.0, 3.0), (3.0, 2.0, -2.0), (-5.0, 0.2, -0.3)], "z double, a double, b double")
    size, time = frontier.shapley(F.col("z"), F.col("a"), F.col("b"))
    whole = 100 / (1 + F.exp(-(F.col("z") + F.col("a") + F.col("b")))) - 100 / (1 + F.exp(-F.col("z")))
    assert all(abs(x) < 1e-9 for x in one(rows.select((size + time - whole).alias("x")), "x"))
    points = spark.createDataFrame([("up", 1.0, 1.0), ("up", 2.0, 2.0), ("down", 1.0, 2.0), ("down", 2.0, 1.0)], "g string, loss double, s double")
    bridge = frontier.monotone_bridge(points, ["g"], "loss", "s")
    assert {r["g"]: (r["slope"], r["intercept"]) for r in bridge.collect()} == {"up": (0.0, 1.5), "down": (-1.0, 3.0)}
    status, score = frontier.convert(F.col("x"))
    q = bridge.where("g = 'down'").crossJoin(spark.createDataFrame([(float("nan"),), (0.5,), (1.5,), (9.0,)], "x double")).select(status.alias("s"), score.alias("v"))
    assert [(r["s"], r["v"]) for r in q.collect()] == [("LOSS_MISSING", None), ("LOSS_BELOW_SUPPORT", None), ("SUPPORTED", 1.5), ("LOSS_ABOVE_SUPPORT", None)]


def test_quantile_regression(spark):
    rows = [(k / 10, 1 + 2 * k / 10 + (40 if k in (3, 20, 33) else 0)) for k in range(41)]
    r = frontier.quantile_fit(spark.createDataFrame(rows, "x double, y double"), "y", "x", 0.5, 60).first()
    assert abs(r["intercept"] - 1) < 0.01 and abs(r["slope"] - 2) < 0.01


def test_scaling_law(spark):
    rows = [(float(n), float(d), 1.5 + 3 * n**-0.5 + 2 * d**-0.6) for n in (1, 2, 4, 8, 16) for d in (1, 3, 9, 27, 81)]
    points = spark.createDataFrame(rows, "n double, d double, loss double").withColumn("group", F.col("n"))
    fit = budget.fit_classic(points, passes=4).first()
    assert fit["loss"] < 1e-4 and abs(fit["e"] - 1.5) < 0.1
    law = (1.5, 3.0, 0.5, 2.0, 0.6)
    root = points.select("n", budget.size_for_loss(F.col("loss"), F.col("d"), law).alias("m"))
    assert all(abs(r["m"] - r["n"]) < 1e-6 * r["n"] for r in root.collect())
    assert one(points.select(budget.size_for_loss(F.lit(0.1), F.col("d"), law).alias("m")), "m") == [None] * 25
    scan = budget.scan(points, law, 21).orderBy("budget").collect()
    assert all(a["loss"] >= b["loss"] - 1e-12 for a, b in zip(scan, scan[1:]))


def test_pareto_front(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, 5.0, 1.0), (5, 2.0, 2.0)], "id int, a double, b double").repartition(3)
    assert sorted(one(pairs.front(rows, ["a", "b"]), "id")) == [1, 2, 4, 5]


def test_resampling_is_independent_of_partitions(spark):
    rows = spark.range(200).withColumnRenamed("id", "k").withColumn("v", F.col("k").cast("double")).withColumn("g", F.col("k") % 2)
    a = resample.bootstrap_median(rows.repartition(7), ["g"], "v", "k", 10, "s").orderBy("g").collect()
    b = resample.bootstrap_median(rows.coalesce(1), ["g"], "v", "k", 10, "s").orderBy("g").collect()
    assert a == b and all(r["low"] <= r["high"] for r in a)
    split = resample.stratified_split(rows, "g", "k", 0.7, "s").groupBy("g", "part").count().collect()
    assert sorted((r["g"], r["part"], r["count"]) for r in split) == [(0, "check", 30), (0, "fit", 70), (1, "check", 30), (1, "fit", 70)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,note\n1,"two\nlines"\n2,\n'.encode())
    got = io.read_csv(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType())])).collect()
    assert [r["note"] for r in got][0] == "two\nlines" and [r["note"] for r in got][1] in ("", None)
    (tmp_path / "b.xz").write_bytes(lzma.compress(b'{"id": 1}\n{"id": 2}\n'))
    assert one(io.read_xz_lines(spark, str(tmp_path / "b.xz")).orderBy("line_no"), "line") == ['{"id": 1}', '{"id": 2}']
    (tmp_path / "web.json").write_text(json.dumps({"id": "x", "content": "dropped"}) + "\n" + json.dumps({"id": "y", "_source_domain": "arxiv"}))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("_source_domain", T.StringType())])
    assert {r["id"]: r["_source_domain"] for r in io.read_json_lines(spark, str(tmp_path / "web.json"), schema).collect()} == {"x": "web", "y": "arxiv"}
    manifest = spark.createDataFrame([("b.xz", 1, "0"), ("gone", 1, "0")], "name string, bytes long, sha256 string")
    assert {r["name"]: r["status"] for r in io.file_identity(spark, str(tmp_path / "b.xz"), manifest).collect()} == {"b.xz": "changed", "gone": "missing"}
    clean = io.without_non_finite(spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double"))
    assert one(clean, "x") == [None, None, 1.0]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("x", 60.0, "2024-01-05"), ("x", 40.0, "2024-02-05"), ("y", float("nan"), "2024-02-06"), ("y", 5.0, "2024-02-07")], "kind string, score double, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    stream = lambda: spark.readStream.schema("kind string, score double, ts timestamp").parquet(src)
    q = scoring.running_record(stream(), "kind", "score").writeStream.outputMode("update").format("memory").queryName("records").start()
    q.processAllAvailable()
    q.stop()
    assert {r["kind"]: r["record"] for r in spark.table("records").collect()} == {"x": 60.0, "y": 5.0}
    params = quality.fit_scale(spark.read.parquet(src).where("not isnan(score)"), ["score"])
    score = lambda df: quality.apply_scale(df, params, ["score"])
    q = scoring.score_stream(stream(), score).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = sorted(map(str, score(spark.read.parquet(src)).collect()))
    assert sorted(map(str, spark.table("scored").collect())) == batch
    q = scoring.monthly_quantiles(stream(), "ts", "score", str(tmp_path / "q"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "q" / "quantiles")).count() == 2


def test_equal_loss_roots_of_all_runs(spark):
    folder = "/root/testdata/sf0.001"
    assert registry.QUERIES["m24_equal_loss_root"](spark, folder).count() == runs(spark, folder).count()


def test_crossings_of_all_recipes(spark):
    folder = "/root/testdata/sf0.001"
    cost = {"exp": lambda q: math.exp(q) - 1, "power": lambda q: q * q, "log": lambda q: math.log(1 + q)}
    expected = {}
    for r in recipes(spark, folder).collect():
        for family, f in cost.items():
            q = next((k / 20 for k in range(1, 41) if f(k / 20) > 1 + r["loss_d"] >= f((k - 1) / 20)), None)
            if q is not None:
                expected[r["idx"], family] = q
    got = {(r["idx"], r["family"]): r["q"] for r in registry.QUERIES["g3_critical_points"](spark, folder).collect()}
    assert got == pytest.approx(expected) and any(idx % 10 for idx, _ in got)


def _ridge(x, y, alpha):
    m, mu = x.mean(0), y.mean()
    beta = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - mu))
    return lambda z: mu + (z - m) @ beta


def test_heldout_choices_and_nested_validation(spark):
    rng = np.random.default_rng(4)
    x = rng.random((60, 3))
    y = 1 + x @ [0.5, -0.3, 0.1] + 0.8 * x[:, 0] * x[:, 1] + 0.05 * rng.normal(size=60)
    rows = spark.createDataFrame([(k, *map(float, x[k]), float(y[k]), float(x[k, 0] * x[k, 1])) for k in range(60)], "k long, a double, b double, c double, y double, ab double").repartition(3)
    got = {r["fold"]: r for r in mixture.heldout_choices(rows, "k", ["a", "b", "c"], "y", 5, 0.1).collect()}
    for f in range(5):
        held = np.arange(60) // 12 == f
        p = _ridge(x[~held], y[~held], 0.1)(x[held])
        pick = np.flatnonzero(held)[p.argmin()]
        assert got[f]["pick"] == pick and got[f]["realised_rank"] == 1 + (y[held] < y[pick]).sum() and abs(got[f]["regret"] - (y[pick] - y[held].min())) < 1e-9
    out = {r["outer"]: r for r in extensions.nested_validation(rows, "k", {"plain": ["a", "b", "c"], "more": ["a", "b", "c", "ab"]}, "y", (0.001, 1.0)).collect()}
    inner = {r["k"]: r["i"] for r in rows.select("k", F.floor(expr.hash_uniform("inner", F.col("k")) * 5).alias("i")).collect()}
    inner = np.array([inner[k] for k in range(60)])
    more = np.column_stack([x, x[:, 0] * x[:, 1]])
    for f in range(5):
        held, best = np.arange(60) // 12 == f, None
        for name, m in (("plain", x), ("more", more)):
            for alpha in (0.001, 1.0):
                error = 0.0
                for i in range(5):
                    test, train = ~held & (inner == i), ~held & (inner != i)
                    error += ((_ridge(m[train], y[train], alpha)(m[test]) - y[test]) ** 2).sum() if test.any() else 0
                if best is None or error < best[0] - 1e-12:
                    best = error, name, alpha, np.sqrt(((_ridge(m[~held], y[~held], alpha)(m[held]) - y[held]) ** 2).mean())
        assert (out[f]["model"], out[f]["alpha"]) == best[1:3] and abs(out[f]["rmse"] - best[3]) < 1e-9


def test_first_match(spark):
    names = spark.createDataFrame([("Red RING",), ("x",), (None,)], "s string").select(extensions.first_match(F.col("s"), {"b": ["gear"], "j": ["ring"]}).alias("f"))
    assert [r["f"] for r in names.collect()] == ["j", "other", "other"]


def test_exact_quantiles_and_ranks_of_hot_groups(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=5000), np.full(3000, 0.25)])
    rows = spark.createDataFrame([("hot" if k % 3 else None, float(v)) for k, v in enumerate(values)] + [("empty", None), ("one", 2.0)], "g string, v double")
    got = {r["g"]: r for r in stats.quantiles(rows, ["g"], {"m": ("v", 0.5), "t": ("v", 0.97)}).collect()}
    for g, keep in (("hot", True), (None, False)):
        mine = values[(np.arange(len(values)) % 3 > 0) == keep]
        assert abs(got[g]["m"] - np.quantile(mine, 0.5)) < 1e-12 and abs(got[g]["t"] - np.quantile(mine, 0.97)) < 1e-12
    assert got["empty"]["m"] is None and got["one"]["t"] == 2.0
    ranked = stats.average_ranks(rows.where("g = 'hot'"), ["g"], "v").select("v", "rank").distinct().collect()
    mine = np.sort(values[np.arange(len(values)) % 3 > 0])
    for r in ranked[::200]:
        lo, hi = np.searchsorted(mine, r["v"], "left"), np.searchsorted(mine, r["v"], "right")
        assert r["rank"] == (lo + 1 + hi) / 2
