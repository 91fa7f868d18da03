"""Rank correlations under many weightings at once against rows made several."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mixlume.operators import stats


def test_spearmans(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), float(a), float(b), [int(w) for w in ws]) for i, (a, b, ws) in enumerate(zip(rng.integers(0, 9, 300), rng.normal(size=300).round(1), rng.poisson(1, (300, 3))))]
    rows += [(0, 4.0, 0.0, [0, 0, 0]), (1, None, 1.0, [1, 1, 1])]
    df = spark.createDataFrame(rows, "g int, a double, b double, w array<int>")
    got = {(r["g"], r["k"]): (r["n"], r["rho"]) for r in stats.spearmans(df, ["g"], "a", "b", F.col("w"), 3).collect()}
    assert len(got) == 6
    for (g, k), (n, rho) in got.items():
        drawn = pd.DataFrame([(a, b) for h, a, b, w in rows if h == g and a is not None for _ in range(w[k])])
        assert n == len(drawn) and rho == pytest.approx(drawn[0].rank().corr(drawn[1].rank()), abs=1e-12)


def test_pair_counts(spark):
    from mixlume.operators import conflict

    rows = spark.createDataFrame([(1.0, 2.0, None), (3.0, 2.0, 1.0), (None, None, None), (1.0, 1.0, 4.0)], "b double, a double, c double")
    got = {tuple(r) for r in conflict.pair_counts(rows, ["b", "a", "c"]).collect()}
    assert got == {("a", "b", 4, 3, 3, 1), ("a", "c", 4, 3, 2, 1), ("b", "c", 4, 3, 2, 1)}
    assert conflict.pair_counts(rows.where("false"), ["a", "b"]).count() == 0


def test_weights_are_the_rows(spark):
    from mixlume.functions.expr import hash_uniform, poisson_one
    from mixlume.operators import resample

    df = spark.range(200).withColumnRenamed("id", "key")
    weights = {(r["key"], k): w for r in df.select("key", resample.poisson_weights("key", 3, "s", 1).alias("w")).collect() for k, w in enumerate(r["w"], 1)}
    plain = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("w", poisson_one(hash_uniform("s", F.col("rep"), F.col("key")))).collect()
    assert weights == {(r["key"], r["rep"]): r["w"] for r in plain}
    assert resample.poisson_rows(df, "key", 4, "s").where("rep > 0").count() == sum(weights.values())
