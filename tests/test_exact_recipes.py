"""Recipes whose mean losses meet limits, halves and each other exactly, with lines in every order: query and SQL agree, as sums are exact."""

from __future__ import annotations

from itertools import permutations

import duckdb
import pandas as pd
import pytest

from mixlume.plans import registry

TAXES, DISCOUNTS, QUANTITIES = (0.01, 0.02, 0.06, 0.07), (0.01, 0.02, 0.03, 0.05), (28.0, 29.0, 28.0, 28.0)  # means 0.04, 0.0275 and 28.25: ten fiftieths of it are 5.65


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("exact")
    orders, lines = [], []
    for c, (taxes, discounts) in enumerate(zip(permutations(TAXES), permutations(DISCOUNTS))):
        for k, q in enumerate(QUANTITIES):
            orders.append((10 * c + k, c))
            lines.append((10 * c + k, k % 3, q, 1000.1 + c, discounts[k], taxes[k]))
    pd.DataFrame(orders, columns=["o_orderkey", "o_custkey"]).to_parquet(d / "orders.parquet")
    pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]).to_parquet(d / "lineitem.parquet")
    pd.DataFrame([(0, "PROMO"), (1, "SMALL"), (2, "LARGE")], columns=["p_partkey", "p_type"]).to_parquet(d / "part.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["g15_protected_target", "g4_regimes", "g5_bounded_optimum", "m22_m23_m26_conditional_loss", "j12_pareto_front"])
def test_ties(spark, folder, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, folder)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_exact_means(spark, folder):
    from mixlume.plans.entities import recipes

    rows = recipes(spark, folder).collect()
    assert len(rows) == 24 and {(r["loss_a"], r["loss_b"], r["loss_c"]) for r in rows} == {(0.0275, 0.04, 0.565)}
