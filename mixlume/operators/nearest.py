"""Exact nearest rows through k-d cells: distances to cells' boxes leave few cells to look into, for a few queries or for all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixlume.sources.io import cut

#: Points that a cell is meant to hold, the most cells (their boxes go to all tasks: 2 ** 14 of them in six columns are 1.6 MB), and the questions that one task asks a cell.
LEAF, MOST_CELLS, ASKED = 2048, 1 << 14, 4096


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Column and value of each split of a tree of ``depth`` levels, in the order of a heap: the widest column at its median."""
    column, value = np.zeros(2**depth, np.int64), np.zeros(2**depth)
    parts = {1: sample}
    for node in range(1, 2**depth):
        x = parts.pop(node)
        if len(x):
            column[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            value[node] = float(np.median(x[:, column[node]]))
        below = x[:, column[node]] <= value[node]
        parts[2 * node], parts[2 * node + 1] = x[below], x[~below]
    return column, value


def _cell(x: np.ndarray, column: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    at = np.ones(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + (x[np.arange(len(x)), column[at]] > value[at])
    return at


def nearest(queries: DataFrame, reference: DataFrame, key: str, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """key, nearest, distance (L2) of each query to the reference rows but that of its own key; ties (to 9 digits) go to the smaller key.

    Reference rows of one vector are one point with their two smallest keys, so repeated rows don't crowd a cell. Cells are those of a k-d tree on a sample of about twenty points a cell, their
    boxes are exact. A query's cell gives a distance, and only cells whose boxes are as near as that are looked into. A cell that many ask is asked by several tasks. All reference rows and
    queries take part; rows with a NULL or NaN coordinate are near nothing: such queries, and those without any other row, get NULL.
    """
    names = [f"_x{i}" for i in range(len(columns))]
    whole = " and ".join(f"{c} is not null and not isnan({c})" for c in names)

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("_q"), *[(F.col(c).cast("double") + 0.0).alias(n) for c, n in zip(columns, names)])  # -0.0 becomes 0.0

    kind = dict(queries.dtypes)[key]
    ranked = plain(reference).where(whole).where("_q is not null").withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_q"))).where("_r <= 2")
    points = cut(ranked.groupBy(*names).agg(F.min("_q").alias("_a"), F.min(F.when(F.col("_r") == 2, F.col("_q"))).alias("_b")), "points")
    n = points.count()
    depth = min(int(np.log2(MOST_CELLS)), max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
    every = max(1, n // (20 * 2**depth))
    sample = points.where(F.pmod(F.xxhash64(*names), F.lit(every)) == 0).select(*names).toPandas().to_numpy() if depth else np.zeros((0, len(names)))
    column, value = _tree(sample, depth)

    def placed(df: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", _cell long"

        def run(batches):
            for batch in batches:
                yield batch.assign(_cell=_cell(batch[names].to_numpy(), column, value, depth))

        return df.mapInPandas(run, schema)

    cells = cut(placed(points), "cells")
    boxes = cells.groupBy("_cell").agg(*[F.min(c).alias(f"l{c}") for c in names], *[F.max(c).alias(f"h{c}") for c in names]).toPandas()  # one row for each cell
    number = boxes["_cell"].to_numpy()
    low, high = (boxes[[f"{s}{c}" for c in names]].to_numpy() for s in "lh")
    asked = cut(placed(plain(queries).where(whole)), "asked")
    first = _look(cells, asked, names, kind)
    bound = cut(asked.join(first, "_q", "left").select("_q", *names, "_cell", "_near", "_d"), "bounds")

    def visits(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                x, own, d = part[names].to_numpy(), part["_cell"].to_numpy(), part["_d"].fillna(np.inf).to_numpy()
                gap = np.zeros((len(part), len(number)))
                for k in range(len(names)):
                    gap += np.maximum(0, np.maximum(low[None, :, k] - x[:, None, k], x[:, None, k] - high[None, :, k])) ** 2
                i, j = np.nonzero((np.sqrt(gap) <= d[:, None] + 2e-9) & (number[None, :] != own[:, None]))
                yield part.iloc[i].assign(_cell=number[j])[["_q", *names, "_cell"]]

    more = cut(bound.mapInPandas(visits, f"_q {kind}, " + ", ".join(f"{c} double" for c in names) + ", _cell long"), "visits")
    found = bound.select("_q", "_near", "_d").where("_near is not null").unionByName(_look(cells, more, names, kind))
    best = found.groupBy("_q").agg(F.min(F.struct(F.round("_d", 9).alias("r"), "_near", "_d")).alias("_m"), F.min("_d").alias("distance"))
    return queries.select(key).join(best, F.col(key) == F.col("_q"), "left").select(key, F.col("_m._near").alias("nearest"), "distance")


def _look(cells: DataFrame, asks: DataFrame, names: list[str], kind: str) -> DataFrame:
    """_q, _near, _d: for each question (_q, vector, _cell) the nearest point of the cell, if it has one of another key."""
    parts = asks.groupBy("_cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_parts"))
    mine = asks.join(parts, "_cell").withColumn("_part", F.pmod(F.xxhash64("_q"), F.col("_parts")).cast("int"))
    theirs = cells.join(parts.toDF("_cell", "_of"), "_cell").select(F.col("_cell").alias("_at"), *names, "_a", "_b", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_copy"))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, y = left[names].to_numpy(), right[names].to_numpy()
        a, b, q = right["_a"].to_numpy(), right["_b"].to_numpy(), left["_q"].to_numpy()
        for at in range(0, len(x) if len(y) else 0, 256):
            rows = slice(at, at + 256)
            d = np.zeros((len(x[rows]), len(y)))
            for k in range(len(names)):
                d += (x[rows, k, None] - y[None, :, k]) ** 2
            d = np.sqrt(d)
            own = q[rows, None] == a[None, :]
            d[own & pd.isna(b)[None, :]] = np.inf
            near = np.where(own, b[None, :], a[None, :])
            least = np.round(d, 9).min(axis=1)
            for i in np.flatnonzero(np.isfinite(least)):
                ties = np.flatnonzero(np.round(d[i], 9) == least[i])
                k = min(ties, key=lambda j: near[i, j])  # noqa: B023
                out.append((q[at + i], near[i, k], float(d[i, ties].min())))
        return pd.DataFrame(out, columns=["_q", "_near", "_d"])

    schema = f"_q {kind}, _near {kind}, _d double"
    return mine.groupBy("_cell", "_part").cogroup(theirs.groupBy("_at", "_copy")).applyInPandas(look, schema)
