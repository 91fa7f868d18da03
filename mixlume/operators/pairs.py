"""Counts over pairs of rows that are ordered alike in several columns, without making the pairs; and the front of undominated rows that follows from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.sources.io import cut

#: Rows of a block (a task compares a block with itself), and the most blocks that a group is parted into along each column (a power of two). Cells of blocks are at most MOST ** columns.
BLOCK, MOST = 16384, 64


def _below(ranks: list[np.ndarray], group: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row, the sum of ``low`` over rows of its group that have a smaller rank in each column; 0 where ``high`` isn't set.

    The last column's ranks are taken bit by bit: two ranks differ first at one bit, and there the rows part in a lower and an upper half of one group more. One column is a running sum.
    """
    out = np.zeros(len(low), np.int64)
    if not (low.any() and high.any()):
        return out
    if len(ranks) == 1:
        order = np.lexsort((ranks[0], group))
        sums, own = np.cumsum(low[order]), group[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        base = np.repeat(np.concatenate([[0], sums[first[1:] - 1]]), np.diff(np.append(first, len(own))))
        out[order] = np.where(high[order], sums - base, 0)
        return out
    *rest, last = ranks
    bits = int(last.max()).bit_length()
    for b in range(bits):
        upper = (last >> b) & 1 == 1
        lows, highs = np.where(upper, 0, low), high & upper
        keep = (lows > 0) | highs
        node = (group[keep] << (bits - b)) | (last[keep] >> (b + 1))
        out[keep] += _below([r[keep] for r in rest], np.unique(node, return_inverse=True)[1], lows[keep], highs[keep])
    return out


def counts_in_memory(keys: list[np.ndarray], strict: list[bool], upper: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each upper row the weight of the lower rows whose keys are smaller (strict) or at most as large in all columns; 0 for lower rows."""
    ranks = []
    for key, s in zip(keys, strict):
        order = np.lexsort((~upper if s else upper, key))  # of equal keys, those that mustn't count come later
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key))
        ranks.append(rank)
    return _below(ranks, np.zeros(len(upper), np.int64), np.where(upper, 0, weight), upper)


def counts_below(rows: DataFrame, by: list[str], dims: list[tuple[str, str, bool]], row: str, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """row, n for each row: how many rows of its group, as lower ones, lie below it, as an upper one, in every column.

    dims: (the column that is the lower row's key, the one that is the upper row's key, whether the lower one must be smaller or only not larger). Keys are numbers without NULL and NaN;
    ``row`` names a unique column.

    A group is parted into blocks along each column by quantiles; keys that many rows share are spread over the blocks that they span, lower and upper rows in the order in which they count.
    So block numbers decide all pairs but those that share a block. These are counted in the task of the first column in which they do: each row goes to one task for each column, whatever
    the group's size. All other pairs are sums over cells of blocks. Nothing is replicated by pairs.
    """
    k = len(dims)
    keys = [f"_g{i}" for i in range(len(by))]
    sides = F.array(*[F.struct(F.lit(up).alias("_up"), *[F.col(dim[up]).cast("double").alias(f"_k{i}") for i, dim in enumerate(dims)]) for up in (0, 1)])
    both = rows.select(F.col(row).alias("_row"), *[F.col(c).alias(g) for c, g in zip(by, keys)], F.inline(sides)) if by else rows.select(F.col(row).alias("_row"), F.lit(0).alias("_g0"), F.inline(sides))
    keys = keys or ["_g0"]
    both = cut(both, "sides")
    quantiles = ", ".join(f"{i / most}D" for i in range(1, most))
    cuts = [F.expr(f"percentile_approx(_k{i}, array({quantiles}), 1000)").alias(f"_c{i}") for i in range(k)]
    groups = both.groupBy(*keys).agg(F.count("*").alias("_n"), *cuts)
    parts = F.least(F.lit(most), F.pow(2.0, F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_n") / (2 * block))))).cast("int"))
    groups = groups.withColumn("_parts", parts)
    groups = groups.select(*keys, "_parts", *[F.filter(f"_c{i}", lambda _, at: (at + 1) % F.floor(F.lit(most) / F.col("_parts")) == 0).alias(f"_c{i}") for i in range(k)])
    named = groups.withColumnsRenamed({g: f"{g}r" for g in keys})
    same = F.lit(True)
    for g in keys:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}r"))
    dealt = both.join(named, same)
    spread = F.xxhash64("_row", "_up")
    for i, (_, _, strict) in enumerate(dims):
        key = F.col(f"_k{i}")
        lo, hi = F.size(F.filter(f"_c{i}", lambda x: x < key)), F.size(F.filter(f"_c{i}", lambda x: x <= key))  # noqa: B023
        middle = F.floor((lo + hi) / 2)
        first = F.col("_up") == (1 if strict else 0)  # of equal keys, these come first
        dealt = dealt.withColumn(f"_b{i}", F.when(first, lo + F.pmod(spread, middle - lo + 1)).otherwise(middle + F.pmod(spread, hi - middle + 1)).cast("int"))
    dealt = cut(dealt.select("_row", *keys, "_up", "_parts", *[f"_k{i}" for i in range(k)], *[f"_b{i}" for i in range(k)]), "dealt")

    strict = [s for _, _, s in dims]

    def within(group: pd.DataFrame) -> pd.DataFrame:
        at, upper = int(group["_at"].iloc[0]), group["_up"].to_numpy() == 1
        columns = [group[f"_b{i}" if i < at else f"_k{i}"].to_numpy() for i in range(k)]
        n = counts_in_memory(columns, [i < at or s for i, s in enumerate(strict)], upper, np.ones(len(upper), np.int64))
        return pd.DataFrame({"_row": group["_row"].to_numpy()[n > 0], "n": n[n > 0]})

    def across(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["_parts"].iloc[0])
        low = np.zeros((size,) * k, np.int64)
        where = [group[f"_b{i}"].to_numpy() for i in range(k)]
        np.add.at(low, tuple(where), group["_low"].to_numpy())
        for axis in range(k):
            low = np.cumsum(low, axis=axis)
        inside = np.all([w > 0 for w in where], axis=0) & (group["_high"].to_numpy() > 0)
        cells = group[inside]
        n = low[tuple(w[inside] - 1 for w in where)]
        return cells.assign(n=n)[[*keys, *[f"_b{i}" for i in range(k)], "n"]]

    kind = dict(dealt.dtypes)
    tasks = dealt.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("_at"), F.col(f"_b{i}").alias("_block")) for i in range(k)])).alias("_task")).select("*", "_task.*").drop("_task")
    near = tasks.groupBy(*keys, "_at", "_block").applyInPandas(within, f"_row {kind['_row']}, n long")
    blocks = [f"_b{i}" for i in range(k)]
    cells = dealt.where("_parts > 1").groupBy(*keys, "_parts", *blocks).agg(F.count_if(F.col("_up") == 0).alias("_low"), F.count_if(F.col("_up") == 1).alias("_high"))
    far = cells.groupBy(*keys).applyInPandas(across, ", ".join([*[f"{g} {kind[g]}" for g in keys], *[f"{b} int" for b in blocks], "n long"]))
    uppers = dealt.where("_up = 1 and _parts > 1").select("_row", *keys, *blocks)
    match = F.lit(True)
    for c in [*keys, *blocks]:
        match = match & uppers[c].eqNullSafe(far[c])
    met = near.unionByName(uppers.join(far, match).select("_row", "n"))
    return rows.select(row).join(met.groupBy("_row").agg(F.sum("n").alias("n")), F.col(row) == F.col("_row"), "left").select(row, F.coalesce("n", F.lit(0)).alias("n"))


def count_cases(rows: DataFrame, by: list[str], cases: dict[str, list[tuple[Column, Column, bool]]], block: int = BLOCK) -> DataFrame:
    """by, and for each case the number of pairs of rows of a group that its columns order: (lower key, upper key, strict) as in counts_below(). Groups without pairs have zeros; NULL groups are a group.

    Rows with a NULL or NaN key in any case are left out.
    """
    every = [c for dims in cases.values() for a, b, _ in dims for c in (a, b)]
    whole = rows.select(*by, *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(every)])
    whole = whole.where(" and ".join(f"_v{i} is not null and not isnan(_v{i})" for i in range(len(every))))
    known = cut(whole.withColumn("_id", F.monotonically_increasing_id()), "cases")
    out, at = known.select(*by).distinct() if by else known.sparkSession.range(1).select(), 0
    for name, dims in cases.items():
        named = [(f"_v{at + 2 * i}", f"_v{at + 2 * i + 1}", s) for i, (_, _, s) in enumerate(dims)]
        at += 2 * len(dims)
        n = counts_below(known, by, named, "_id", block).withColumnRenamed("n", "_count")
        total = known.join(n, "_id").groupBy(*by).agg(F.sum("_count").alias(name)) if by else n.agg(F.coalesce(F.sum("_count"), F.lit(0)).alias(name))
        if by:
            total = total.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(by)})
            cond = F.lit(True)
            for i, c in enumerate(by):
                cond = cond & F.col(c).eqNullSafe(F.col(f"_r{i}"))
            out = out.join(total, cond).drop(*[f"_r{i}" for i in range(len(by))])
        else:
            out = out.crossJoin(total)  # one row each
    return out


def dominance_pairs(points: DataFrame, family: str, least: float, block: int = BLOCK) -> DataFrame:
    """family, pairs (one point larger in n and by ``least`` in d), agree (its loss is lower by 1e-9 or more); families without pairs have no row."""
    n, d, loss = F.col("n"), F.col("d"), F.round(F.col("loss") * 1e9)
    size, tokens = (n, n, True), (d + least, d, False)
    counted = count_cases(points, [family], {"pairs": [size, tokens], "agree": [size, tokens, (-loss, -loss, True)]}, block)
    return counted.where("pairs > 0")


def order_concordance(points: DataFrame, curve: str, x: str, actual: str, predicted: str, block: int = BLOCK) -> DataFrame:
    """curve, pairs, concordance, scored, order_share: over the pairs of a curve's points with x ascending, the share that the prediction orders alike (falling by 1e-9 or more, or not);
    and of ``scored`` pairs that differ in both values, the share in which both fall or both rise."""
    a, p = F.round(F.col(actual) * 1e9), F.round(F.col(predicted) * 1e9)
    up, falls, drops, rises, climbs = (F.col(x), F.col(x), True), (-a, -a, True), (-p, -p, True), (a, a, True), (p, p, True)
    cases = {"pairs": [up], "falls": [up, falls], "drops": [up, drops], "down": [up, falls, drops], "up": [up, rises, climbs], "fall_rise": [up, falls, climbs], "rise_fall": [up, rises, drops]}
    n = count_cases(points, [curve], cases, block).where("pairs > 0")
    alike = 2 * F.col("down") + F.col("pairs") - F.col("falls") - F.col("drops")
    scored = F.col("down") + F.col("up") + F.col("fall_rise") + F.col("rise_fall")
    return n.select(curve, "pairs", (alike / F.col("pairs")).alias("concordance"), scored.alias("scored"), ((F.col("down") + F.col("up")) / F.nullif(scored, F.lit(0))).alias("order_share"))


def slope_signs(points: DataFrame, curve: str, x: str, actual: str, predicted: str) -> DataFrame:
    """curve, slopes, accuracy: of the steps between neighbouring x of a curve in which the actual value moves, the share in which the prediction moves the same way. Rows of equal x are averaged first.

    Neighbours are found in ranges of x, each of which gets the last point of the range before: a curve isn't sorted in one task.
    """
    from mixlume.operators import stats

    rows = points.groupBy(curve, F.col(x).cast("double").alias("_x")).agg(F.avg(actual).alias("_a"), F.avg(predicted).alias("_p"))
    moved = stats.with_neighbour(rows, [curve], "_x", ["_a", "_p"])
    step = moved.select(curve, (F.col("_a") - F.col("_a_before")).alias("da"), (F.col("_p") - F.col("_p_before")).alias("dp")).where("abs(da) > 1e-9")
    return step.groupBy(curve).agg(F.count("*").alias("slopes"), F.avg((F.signum("da") == F.signum("dp")).cast("int")).alias("accuracy"))


def front(rows: DataFrame, targets: list[str], block: int = BLOCK, filters: int = 256) -> DataFrame:
    """Rows that no other row dominates (all targets at most as large, one smaller). Rows with a NULL or NaN target neither dominate nor are dominated; equal rows stay together.

    The ``filters`` distinct rows of the least sum of standardised targets (a bounded number, gathered) drop what they dominate on the way; of the rest, each row's number of rows at or below
    it decides: it is 1, the row itself, on the front. That takes the same work for a front of any size.
    """
    whole = " and ".join(f"`{t}` is not null and not isnan(`{t}`)" for t in targets)
    values = cut(rows.where(whole).select(*[F.col(t).cast("double").alias(f"_t{i}") for i, t in enumerate(targets)]).distinct(), "values")
    names = values.columns
    scale = values.agg(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(c) for c in names]).first()
    if scale is None or scale[0] is None:
        return rows
    best = values.orderBy(sum((F.col(c) / scale[c] for c in names[1:]), F.col(names[0]) / scale[names[0]]), *names).limit(filters)
    strong = np.array([[float(v) for v in r] for r in best.collect()]).reshape(-1, len(names))

    def undominated(batches):
        for batch in batches:
            v = batch.to_numpy()
            bad = np.zeros(len(v), bool)
            for s in strong:
                bad |= (s <= v).all(axis=1) & (s < v).any(axis=1)
            yield batch[~bad]

    rest = cut(values.mapInPandas(undominated, values.schema).withColumn("_id", F.monotonically_increasing_id()), "rest")
    n = counts_below(rest, [], [(c, c, False) for c in names], "_id", block)
    kept = rest.join(n.where("n = 1"), "_id").select(*names)
    cond = F.lit(True)
    for t, c in zip(targets, names):
        cond = cond & (F.col(t).cast("double") == F.col(c))
    return rows.where(whole).join(kept, cond, "left_semi").unionByName(rows.where(f"not ({whole})"))
