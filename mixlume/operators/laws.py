"""Scaling laws with quality terms from sums of products: one pass gives the moments of a whole grid of exponents, for all families, folds and bootstrap replicates at once."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, poisson_one
from mixlume.sources.io import cut

#: Bounds of exponents, points of the first grid between them, and how much finer each further grid is. Six grids are within 2e-4 of the exponent, relatively.
LEAST, MOST, FIRST, FINER, PASSES = 0.02, 1.5, 24, 4, 6
#: Families of the term that quality adds to e + a n^-alpha + b d^-beta.
FAMILIES = {"none": None, "linear": "linear", "log": "log"}
#: Levels that an axis may have: their moments are gathered.
LEVELS = 1000


def quality_term(q: Column, family: str) -> Column:
    """linear: 1 - q; log: -ln q; none: 0."""
    return {"none": F.lit(0.0), "linear": 1 - q, "log": -F.ln(q)}[family]


Fit = tuple[str, str]  # (axis, level)


def _grams(rows: DataFrame, grids: list[tuple[np.ndarray, np.ndarray, set[Fit] | None]], extra: list[str], axes: list[str], reps: int) -> dict[tuple[int, str, str], np.ndarray]:
    """(number of the grid, axis, level) -> two matrices: sums of products of (n^-alpha for each alpha, d^-beta for each beta, 1, extra terms, y), weighted and plain.

    A grid (alphas, betas, levels) is wanted for its levels (None: all that occur) and for all rows. A task multiplies matrices of some thousand rows and adds up; what is shuffled are its sums.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, str, str], np.ndarray] = {}
        for batch in batches:
            n, d, w = (batch[c].to_numpy(float) for c in ("n", "d", "w"))
            places = {(axis, str(level)): at for axis in axes for level, at in batch.groupby(axis, sort=False).indices.items()}
            drawn = np.stack(batch["drawn"].to_numpy()) if reps else None
            for k, (alphas, betas, levels) in enumerate(grids):
                z = np.column_stack([n[:, None] ** -alphas[None, :], d[:, None] ** -betas[None, :], np.ones(len(n)), *[batch[c].to_numpy(float) for c in (*extra, "y")]])
                for (axis, level), at in places.items():
                    if levels is None or axis == "full" or (axis, level) in levels:
                        part = z[at]
                        sums[k, axis, level] = sums.get((k, axis, level), 0) + np.stack([part.T @ (part * w[at, None]), part.T @ part])
                for r in range(reps):
                    if levels is None or ("replicate", str(r)) in levels:
                        sums[k, "replicate", str(r)] = sums.get((k, "replicate", str(r)), 0) + np.stack([z.T @ (z * (w * drawn[:, r])[:, None]), np.zeros((z.shape[1],) * 2)])
        if sums:
            yield pd.DataFrame([(*at, g.ravel().tolist()) for at, g in sums.items()], columns=["grid", "axis", "level", "g"])

    parts = rows.mapInPandas(run, "grid int, axis string, level string, g array<double>").select("grid", "axis", "level", F.posexplode("g").alias("k", "v"))
    total = parts.groupBy("grid", "axis", "level", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for at, g in total.groupby(["grid", "axis", "level"]):
        flat = np.zeros(len(g))
        flat[g["k"].to_numpy()] = g["v"].to_numpy()
        size = int(round(np.sqrt(len(g) / 2)))
        out[at] = flat.reshape(2, size, size)
    return out


def _best(g: np.ndarray, alphas: np.ndarray, betas: np.ndarray, extra: list[int]) -> tuple | None:
    """(error, index of alpha, index of beta, amplitudes) of the pair of exponents with the least weighted error among those of positive amplitudes."""
    m, n = len(alphas), len(betas)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(m), np.arange(n), indexing="ij"))
    use = np.stack([np.full(len(i), m + n), i, m + j, *[np.full(len(i), m + n + 1 + e) for e in extra]], axis=1)
    y = g.shape[0] - 1
    a, b = g[use[:, :, None], use[:, None, :]], g[use, y]
    scale = np.sqrt(np.einsum("kii->ki", a))
    scale[scale == 0] = 1
    scaled = a / scale[:, :, None] / scale[:, None, :]
    good = np.linalg.cond(scaled) < 1e13
    beta = np.full(b.shape, -1.0)
    beta[good] = np.linalg.solve(scaled[good], (b / scale)[good][..., None])[..., 0] / scale[good]
    error = g[y, y] - 2 * np.einsum("ki,ki->k", beta, b) + np.einsum("ki,kij,kj->k", beta, a, beta)
    error = np.where((beta > 0).all(axis=1), np.maximum(error, 0), np.inf)
    k = int(np.argmin(error))
    return (float(error[k] / g[m + n, m + n]), int(i[k]), int(j[k]), beta[k]) if np.isfinite(error[k]) else None


def fit_folds(points: DataFrame, families: list[str], axes: dict[str, Column], weight: Column | None = None, reps: int = 0, cluster: Column | None = None, seed: str = "law") -> list[dict]:
    """A dict for each family and fit: axis, level, status, e, a, alpha, b, beta, g (of the family's term), train_rows, test_rows, rmse (on the held rows; of all for the full fit).

    points: n, d, y and, for families with a quality term, q in (0, 1]. axes: the columns whose levels are held out one at a time ("full" holds out none); a level that is NULL is never held out,
    so a train/test split is an axis with one level. With reps, whole clusters are drawn ("replicate"). The error is the weighted mean of squares; amplitudes must be positive; exponents lie
    between LEAST and MOST, on a grid in their logarithms that zooms in for each fit.
    """
    used = [f for f in FAMILIES if f in families and FAMILIES[f]]
    q = F.col("q") if used else F.lit(1.0)
    drawn = [F.array(*[poisson_one(hash_uniform(seed, F.lit(r), cluster)).cast("double") for r in range(reps)]).alias("drawn")] if reps else []
    every = {**axes, "full": F.lit("all")}
    rows = points.select("n", "d", "y", (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), *[quality_term(q, f).alias(f"x_{f}") for f in used], *[c.cast("string").alias(k) for k, c in every.items()], *drawn)
    rows = cut(rows.where("n > 0 and d > 0 and y is not null and not isnan(y)" + "".join(f" and x_{f} is not null and not isnan(x_{f}) and x_{f} < double('infinity')" for f in used)), "law-points")
    for k in axes:
        if rows.select(k).distinct().limit(LEVELS + 1).count() > LEVELS:
            raise ValueError(f"axis {k} has more than {LEVELS} levels")
    step = (np.log(MOST) - np.log(LEAST)) / (FIRST - 1)
    fits: dict[tuple[str, str, str], dict] = {}
    windows: dict[tuple[str, str, str], tuple[tuple[int, ...], tuple[int, ...]]] = {}  # lattice points of alpha and beta that each fit looks at next
    for k in range(PASSES):
        shared: dict[tuple, set[Fit] | None] = {}
        for (_, axis, level), w in windows.items():
            shared.setdefault(w, set()).add((axis, level))
        if not k:
            shared[tuple(range(FIRST)), tuple(range(FIRST))] = None
        top = (FIRST - 1) * FINER**k
        lattices = list(shared)
        exponents = [tuple(np.exp(np.log(LEAST) + step / FINER**k * np.array(x)) for x in w) for w in lattices]
        g = _grams(rows, [(*x, shared[w]) for x, w in zip(exponents, lattices)], [f"x_{f}" for f in used], list(every), reps)
        if not g:
            return []
        if not k:
            windows = {(f, axis, level): lattices[0] for f in families for _, axis, level in g}
        for at, w in list(windows.items()):
            f, axis, level = at
            number = lattices.index(w)
            alphas, betas = exponents[number]
            m = len(alphas) + len(betas)  # where the constant stands
            whole, own = g[number, "full", "all"], g[number, axis, level]
            everything = axis in ("full", "replicate")
            extra = [used.index(f)] if f in used else []
            found = _best((whole if axis == "full" else own if axis == "replicate" else whole - own)[0], alphas, betas, extra)
            if found is None:
                fits[at] = {"family": f, "axis": axis, "level": level, "status": "NO_POSITIVE_FIT"}
                del windows[at]
                continue
            _, i, j, amplitudes = found
            test = whole[1] if everything else own[1]
            use = [m, i, len(alphas) + j, *[m + 1 + e for e in extra], test.shape[0] - 1]
            v, n_all, n_test = np.append(amplitudes, -1.0), whole[1][m, m], test[m, m]
            fits[at] = {
                "family": f, "axis": axis, "level": level, "status": "AT_BOUND" if w[0][i] in (0, top) or w[1][j] in (0, top) else "OK", "e": float(amplitudes[0]), "a": float(amplitudes[1]), "alpha": float(alphas[i]),
                "b": float(amplitudes[2]), "beta": float(betas[j]), "g": float(amplitudes[3]) if extra else None, "train_rows": int(n_all if everything else n_all - n_test), "test_rows": int(n_test),
                "rmse": float(np.sqrt(max(0.0, v @ test[np.ix_(use, use)] @ v) / n_test)) if n_test else None,
            }
            windows[at] = tuple(tuple(range(max(0, FINER * (x - 1)), min(top * FINER, FINER * (x + 1)) + 1)) for x in (w[0][i], w[1][j]))
        if not windows:
            break
    return list(fits.values())


FIT = "family string, axis string, level string, status string, e double, a double, alpha double, b double, beta double, g double, train_rows long, test_rows long, rmse double"


def as_table(spark, fits: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in FIT.split(", ")]
    return spark.createDataFrame([tuple(f.get(c) for c in names) for f in fits], FIT)


def family_panel(points: DataFrame, axes: dict[str, Column], families: tuple[str, ...] = tuple(FAMILIES)) -> tuple[DataFrame, DataFrame]:
    """(all fits, and family, selection_score, selected): a family's score is the mean over axes of the mean error over held levels; a family with a fold that has no fit has none."""
    fits = as_table(points.sparkSession, fit_folds(points, list(families), axes))
    held = fits.where("axis <> 'full'").groupBy("family", "axis").agg(F.avg("rmse").alias("m"), F.count_if(F.col("rmse").isNull()).alias("lost"))
    score = held.groupBy("family").agg(F.when(F.sum("lost") == 0, F.avg("m")).alias("selection_score"))
    best = score.where("selection_score is not null").agg(F.min_by("family", F.struct(F.round("selection_score", 9), "family")).alias("best"))
    return fits, score.crossJoin(best).select("family", "selection_score", F.coalesce(F.col("family") == F.col("best"), F.lit(False)).alias("selected"))


def _constrained(h: np.ndarray, c: np.ndarray, corners: np.ndarray, least: float) -> np.ndarray | None:
    """The minimum of x h x / 2 - c x with corners @ x >= least: of all sets of active corners, the one whose solution is feasible with multipliers that aren't negative."""
    k = len(c)
    best = None
    for count in range(k + 1):
        for active in itertools.combinations(range(len(corners)), count):
            a = corners[list(active)]
            system = np.block([[h, -a.T], [a, np.zeros((count, count))]]) if count else h
            try:
                x = np.linalg.solve(system, np.concatenate([c, np.full(count, least)]))
            except np.linalg.LinAlgError:
                continue
            if (corners @ x[:k] >= least - 1e-9).all() and (x[k:] >= -1e-9).all():
                value = x[:k] @ h @ x[:k] / 2 - c @ x[:k]
                if best is None or value < best[0] - 1e-15:
                    best = value, x[:k]
        if best is not None:
            return best[1]
    return None


def quality_increment(points: DataFrame, backbone: Column, ridges: tuple[float, ...], axes: dict[str, Column], sizes: tuple[float, float], tokens: tuple[float, float], least: float = 1e-8) -> DataFrame:
    """axis, level, ridge, g0, g1, g2, active, train_rows, test_rows, rmse: what lacking quality adds to a fixed backbone, (1 - q)(g0 + g1 ln n + g2 ln(d / 100)), kept at least ``least`` at
    the corners of sizes x tokens; ridge on g1 and g2 alone.

    For each held level the ridge is that of the least mean error over the other levels of its axis, each held out in turn ("full": over all axes); ties go to the smaller ridge. ``active``:
    whether a corner binds. One pass gives the sums of products of each level of each axis; all training parts are differences of them.
    """
    lack = 1 - F.col("q")
    z = [lack, lack * F.ln("n"), lack * F.ln(F.col("d") / 100), F.col("y") - backbone]
    every = {**axes, "full": F.lit("all")}
    rows = points.where("n > 0 and d > 0 and q is not null and y is not null").select(*[x.alias(f"z{i}") for i, x in enumerate(z)], F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), c.cast("string").alias("level")) for k, c in every.items()])).alias("at"))
    sums = rows.where("at.level is not null").groupBy("at.axis", "at.level").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i in range(4) for j in range(i, 4)]).alias("g"))
    corners = np.array([[1.0, np.log(n), np.log(d / 100)] for n in sizes for d in tokens])
    schema = "axis string, level string, ridge double, g0 double, g1 double, g2 double, active boolean, train_rows long, test_rows long, rmse double"

    def fit(g: np.ndarray, ridge: float) -> np.ndarray | None:
        h = g[:3, :3] + np.diag([0.0, ridge, ridge])
        if np.linalg.matrix_rank(h / max(1e-300, abs(h).max()), tol=1e-13) < 3:
            return None
        x = np.linalg.solve(h, g[:3, 3])
        return x if (corners @ x).min() >= least else _constrained(h, g[:3, 3], corners, least)

    def error(g: np.ndarray, n: float, x: np.ndarray | None) -> float:
        v = None if x is None else np.append(x, -1.0)
        return float("inf") if v is None else float(np.sqrt(max(0.0, v @ g @ v) / n))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        cells: dict[str, dict[str, tuple[float, np.ndarray]]] = {}
        for axis, level, n, flat in zip(group["axis"], group["level"], group["n"], group["g"]):
            m = np.zeros((4, 4))
            m[np.triu_indices(4)] = flat
            cells.setdefault(axis, {})[level] = (float(n), m + np.triu(m, 1).T)
        n_all, whole = cells["full"]["all"]
        inner = lambda levels, base, ridge: [error(g, n, fit(base - g, ridge)) for n, g in levels]
        choose = lambda scores: min(ridges, key=lambda r: (round(float(np.mean(scores(r))), 12), r))
        out = []
        for axis, levels in cells.items():
            for level, (n, g) in levels.items():
                if axis == "full":
                    train, test, size = whole, whole, n_all
                    ridge = choose(lambda r: [e for k, own in cells.items() if k != "full" for e in inner(own.values(), whole, r)] or [0.0])
                else:
                    train, test, size = whole - g, g, n
                    others = [x for other, x in levels.items() if other != level]
                    ridge = choose(lambda r: inner(others, train, r) or [0.0])  # noqa: B023
                x = fit(train, ridge)
                if x is not None:
                    out.append((axis, level, float(ridge), *map(float, x), bool((corners @ x).min() < least + 1e-7), int(n_all - (0 if axis == "full" else n)), int(size), error(test, size, x)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return sums.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(solve, schema)
