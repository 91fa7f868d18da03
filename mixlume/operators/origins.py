"""Forecasts of a score frontier from many past origins at once: candidates fitted on what each origin could see, tested on the months after it, compared, and carried into scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlume.functions.expr import bounded_logit, score_of_logit
from mixlume.operators import moments, stats
from mixlume.sources.io import cut

#: How much of its time drift each candidate keeps, and the share of the resources' growth that goes into size.
RETENTION = {"constant": 0.0, "frontier_trend": 1.0, "quantile_resource": 1.0, "mean_resource": 1.0}
ETA = 0.5
MONTH_DAYS = 365.25 / 12


def _month(day: Column) -> Column:
    """Months since year 0."""
    return F.year(day) * 12 + F.month(day) - 1


def _first_day(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


#: Ranges of scores that quantiles are counted in (a power of two).
PARTS = 256


def spans(versions: DataFrame, last: Column) -> DataFrame:
    """versions, written once, with the months (_month()) _m of its day, _a and _z, between which it is at each month's start, up to ``last``, the newest of its model and kind (_a > _z: at none),
    _next of the next version, _since of the first one, and _part: its range of scores.

    Nothing is exploded by months here; that is done where it is read, after what can be counted is counted. Scores of one part lie below those of later parts, so ranks within any group of rows
    are counts of parts.
    """
    model = Window.partitionBy("kind", "model")
    order = model.orderBy("day", "row_no")
    m = _month(F.col("day"))
    x = versions.select("kind", "model", "developer", "row_no", "day", "t", "log_n", "score", m.alias("_m"), _month(F.lead("day").over(order)).alias("_next"), F.min(m).over(model).alias("_since"))
    x = cut(x.withColumns({"_a": F.col("_m") + 1, "_z": F.least(F.coalesce("_next", _month(last)), _month(last))}), "versions")
    return cut(stats.dealt(x.withColumn("_all", F.lit(0)), ["_all"], "score", PARTS).withColumnRenamed("_range", "_part").drop("_all", "_cuts"), "spans")


def targets(part: DataFrame, months: int = 2) -> DataFrame:
    """Rows of spans() for each origin (at) in whose ``months`` they are the newest of their model."""
    return part.withColumn("at", F.explode(F.sequence(F.col("_m") - (months - 1), F.col("_m")))).where(F.col("_next").isNull() | (F.col("_next") >= F.col("at") + months))


KEY = ["at", "kind"]


def part_quantiles(x: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, n, q: rows and the exact q-quantile of the present scores of each group of x (_part as spans() gives it; read twice).

    Rows are counted by group and part; only those of the part that holds a group's quantile are then ordered. So no group's sketch or rows are shuffled.
    """
    placed = _placed(x.groupBy(*by, "_part").agg(F.count("*").alias("_rows"), F.count("score").alias("_c")), by, q)
    near = x.where("score is not null").join(F.broadcast(placed.select(*by, "_part", "_before", "_at")), [*by, "_part"])  # two parts for each group at most
    return _in_parts(near, placed, by)


def _placed(counts: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, _part, n, _before, _at of the parts that hold each group's quantile: its rows, its scores in earlier parts, and the quantile's place. counts: by, _part, _rows, _c (present scores)."""
    counts = cut(counts, "parts")
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("*", before.alias("_before"), (F.lit(float(q)) * (F.sum("_c").over(group) - 1)).alias("_at"), F.sum("_rows").over(group).alias("n"))
    held = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_c"))
    return cut(placed.where(held(F.floor("_at")) | held(F.ceil("_at")) | (F.col("_at") < 0)), "placed")


def _in_parts(near: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """by, n, q from the rows of the parts that _placed() gives, each with its _before and _at."""
    group = Window.partitionBy(*by)
    values = near.groupBy(*by, "score").agg(F.count("*").alias("_c"), F.min("_at").alias("_at"), F.min("_before").alias("_before"))
    up = group.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    inside = values.select(*by, "score", "_at", (F.sum("_c").over(up) + F.min("_before").over(group)).alias("_end"), "_c")
    at = lambda k: F.max(F.when((F.col("_end") - F.col("_c") <= k) & (k < F.col("_end")), F.col("score")))
    found = inside.groupBy(*by).agg(at(F.floor("_at")).alias("_x"), at(F.ceil("_at")).alias("_y"), F.min("_at").alias("_at"))
    value = F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_at") - F.floor("_at"))
    sizes = placed.groupBy(*by).agg(F.max("n").alias("n"))
    return sizes.join(found.select(*by, value.alias("q")), by, "left")


def month_ends(part: DataFrame) -> DataFrame:
    """at, kind, _month, end, t1, rows: of the newest versions at an origin those of each month: last day, last t and number."""
    x = part.where("_a <= _z").groupBy("kind", "_m", "_a", "_z").agg(F.max("day").alias("end"), F.max("t").alias("t1"), F.count("*").alias("rows"))
    x = x.withColumn("at", F.explode(F.sequence("_a", "_z")))
    return cut(x.groupBy(*KEY, F.col("_m").alias("_month")).agg(F.max("end").alias("end"), F.max("t1").alias("t1"), F.sum("rows").alias("rows")), "month_ends")


def windows(part: DataFrame, ends: DataFrame, q: float = 0.9, months: int = 2) -> DataFrame:
    """ends with n and q: number and q-quantile of the scores in the ``months`` before each end, of the versions that are the newest at the origin; written.

    A window holds all rows of its end's month and of those before it, so they are counted by month, span and part before anything is exploded by origins; only of the earliest month's rows the
    last days are compared with the end. Then rows are read again and joined with the parts that hold a quantile.
    """
    by = [*KEY, "_month"]
    own = part.where("_a <= _z")
    opened = F.add_months("end", -months)
    start = F.greatest("_a", F.col("_month") + 1)
    at_origins = lambda x: x.where(start <= F.col("_z")).withColumn("at", F.explode(F.sequence(start, F.col("_z"))))
    named = F.broadcast(ends.select(*by, "end"))  # months by months by kinds
    cells = own.groupBy("kind", "_m", "_a", "_z", "_part").agg(F.count("*").alias("_rows"), F.count("score").alias("_c"))
    whole = at_origins(cells.withColumn("_month", F.explode(F.sequence(F.col("_m"), F.col("_m") + (months - 1))))).join(named, by)
    first = ends.groupBy("kind", "_month").agg(F.min(opened).alias("_open"))
    late = own.withColumn("_month", F.col("_m") + months).join(F.broadcast(first), ["kind", "_month"]).where("day > _open")
    late = at_origins(late.groupBy("kind", "day", "_month", "_a", "_z", "_part").agg(F.count("*").alias("_rows"), F.count("score").alias("_c"))).join(named, by).where(F.col("day") > opened)
    both = whole.select(*by, "_part", "_rows", "_c").unionByName(late.select(*by, "_part", "_rows", "_c"))
    placed = _placed(both.groupBy(*by, "_part").agg(F.sum("_rows").alias("_rows"), F.sum("_c").alias("_c")), by, q)
    near = own.where("score is not null").select("kind", "day", "score", "_part", "_a", "_z", F.explode(F.sequence(F.col("_m"), F.col("_m") + months)).alias("_month"))
    near = near.join(F.broadcast(placed.join(named, by).select(*by, "_part", "_before", "_at", "end")), ["kind", "_month", "_part"]).where(F.col("at").between(F.col("_a"), F.col("_z")) & (F.col("day") > opened))
    return cut(ends.join(_in_parts(near, placed, by), by), "windows")


def anchors(part: DataFrame, seen: DataFrame, months: int = 2) -> DataFrame:
    """at, kind, end, t1 (the last day and t), score (the quantile of the ``months`` before the end), log_n (median size of the rows at or above it), n. seen: windows()."""
    late = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_month")))
    tops = seen.select(*KEY, "_month", F.max("t1").over(Window.partitionBy(*KEY)).alias("t1"), "end", "n", "q", late.alias("_r")).where("_r = 1").drop("_r")
    opened = tops.select(*KEY, "end", "q", F.explode(F.sequence(F.col("_month") - months, F.col("_month"))).alias("_m"))
    x = part.select("kind", "day", "score", "log_n", "_m", "_a", "_z").join(F.broadcast(opened), ["kind", "_m"]).where(F.col("at").between(F.col("_a"), F.col("_z")))  # the window's months only
    high = cut(x.where((F.col("day") > F.add_months("end", -months)) & (F.col("score") >= F.col("q"))).select(*KEY, "log_n"), "high")
    return tops.join(stats.quantiles(high, KEY, {"log_n": ("log_n", 0.5)}), KEY).select(*KEY, "end", "t1", F.col("q").alias("score"), "log_n", "n")


def trends(seen: DataFrame, least: int = 10) -> DataFrame:
    """at, kind, drift: the slope in t of the logit of the anchors at each month's end, where at least three months have ``least`` rows; else 0. seen: windows()."""
    z = seen.withColumn("z", F.when(F.col("n") >= least, bounded_logit(F.col("q"))))
    t1 = F.when(F.col("n") >= least, F.col("t1"))
    fits = z.groupBy(*KEY).agg(F.regr_slope("z", t1).alias("b"), F.count(t1).alias("m"))
    return fits.select(*KEY, F.when(F.col("m") >= 3, F.coalesce("b", F.lit(0.0))).otherwise(0.0).alias("drift"))


def _solved(sums: DataFrame, by: list[str]) -> DataFrame:
    """by, b0, b_size, b_t from sums of products of (1, log_n, t, z); groups whose design is rank-deficient have no row."""
    kinds = dict(sums.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    beta = moments.solve(list(row.g), 2, 1)[:, 0]
                except (ValueError, np.linalg.LinAlgError):
                    continue
                out.append((*[getattr(row, c) for c in by], *map(float, beta)))
            yield pd.DataFrame(out, columns=[*by, "b0", "b_size", "b_t"])

    return sums.select(*by, "g").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", b0 double, b_size double, b_t double")


def plane_fits(snap: DataFrame, by: list[str], q: float | None = None, passes: int = 30, near: float = 1e-3) -> DataFrame:
    """by, b0, b_size, b_t: z (logit of the score) on log_n and t for every group at once, by least squares, or with q by check loss."""
    return span_planes(snap.withColumns({"_a": F.lit(0), "_z": F.lit(0)}), by, [q], None, passes, near)[0].drop("at")


def span_planes(x: DataFrame, by: list[str], qs: list[float | None], groups: DataFrame | None = None, passes: int = 30, near: float = 1e-3) -> list[DataFrame]:
    """For each of qs by, at, b0, b_size, b_t: z (logit of the score) on log_n and t, by least squares (None) or check loss, over the rows whose _a to _z holds at; only for groups (by, at), if given.

    No row is exploded: sums of products are made by span first, and a pass of the check loss takes blocks of rows against the planes of all their ats as matrices.
    """
    data = cut(x.where("_a <= _z").select(*by, "_a", "_z", "log_n", "t", bounded_logit(F.col("score")).alias("z")).dropna(), "plane")
    each = moments.gram(data, [*by, "_a", "_z"], ["log_n", "t"], ["z"]).withColumn("at", F.explode(F.sequence("_a", "_z")))
    each = each if groups is None else each.join(F.broadcast(groups.select(*by, "at").distinct()), [*by, "at"])
    sums = cut(each.groupBy(*by, "at").agg(F.array(*[F.sum(F.col("g")[i]) for i in range(10)]).alias("g")), "sums")
    fit = cut(_solved(sums, [*by, "at"]), "fits")
    return [fit if q is None else _check_planes(data, by, fit, sums, q, passes, near) for q in qs]


class _Plane:
    """A group's plane on its way to the least check loss: beta is to be tried, best is the best one tried, with its loss and the next by reweighting (swept).
    ready: the last step was small beside window, the residual within which about CLOSE of the group's rows lie."""

    def __init__(self, beta: np.ndarray, g: list[float], near: float):
        m = moments.matrix(g, 4)
        left = m[3, 3] - m[3, :3] @ beta
        self.beta, self.near, self.n, self.width = beta, near, m[0, 0], max(near, float(np.sqrt(max(left, 0.0) / m[0, 0])))
        self.mean = m[:3, :3] / m[0, 0]  # of products, for the mean change of the fitted values
        self.best, self.least, self.swept, self.done, self.ready, self.window = beta, np.inf, beta, False, self.n <= CLOSE, np.inf
        self.finished, self.inner = 0, False  # times of _finished(), and whether beta is its least loss inside the window

    def took(self, s: np.ndarray, q: float, moved: float, rows: int = 50) -> None:
        """s: the sums of _check_sums() at beta."""
        fallen = self.least - s[0]
        if not fallen >= 0:  # a step too far: from the best one by reweighting, which never raises the loss
            self.beta, self.ready = self.swept, self.n <= CLOSE
        else:
            self.best, self.least, self.ready = self.beta, s[0], self.n <= CLOSE
            try:
                self.beta = self.swept = self.best + np.linalg.solve(moments.matrix(list(s[4:10]), 3), s[1:4])
                within = s[10] * self.width / max(q, 1 - q)  # so many rows at least
                if within >= rows:
                    change = np.linalg.solve(moments.matrix(list(s[10:16]), 3), s[1:4])
                    self.beta = self.best + change
                    size = float(np.sqrt(max(change @ self.mean @ change, 0.0)))
                    if self.n > CLOSE:
                        self.window = max(20 * self.near, self.width * CLOSE / within)
                        self.ready = 8 * size <= self.window
                    self.width = max(self.near, min(self.width, size), self.width * rows / within)
            except np.linalg.LinAlgError:
                pass
        still = not np.abs(self.beta - self.best).max() >= moved
        whole = self.n > CLOSE and not np.isfinite(self.window)  # never to be gathered
        self.done = still and whole or self.inner and fallen >= 0 and (still or self.finished > 1 and fallen <= 1e-7 * s[0])
        self.ready, self.inner = not whole and (self.ready or still), False


#: About so many of a group's rows, those next to its plane, are gathered to finish it.
CLOSE = 1500


def _check_planes(data: DataFrame, by: list[str], fit: DataFrame, sums: DataFrame, q: float, passes: int, near: float, moved: float = 1e-4) -> DataFrame:
    """The fits of fit moved to the least check loss, residuals of less than near counting by their square.

    Each pass is one read of data for all groups that still move by ``moved`` or more. It gives a step by reweighting, which lowers the loss but little, and a Newton step, whose matrix is from the
    rows within a width that shrinks with the steps; that step is taken back if the loss has risen. Once steps are small, _finished() gathers the rows next to the planes and moves the planes among
    them; the next pass, over all rows again, tells whether that is the least loss.
    """
    names = [*by, "at"]
    planes = {tuple(r[c] for c in names): _Plane(np.array([r["b0"], r["b_size"], r["b_t"]]), list(r["g"]), near) for r in fit.join(sums, names).collect()}  # a few numbers for each group

    def lines(some: dict[tuple, _Plane], width: str) -> dict[tuple, np.ndarray]:
        found: dict[tuple, list] = {}
        for key, p in some.items():
            found.setdefault(key[:-1], []).append((key[-1], *p.beta, getattr(p, width)))
        return {k: np.array(sorted(v)).T for k, v in found.items()}

    for k in range(passes):
        left = {key: p for key, p in planes.items() if not p.done}
        if not left:
            break
        ready = {key: p for key, p in left.items() if p.ready}
        if ready and (len(ready) == len(left) or k % 8 == 7):
            for r in _finished(data, by, lines(ready, "window"), q, near).collect():
                p = planes[tuple(r[c] for c in names)]
                p.beta, p.finished, p.inner = np.array(r["b"]), p.finished + 1, r["inner"]
        for r in _check_sums(data, by, lines(left, "width"), q, near).collect():
            planes[tuple(r[c] for c in names)].took(np.array(r["s"]), q, moved)
    kinds = dict(fit.dtypes)
    out = [(*key, *map(float, p.beta if p.done else p.best)) for key, p in planes.items()]
    return data.sparkSession.createDataFrame(out, ", ".join(f"{c} {kinds[c]}" for c in names) + ", b0 double, b_size double, b_t double")


def _finished(data: DataFrame, by: list[str], lines: dict[tuple, np.ndarray], q: float, near: float) -> DataFrame:
    """by, at, b, inner: planes of least check loss as long as no row beyond a group's window changes its side: such rows are summed (their gradient), only the rows within are gathered by group. Steps end at the window (not inner)."""
    kinds = ", ".join(f"{c} {k}" for c, k in data.select(*by).dtypes)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        beyond = {k: np.zeros((3, v.shape[1])) for k, v in lines.items()}
        for batch in batches:
            for key, own in batch.groupby(by, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key not in lines:
                    continue
                a, z, u, v, y = (batch[c].to_numpy()[own] for c in ("_a", "_z", "log_n", "t", "z"))
                x, ats, window = np.array([np.ones(len(a)), u, v]), lines[key][0], lines[key][4]
                for i in range(len(ats)):
                    held = (a <= ats[i]) & (z >= ats[i])
                    r = y - lines[key][1:4, i] @ x
                    far = held & (np.abs(r) > window[i])
                    beyond[key][:, i] += x[:, far] @ np.where(r[far] > 0, q, q - 1)
                    close = held & ~far
                    if close.any():
                        yield pd.DataFrame({c: k for c, k in zip(by, key)} | {"at": int(ats[i]), "far": False, "u": u[close], "v": v[close], "y": y[close]})
        for key, s in beyond.items():
            yield pd.DataFrame({c: k for c, k in zip(by, key)} | {"at": lines[key][0].astype(int), "far": True, "u": s[0], "v": s[1], "y": s[2]})

    def solved(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        line = lines[tuple(key[:-1])]
        start = line[1:4, list(line[0]).index(key[-1])]
        g = rows.loc[rows.far, ["u", "v", "y"]].to_numpy().sum(0)
        own = rows[~rows.far]
        x, y = np.array([np.ones(len(own)), own.u, own.v]), own.y.to_numpy()
        m = np.vstack([x, y]) @ np.vstack([x, y]).T
        p = _Plane(start, list(m[np.triu_indices(4)]), near) if len(own) else None
        span = np.zeros(len(own), dtype=int)
        for _ in range(600 if p else 0):
            s = np.zeros((16, 1))
            _add_sums(s, np.array([[0.0], *[[b] for b in p.beta], [p.width]]), q, near, span, span, x[1], x[2], y)
            s[0] -= g @ (p.beta - start)
            s[1:4, 0] += g
            p.took(s[:, 0], q, 1e-7, 12)
            if p.done:
                break
        step = (p.best if p else start) - start
        share = line[4, list(line[0]).index(key[-1])] / max(np.abs(step @ x).max(initial=0.0), 1e-300)  # of the step that stays within the window
        return pd.DataFrame([(*key, (start + min(1.0, share) * step).tolist(), bool(share > 1))], columns=[*by, "at", "b", "inner"])

    close = data.mapInPandas(part, kinds + ", at int, far boolean, u double, v double, y double")
    return close.groupBy(*by, "at").applyInPandas(solved, kinds + ", at int, b array<double>, inner boolean")


def _check_sums(data: DataFrame, by: list[str], lines: dict[tuple, np.ndarray], q: float, near: float) -> DataFrame:
    """by, at, s: over the rows of each at the check loss (within near by squares), its gradient, and the upper triangles of the matrices of a step by reweighting and of Newton's with its width.
    lines: for each by its sorted ats, their planes and widths, as rows."""
    schema = ", ".join(f"{c} {k}" for c, k in data.select(*by).dtypes) + ", at int, s array<double>"
    first, last = min(v[0, 0] for v in lines.values()), max(v[0, -1] for v in lines.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((16, v.shape[1])) for k, v in lines.items()}
        for batch in batches:
            for key, own in batch.groupby(by, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key in lines:
                    _add_sums(total[key], lines[key], q, near, *[batch[c].to_numpy()[own] for c in ("_a", "_z", "log_n", "t", "z")])
        out = [(*k, int(at), s.tolist()) for k, v in total.items() for at, s in zip(lines[k][0], v.T) if s.any()]
        yield pd.DataFrame(out, columns=[*by, "at", "s"])

    parts = data.where((F.col("_a") <= int(last)) & (F.col("_z") >= int(first))).mapInPandas(run, schema)
    return parts.groupBy(*by, "at").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(16)]).alias("s"))


def _add_sums(total: np.ndarray, line: np.ndarray, q: float, near: float, a: np.ndarray, z: np.ndarray, size: np.ndarray, t: np.ndarray, y: np.ndarray, block: int = 1 << 14) -> None:
    """Adds the sums of _check_sums() of rows (their _a, _z, log_n, t, z) to a line's (16, ats). Rows of like spans meet their ats' planes as matrices of ``block`` numbers, which stay in a core's cache."""
    ats, width = line[0], line[4]
    order = np.lexsort((z, a))
    a, z, y = a[order], z[order], y[order]
    one, u, v = np.ones(len(a)), size[order], t[order]
    terms = np.array([one, u, v, u * u, u * v, v * v])
    step = max(1, block // len(ats))
    for i in range(0, len(a), step):
        k = slice(i, i + step)
        lo, hi = np.searchsorted(ats, a[i]), np.searchsorted(ats, z[k].max(), "right")
        if lo >= hi:
            continue
        x = terms[:, k]
        r = y[k][:, None] - x[:3].T @ line[1:4, lo:hi]
        held = (a[k][:, None] <= ats[lo:hi]) & (z[k][:, None] >= ats[lo:hi])
        c = np.where(r > 0, q, 1 - q)
        c *= held
        off = np.abs(r)
        wide = np.maximum(off, near)
        w = c / wide
        s = total[:, lo:hi]
        s[4:10] += x @ w
        s[1:4] += x[:3] @ (w * r)
        off *= off  # within near r^2 / (2 near), else |r| - near / 2: half of wide + r^2 / wide, less near / 2 beyond near
        off /= wide
        off += wide
        off -= near
        s[0] += np.einsum("ij,ij->j", c, off) / 2
        s[10:16] += x @ (c * (np.abs(r) <= width[lo:hi])) / width[lo:hi]


def candidates(part: DataFrame, seen: DataFrame, q: float = 0.9) -> DataFrame:
    """at, kind, candidate, b_size, b_t of four candidates: constant, frontier_trend (the drift of the monthly frontier), and quantile_resource and mean_resource (planes in size and time).
    Groups whose design is rank-deficient have no planes. part: spans(); seen: windows() of the origins that are asked for."""
    groups = cut(seen.select(*KEY).distinct(), "groups")
    flat = groups.select(*KEY, F.lit("constant").alias("candidate"), F.lit(0.0).alias("b_size"), F.lit(0.0).alias("b_t"))
    trend = trends(seen).select(*KEY, F.lit("frontier_trend").alias("candidate"), F.lit(0.0).alias("b_size"), F.col("drift").alias("b_t"))
    found = zip(("quantile_resource", "mean_resource"), span_planes(part, ["kind"], [q, None], groups))
    planes = [x.select(*KEY, F.lit(name).alias("candidate"), "b_size", "b_t") for name, x in found]
    return flat.unionByName(trend).unionByName(planes[0]).unionByName(planes[1])


def predicted(score: Column, horizon: Column, growth: Column, eta: Column, retention: Column) -> Column:
    """The anchor's score, moved on the logit scale by size (its share eta of the resources' yearly growth) and by the drift that is kept. Needs b_size and b_t."""
    return score_of_logit(bounded_logit(score) + F.col("b_size") * eta * growth * horizon / 12 + retention * F.col("b_t") * horizon)


def _retention() -> Column:
    out = F.lit(None).cast("double")
    for name, value in RETENTION.items():
        out = F.when(F.col("candidate") == name, value).otherwise(out)
    return out


def backtest(versions: DataFrame, growth: float, months: int = 2, least_train: int = 30, least_test: int = 10, history: int = 4) -> DataFrame:
    """origin, kind, candidate, train_n, test_n, actual, predicted, horizon, model_overlap, developer_overlap: each candidate at each origin against the frontier of the ``months`` after it.

    versions: row_no, model, day, t, kind, developer, log_n, score. An origin needs ``history`` months before it, ``least_train`` models before, ``least_test`` after, and data up to the end of its
    target. growth is the resources' yearly growth in powers of ten.
    """
    kinds = versions.groupBy("kind").agg(F.min("day").alias("_from"), F.max("day").alias("_to"))
    last = versions.agg(F.max("day").alias("d")).first()["d"]
    if last is None:
        return versions.sparkSession.createDataFrame([], "origin date, kind string, candidate string, train_n long, test_n long, actual double, predicted double, horizon double, model_overlap double, developer_overlap double")
    part = spans(versions, F.lit(last))
    ends = month_ends(part)
    after = targets(part, months)
    size = ends.groupBy(*KEY).agg(F.sum("rows").alias("train_n")).where(F.col("train_n") >= least_train)
    tested = after.groupBy(*KEY).agg(F.count("*").alias("test_n")).where(F.col("test_n") >= least_test)
    whole = F.date_sub(F.add_months(_first_day(F.col("at")), months), 1) <= F.col("_to")
    usable = size.join(tested, KEY).join(kinds, "kind").where(whole & (F.col("at") >= _month(F.col("_from")) + history)).select(*KEY, "train_n", "test_n")
    usable = cut(usable, "origins")
    seen = windows(part, ends.join(usable.select(*KEY), KEY), months=months)
    after = after.join(F.broadcast(usable.select(*KEY)), KEY)  # an origin and kind each
    # A model is in the snapshot of each origin after its first version; a developer in those of its models' spans.
    known = part.where("_a <= _z").select("kind", "developer", "_a", "_z").distinct().select("kind", "developer", F.explode(F.sequence("_a", "_z")).alias("at")).distinct().withColumn("_d", F.lit(1))
    old = (F.col("model").isNotNull() & (F.col("_since") < F.col("at"))).cast("int")
    each = after.groupBy(*KEY, "developer").agg(F.sum(old).alias("_m"), F.count("*").alias("_c")).join(known, [*KEY, "developer"], "left")
    overlap = each.groupBy(*KEY).agg((F.sum("_m") / F.sum("_c")).alias("model_overlap"), (F.sum(F.coalesce("_d", F.lit(0)) * F.col("_c")) / F.sum("_c")).alias("developer_overlap"))
    actual = part_quantiles(after.select(*KEY, "score", "_part"), KEY, 0.9).select(*KEY, F.col("q").alias("actual"))
    origin = _first_day(F.col("at"))
    anchor = anchors(part, seen, months).withColumn("horizon", F.datediff(F.date_sub(F.add_months(origin, months), 1), F.col("end")) / MONTH_DAYS)
    found = candidates(part, seen).join(anchor, KEY).join(usable, KEY).join(actual, KEY).join(overlap, KEY)
    value = predicted(F.col("score"), F.col("horizon"), F.lit(float(growth)), F.lit(ETA), _retention())
    return cut(found.select(origin.alias("origin"), "kind", "candidate", "train_n", "test_n", "actual", value.alias("predicted"), "horizon", "model_overlap", "developer_overlap"), "backtest")


def compare(tested: DataFrame) -> DataFrame:
    """kind, candidate, origins, rmse, mae, bias, worst, selected: how the candidates of a kind did over their origins; the least rmse (ties: the first name) is selected."""
    e = F.col("predicted") - F.col("actual")
    g = tested.groupBy("kind", "candidate").agg(F.count("*").alias("origins"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("worst"))
    first = F.row_number().over(Window.partitionBy("kind").orderBy(F.round("rmse", 9), "candidate"))
    return g.withColumn("selected", first == 1)


def scenarios(versions: DataFrame, tested: DataFrame, growth: float, horizons: list[float], slowdowns: dict[str, float], etas: list[float], retentions: list[float], multipliers: list[float]) -> DataFrame:
    """kind, horizon, scenario, candidate, point, low, high, union_low, union_high, stress_low, stress_high, selected: forecasts from all data.

    point takes the main assumptions; low and high span all of eta, kept drift and multiplier of growth; the union spans all candidates; stress widens it by the kind's largest error in the
    backtest. Every assumption is a parameter list that a fit's row is exploded by.
    """
    last = versions.agg(F.max("day").alias("d")).first()["d"]
    after = F.add_months(F.trunc(F.lit(last), "month"), 1)
    final = spans(versions, after).where("_next is null").withColumn("_a", F.col("_z"))  # the newest at the start of the month after the last
    seen = windows(final, month_ends(final))
    fits = candidates(final, seen).join(anchors(final, seen), KEY)
    cells = [F.struct(F.lit(float(h)).alias("horizon"), F.lit(k).alias("scenario"), F.lit(float(s)).alias("slow")) for h in horizons for k, s in slowdowns.items()]
    ways = [F.struct(F.lit(float(e)).alias("e"), F.lit(float(r)).alias("r"), F.lit(float(m)).alias("m")) for e in etas for r in retentions for m in multipliers]
    x = fits.select("kind", "candidate", "score", "b_size", "b_t", F.inline(F.array(*cells)))
    at = lambda e, r, m: predicted(F.col("score"), F.col("horizon"), growth * m * F.col("slow"), e, r)
    x = x.withColumn("point", at(F.lit(ETA), _retention(), F.lit(1.0))).withColumn("_v", F.transform(F.array(*ways), lambda w: at(w["e"], w["r"], w["m"])))
    x = x.withColumns({"low": F.least(F.array_min("_v"), "point"), "high": F.greatest(F.array_max("_v"), "point")})
    every = Window.partitionBy("kind", "horizon", "scenario")
    x = x.withColumns({"union_low": F.min("low").over(every), "union_high": F.max("high").over(every)})
    stress = compare(tested)
    worst = stress.groupBy("kind").agg(F.max("worst").alias("_w"))
    x = x.join(worst, "kind", "left").join(stress.select("kind", "candidate", "selected"), ["kind", "candidate"], "left")
    w = F.coalesce("_w", F.lit(0.0))
    return x.select("kind", "horizon", "scenario", "candidate", "point", "low", "high", "union_low", "union_high", F.greatest(F.lit(0.0), F.col("union_low") - w).alias("stress_low"), F.least(F.lit(100.0), F.col("union_high") + w).alias("stress_high"), F.coalesce("selected", F.col("candidate") == "constant").alias("selected"))
