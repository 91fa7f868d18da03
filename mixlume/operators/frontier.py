"""Evaluation frontiers over time: past-only snapshots, calendar windows, running records, decompositions and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlume.functions.expr import hash_uniform, poisson_one
from mixlume.operators import moments, stats
from mixlume.sources.io import cut


def _windows(sub: DataFrame, ends: DataFrame, months: int) -> DataFrame:
    """Rows of each window (month_end - months, month_end]: open at the start, so a filtered join and not an inclusive RANGE frame. ends is a small table of months."""
    return sub.join(F.broadcast(ends), (F.col("day") <= F.col("month_end")) & (F.col("day") > F.add_months("month_end", -months)))


def window_quantiles(sub: DataFrame, ends: DataFrame, by: list[str], months: int, q: float = 0.9) -> DataFrame:
    """month_end, by, q90, top, n of the trailing window at each month end."""
    return stats.summarised(_windows(sub, ends, months), ["month_end", *by], [F.max("score").alias("top"), F.count("*").alias("n")], {"q90": ("score", q)})


def window_anchors(sub: DataFrame, ends: DataFrame, by: list[str], months: int, q: float = 0.9) -> DataFrame:
    """window_quantiles() with the median size of the rows at or above the quantile."""
    w = _windows(sub, ends, months)
    anchors = window_quantiles(sub, ends, by, months, q)
    high = w.join(anchors.select("month_end", *by, "q90"), ["month_end", *by]).where("score >= q90")
    return anchors.join(stats.quantiles(high, ["month_end", *by], {"median_log_n": ("log_n", 0.5)}), ["month_end", *by])


def tail_gaps(sub: DataFrame, ends: DataFrame, lengths: list[int]) -> DataFrame:
    """k, month_end, gap: the maximum less the 90 % quantile for windows of k months."""
    each = [window_quantiles(sub, ends, [], k).select(F.lit(k).alias("k"), "month_end", (F.col("top") - F.col("q90")).alias("gap")) for k in lengths]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def running_record(versions: DataFrame, by: list[str]) -> DataFrame:
    """by, day, record through the day, record before it, over all versions. Days are reduced to their maximum first."""
    days = versions.where("score is not null and not isnan(score) and abs(score) < double('infinity')").groupBy(*by, "day").agg(F.max("score").alias("_s"))
    w = Window.partitionBy(*by).orderBy("day")
    return days.select(*by, "day", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("record"), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))


def record_boundary(q90: Column, record: Column, gap: Column) -> Column:
    """min(100, max(record, q90 + max(0, gap))); missing input is an error, not a number."""
    bad = q90.isNull() | record.isNull() | gap.isNull() | F.isnan(q90) | F.isnan(record) | F.isnan(gap)
    return F.when(bad, F.raise_error(F.lit("a record boundary needs a quantile, a record and a gap")).cast("double")).otherwise(F.least(F.lit(100.0), F.greatest(record, q90 + F.greatest(F.lit(0.0), gap))))


def past_snapshots(versions: DataFrame, origins: DataFrame) -> DataFrame:
    """For each origin the last version of each model before it: deduplicated for each origin, so that later revisions can't leak into the past."""
    past = versions.join(F.broadcast(origins), F.col("day") < F.col("origin"))
    w = Window.partitionBy("origin", "model").orderBy(F.desc("day"), F.desc("row_no"))
    return past.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def rolling_backtest(versions: DataFrame, origins: DataFrame, months: int = 2, least_train: int = 30, least_test: int = 10) -> DataFrame:
    """A trend fitted before each origin and tested on the months after it, with the share of test models seen before."""
    snap = cut(past_snapshots(versions, origins).select("origin", "model", "t", "score"), "snapshots")
    fit = moments.slope(snap, ["origin"], "score", "t").withColumnRenamed("n", "train_n")
    test = versions.join(F.broadcast(origins), (F.col("day") >= F.col("origin")) & (F.col("day") < F.add_months("origin", months)))
    seen = snap.select("origin", "model").withColumn("_seen", F.lit(1))
    e = F.col("intercept") + F.col("slope") * F.col("t") - F.col("score")
    rows = test.join(F.broadcast(fit), "origin").join(seen, ["origin", "model"], "left").where(F.col("train_n") >= least_train)
    out = rows.groupBy("origin", "train_n").agg(F.count("*").alias("test_n"), F.percentile("score", 0.9).alias("actual_q90"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.coalesce("_seen", F.lit(0))).alias("overlap"))
    return out.where(F.col("test_n") >= least_test)


def decompose(rows: DataFrame, widths: list[float], minimum: int = 2) -> DataFrame:
    """width, mix, within_cells, change, cells: the change of the mean from early to late over size bins both eras hold, split in two parts that add up."""
    x = rows.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn("bin", F.floor(F.col("log_n") / F.col("width")))
    era = lambda name, c: F.when(F.col("era") == name, c)
    cells = x.groupBy("width", "bin").agg(F.count(era("early", F.lit(1))).alias("n0"), F.count(era("late", F.lit(1))).alias("n1"), F.avg(era("early", F.col("score"))).alias("m0"), F.avg(era("late", F.col("score"))).alias("m1"))
    w = Window.partitionBy("width")
    shared = cells.where((F.col("n0") >= minimum) & (F.col("n1") >= minimum)).withColumn("s0", F.col("n0") / F.sum("n0").over(w)).withColumn("s1", F.col("n1") / F.sum("n1").over(w))
    s0, s1, m0, m1 = (F.col(c) for c in ("s0", "s1", "m0", "m1"))
    return shared.groupBy("width").agg(F.sum((s1 - s0) * (m0 + m1) / 2).alias("mix"), F.sum((m1 - m0) * (s0 + s1) / 2).alias("within_cells"), (F.sum(s1 * m1) - F.sum(s0 * m0)).alias("change"), F.count("*").alias("cells"))


def decompose_replicates(rows: DataFrame, block: str, width: float, reps: int, seed: str, minimum: int = 2) -> DataFrame:
    """rep, mix, within_cells of the decomposition when whole blocks are drawn: replicates weigh each block's counts and sums, not its rows."""
    era = lambda name, c: F.when(F.col("era") == name, c)
    sums = rows.withColumn("bin", F.floor(F.col("log_n") / width)).groupBy(F.col(block).alias("_block"), "bin").agg(
        *[F.count(era(e, F.lit(1))).alias(f"n{i}") for i, e in enumerate(("early", "late"))], *[F.coalesce(F.sum(era(e, F.col("score"))), F.lit(0.0)).alias(f"t{i}") for i, e in enumerate(("early", "late"))]
    )
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("w", poisson_one(hash_uniform(seed, F.col("rep"), F.col("_block"))))
    cells = drawn.groupBy("rep", "bin").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n0", "n1", "t0", "t1")]).where((F.col("n0") >= minimum) & (F.col("n1") >= minimum))
    each = Window.partitionBy("rep")
    s0, s1 = F.col("n0") / F.sum("n0").over(each), F.col("n1") / F.sum("n1").over(each)
    x = cells.select("rep", s0.alias("s0"), s1.alias("s1"), (F.col("t0") / F.col("n0")).alias("m0"), (F.col("t1") / F.col("n1")).alias("m1"))
    s0, s1, m0, m1 = (F.col(c) for c in ("s0", "s1", "m0", "m1"))
    return x.groupBy("rep").agg(F.sum((s1 - s0) * (m0 + m1) / 2).alias("mix"), F.sum((m1 - m0) * (s0 + s1) / 2).alias("within_cells"))


def shapley(z: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The change of 100 * sigmoid(z) by two shifts of z, split between them by the mean over both orders."""
    s = lambda x: 100 / (1 + F.exp(-x))
    both = s(z + a + b)
    return ((s(z + a) - s(z)) + (both - s(z + b))) / 2, ((s(z + b) - s(z)) + (both - s(z + a))) / 2


def monotone_bridge(points: DataFrame, by: list[str], loss: str, score: str) -> DataFrame:
    """by, slope, intercept, lo, hi: least squares of score on loss; a rising slope becomes the mean."""
    f = points.groupBy(*by).agg(F.regr_slope(score, loss).alias("_b"), F.regr_intercept(score, loss).alias("_a"), F.avg(score).alias("_m"), F.min(loss).alias("lo"), F.max(loss).alias("hi"))
    up = F.col("_b") > 0
    return f.select(*by, F.when(up, 0.0).otherwise(F.col("_b")).alias("slope"), F.when(up, F.col("_m")).otherwise(F.col("_a")).alias("intercept"), "lo", "hi")


def convert(loss: Column) -> tuple[Column, Column]:
    """(status, score) of a loss on a bridge row (slope, intercept, lo, hi); no score outside its support."""
    lo, hi = F.col("lo"), F.col("hi")
    status = F.when(loss.isNull() | F.isnan(loss), "LOSS_MISSING").when(loss < lo, "LOSS_BELOW_SUPPORT").when(loss > hi, "LOSS_ABOVE_SUPPORT").otherwise("SUPPORTED")
    return status, F.when(loss.between(lo, hi), F.col("intercept") + F.col("slope") * loss)


def leave_one_group_out(rows: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """held_out, n, rmse: a line fitted on the other groups, from sums (total less the held group), and tested on the held one."""
    g = moments.gram(rows, [group], [x], [y])
    held = moments.subtract_folds(g.withColumn("one", F.lit(1)), ["one"], group)
    n, sx, sy, sxx, sxy = (F.col("g")[k] for k in (0, 1, 2, 3, 4))
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    fit = held.select(F.col(group).alias("held_out"), slope.alias("_b"), ((sy - slope * sx) / n).alias("_a"))
    e = F.col("_a") + F.col("_b") * F.col(x) - F.col(y)
    return rows.join(F.broadcast(fit), F.col(group) == F.col("held_out")).groupBy("held_out").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


def quantile_fit(rows: DataFrame, y: str, x: str, q: float = 0.9, passes: int = 25) -> DataFrame:
    """slope, intercept, below: check-loss regression by iterated weighted least squares; each pass is one aggregate that gives two numbers."""
    data = cut(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(), "points")
    first = data.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    b, a = first[0] or 0.0, first[1] or 0.0
    for _ in range(passes):
        r = F.col("y") - (a + b * F.col("x"))
        w = F.when(r > 0, q).otherwise(1 - q) / F.greatest(F.abs(r), F.lit(1e-4))
        s = data.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("y")), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x") * F.col("y"))).first()
        det = s[0] * s[3] - s[1] * s[1]
        if not det:
            break
        b, a = (s[0] * s[4] - s[1] * s[2]) / det, (s[3] * s[2] - s[1] * s[4]) / det
    out = data.agg(F.lit(b).alias("slope"), F.lit(a).alias("intercept"), F.avg((F.col("y") <= a + b * F.col("x")).cast("int")).alias("below"))
    return out
