"""What changed a mean between two eras: standardized decompositions over strata and size bins, for many filters, windows, widths and controls from one pass of cell sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAGS = ["filter", "kind", "months", "width", "control"]


def contributions(rows: DataFrame, filters: dict[str, Column], windows: list[float], widths: list[float], minimum: int = 2, least: int = 10) -> DataFrame:
    """A row for each filter, kind, window of months, bin width and control with at least ``least`` rows in both eras.

    rows: kind, t (months), log_n, score, class, developer. The early era is what a filter's kind has up to ``months`` after its first t, the late one what lies within ``months`` of the last t of
    all rows; a row may be in both. Strata are classes, or classes and developers with control. Only cells (stratum, bin) of at least ``minimum`` rows in either era count: a stratum weighs as
    much as its rows in them; within it, the change of the mean is split into that of the bins' shares (scale) and that of the bins' means (temporal), each at the mean of both eras. gap is what
    the change of all rows has besides, shares are given where the change exceeds 0.1, and closure is what the parts leave over: rounding. NULL strata are strata. The status is
    NO_COMMON_CELLS, with the observed change alone, where no cell counts.
    """
    last = rows.agg(F.max("t").alias("_last"))
    gates = F.array(*[F.when(c, F.lit(k)) for k, c in filters.items()])
    kept = rows.select("kind", "t", "log_n", "score", F.col("class").alias("_class"), F.col("developer").alias("_dev"), F.explode(F.filter(gates, lambda x: x.isNotNull())).alias("filter"))
    first = kept.groupBy("filter", "kind").agg(F.min("t").alias("_first")).crossJoin(last)  # one row
    timed = kept.alias("k").join(first.alias("f"), F.col("k.filter").eqNullSafe(F.col("f.filter")) & F.col("k.kind").eqNullSafe(F.col("f.kind"))).select("k.*", "_first", "_last")
    spread = timed.withColumn("months", F.explode(F.array(*[F.lit(float(w)) for w in windows])))
    early, late = (F.col("t") <= F.col("_first") + F.col("months")).cast("int"), (F.col("t") >= F.col("_last") - F.col("months")).cast("int")
    spread = spread.withColumns({"_e": early, "_l": late}).where("_e + _l > 0")
    spread = spread.withColumn("width", F.explode(F.array(*[F.lit(float(w)) for w in widths]))).withColumn("control", F.explode(F.array(F.lit(False), F.lit(True))))
    stratum = F.struct("_class", F.when(F.col("control"), F.col("_dev")).alias("_dev"))
    cells = spread.groupBy(*TAGS, stratum.alias("stratum"), F.floor(F.col("log_n") / F.col("width")).alias("bin")).agg(
        F.sum("_e").alias("n0"), F.sum("_l").alias("n1"), F.sum(F.col("score") * F.col("_e")).alias("s0"), F.sum(F.col("score") * F.col("_l")).alias("s1"), F.sum(F.col("log_n") * F.col("_e")).alias("x0"), F.sum(F.col("log_n") * F.col("_l")).alias("x1"),
    )
    good = (F.col("n0") >= minimum) & (F.col("n1") >= minimum)
    of = lambda c: F.coalesce(F.when(good, F.col(c)), F.lit(0))
    strata = Window.partitionBy(*TAGS, "stratum")
    every = Window.partitionBy(*TAGS)
    x = cells.withColumns({"g0": of("n0"), "g1": of("n1")})
    x = x.withColumns({"t0": F.sum("g0").over(strata), "t1": F.sum("g1").over(strata), "all": F.sum(F.col("g0") + F.col("g1")).over(every)})
    weight = F.try_divide(F.col("t0") + F.col("t1"), F.col("all"))
    w0, w1, m0, m1 = F.try_divide("g0", "t0"), F.try_divide("g1", "t1"), F.try_divide("s0", "n0"), F.try_divide("s1", "n1")
    part = lambda e: F.sum(F.when(good, weight * e))
    shift = F.abs(F.try_divide("x1", "n1") - F.try_divide("x0", "n0"))
    sums = x.groupBy(*TAGS).agg(
        F.sum("n0").alias("n_early"), F.sum("n1").alias("n_late"), F.count_if(good).alias("cells"), F.count_distinct(F.when(good, F.col("stratum"))).alias("strata"), F.sum("g0").alias("kept_early"), F.sum("g1").alias("kept_late"),
        (F.try_divide(F.sum("s1"), F.sum("n1")) - F.try_divide(F.sum("s0"), F.sum("n0"))).alias("observed_change"), part(w0 * m0).alias("standard_start"), part(w1 * m1).alias("standard_end"),
        part((w1 - w0) * (m0 + m1) / 2).alias("scale"), part((w0 + w1) * (m1 - m0) / 2).alias("temporal"), F.max(F.when(good, shift)).alias("shift_in_bins"),
    )
    change = F.col("standard_end") - F.col("standard_start")
    share = lambda c: F.when(F.abs("change") > 0.1, F.col(c) / F.col("change"))
    out = sums.where((F.col("n_early") >= least) & (F.col("n_late") >= least)).withColumn("change", change)
    return out.select(
        *TAGS, F.when(F.col("cells") > 0, "OK").otherwise("NO_COMMON_CELLS").alias("status"), "n_early", "n_late", "cells", "strata", (F.col("kept_early") / F.col("n_early")).alias("coverage_early"),
        (F.col("kept_late") / F.col("n_late")).alias("coverage_late"), "observed_change", "standard_start", "standard_end", "change", "scale", "temporal", (F.col("observed_change") - F.col("change")).alias("gap"),
        share("scale").alias("scale_share"), share("temporal").alias("temporal_share"), (F.col("change") - F.col("scale") - F.col("temporal")).alias("closure"), "shift_in_bins",
    )
