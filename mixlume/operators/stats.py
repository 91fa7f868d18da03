"""Statistics on long frames (group columns, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixlume.sources.io import cut


def unpivot(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """ids, metric, value; missing values stay as rows."""
    return df.unpivot(ids, columns, "metric", "value")


#: Ranges that ranks are counted in (a power of two), and the accuracy of the approximate quantiles that part them (it only evens out the ranges).
RANGES, EVENNESS = 64, 500
#: Share of the rows on either side of a quantile that its exact search keeps: ten times the error 1 / ACCURACY of the approximate ones. Groups of fewer than
#: WHOLE rows, in which that is less than a few rows, are kept whole.
BAND, ACCURACY, WHOLE = 0.005, 2000, 1000


def _keyed(by: list[str]) -> tuple[list[str], str]:
    """(by, or one constant column; its expression)."""
    return by or ["_all"], "_all"


def _null_safe(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with the small table b on the same group columns, NULL groups too; b's group columns go."""
    named = b.withColumnsRenamed({c: f"_j{i}" for i, c in enumerate(by)})
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_j{i}"))
    return a.join(F.broadcast(named), cond, how).drop(*[f"_j{i}" for i in range(len(by))])


def quantiles(df: DataFrame, by: list[str], values: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name: (column, q) of values, the exact q-quantile (between neighbours, linearly) of the column's present values.

    Approximate quantiles around q, from one pass of partial aggregates, leave a narrow band of rows for each group; counts below the band place the exact one
    among the band's distinct values. So no task holds a group's rows, hot or not. Rows of NULL groups are a group. A group without present values has NULL.
    """
    keys, constant = _keyed(by)
    names = list(values)
    entries = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, (c, _) in enumerate(values.values())])
    wide = df if by else df.withColumn(constant, F.lit(0))
    long_form = wide.select(*keys, F.inline(entries))
    rows = long_form.where("_v is not null")
    q = F.element_at(F.array(*[F.lit(float(x)) for _, x in values.values()]), F.col("_i") + 1)
    low = [F.expr(f"percentile_approx(case when _i = {i} then _v end, {max(0.0, x - BAND)}D, {ACCURACY})") for i, (_, x) in enumerate(values.values())]
    high = [F.expr(f"percentile_approx(case when _i = {i} then _v end, {min(1.0, x + BAND)}D, {ACCURACY})") for i, (_, x) in enumerate(values.values())]
    size = [F.count_if(F.col("_i") == i) for i in range(len(values))]
    bounds = rows.groupBy(*keys).agg(F.array(*low).alias("_lo"), F.array(*high).alias("_hi"), F.array(*size).alias("_size"))
    near = _null_safe(rows, bounds, keys)
    few = F.element_at("_size", F.col("_i") + 1) < WHOLE
    lo = F.when(few, F.lit(float("-inf"))).otherwise(F.element_at("_lo", F.col("_i") + 1))
    hi = F.when(few, F.lit(float("inf"))).otherwise(F.element_at("_hi", F.col("_i") + 1))
    counted = near.select(*keys, "_i", F.when(F.col("_v") < lo, F.lit(None)).when(F.col("_v") <= hi, F.col("_v")).alias("_x"), (F.col("_v") < lo).alias("_below"))
    # One row for all below the band, one for all above, one for each distinct value inside.
    cells = counted.groupBy(*keys, "_i", "_x", "_below").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys, "_i")
    place = F.when(F.col("_below"), 0).when(F.col("_x").isNotNull(), 1).otherwise(2)
    up = group.orderBy("_p", "_x").rowsBetween(Window.unboundedPreceding, 0)
    inside = cells.withColumn("_p", place).withColumn("_last", F.sum("_c").over(up) - 1).withColumn("_n", F.sum("_c").over(group)).where("_p = 1")
    inside = inside.withColumn("_first", F.col("_last") - F.col("_c") + 1).withColumn("_at", q * (F.col("_n") - 1))
    at = lambda k: F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_x")))
    found = inside.groupBy(*keys, "_i").agg(at(F.floor("_at")).alias("_a"), at(F.ceil("_at")).alias("_b"), F.first("_at").alias("_at"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value)).alias(n) for i, n in enumerate(names)])
    every = long_form.select(*keys).distinct() if by else None
    if every is not None:  # groups of missing values only
        out = _null_safe(every, out, keys, "left")
    return out.select(*by, *names) if by else df.sparkSession.range(1).join(out, how="left").select(*names)


def summarised(df: DataFrame, by: list[str], aggs: list[Column], values: dict[str, tuple[str, float]]) -> DataFrame:
    """by, aggs and the exact quantiles of quantiles(): a row for each group, NULL groups too, or one row without by."""
    found = quantiles(df, by, values)
    return _null_safe(df.groupBy(*by).agg(*aggs), found, by, "left") if by else df.agg(*aggs).crossJoin(F.broadcast(found))  # one row each


def robust_params(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Center (median) and scale of each metric: 1.4826 times the median absolute deviation; if that is 0, the population standard deviation; if that is 0, 1."""
    by = by or ["metric"]
    rows = long.where("value is not null")
    first = cut(rows.groupBy(*by).agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).join(quantiles(rows, by, {"center": ("value", 0.5)}), by), "centers")
    off = _null_safe(rows, first, by).withColumn("off", F.abs(F.col("value") - F.col("center")))
    scale = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return first.join(quantiles(off, by, {"mad": ("off", 0.5)}), by).select(*by, "center", scale.alias("scale"), "n")


def _ranged(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with _range: how many of its group's RANGES - 1 approximate quantiles of value lie below the row's, by halving (a comparison with each quantile costs ten times that)."""
    return dealt(rows, keys, value).drop("_cuts")


def dealt(rows: DataFrame, keys: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """rows with _range as _ranged() says, of ``ranges`` (a power of two), and _cuts, those quantiles."""
    cuts = ", ".join(f"{k / ranges}D" for k in range(1, ranges))
    bounds = rows.groupBy(*keys).agg(F.expr(f"percentile_approx(`{value}`, array({cuts}), {max(EVENNESS, 8 * ranges)})").alias("_cuts"))
    out = _null_safe(rows, bounds, keys).withColumn("_range", F.lit(0))
    for k in range(1, ranges.bit_length()):  # a column each: as one expression over an array of steps it would be interpreted for each row
        step = ranges >> k
        out = out.withColumn("_range", F.col("_range") + F.when(F.get("_cuts", F.col("_range") + (step - 1)) < F.col(value), step).otherwise(0))
    return out


def running(counts: DataFrame, by: list[str], value: str, weight: str | list[str], out: str | list[str]) -> DataFrame:
    """counts (a row for each distinct by, value) with the running sum (out) of each weight up to and with the row, in the order of value within by.

    Values are dealt to RANGES ranges of about equal weight in each group, so a hot group's order is spread over tasks: sums of ranges are the bases of the
    sums within ranges. counts are read three times, so they should be cut.
    """
    weights, outs = ([weight], [out]) if isinstance(weight, str) else (weight, out)
    keys, constant = _keyed(by)
    dealt = _ranged(counts if by else counts.withColumn(constant, F.lit(0)), keys, value)
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(w).alias(f"_s{i}") for i, w in enumerate(weights)])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(weights))])
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = _null_safe(dealt.select("*", *[F.sum(w).over(inside).alias(f"_in{i}") for i, w in enumerate(weights)]), bases, [*keys, "_range"])
    return summed.select(*counts.columns, *[(F.col(f"_in{i}") + F.col(f"_base{i}")).alias(o) for i, o in enumerate(outs)])


def with_neighbour(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """rows with <value>_before of the row before in the order within by (NULL for the first); order is unique within by and present.

    Each group is parted into ranges as in running(); a range's first row gets the last row of the range before, so that no task sorts a whole hot group.
    """
    keys, constant = _keyed(by)
    named = rows if by else rows.withColumn(constant, F.lit(0))
    dealt = _ranged(named, keys, order)
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by(F.struct(*[F.col(v) for v in values]), order).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_range")
    borders = ends.select(*keys, F.col("_range").alias("_at"), F.lag("_end").over(before).alias("_border"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    out = _null_safe(dealt.withColumn("_place", F.row_number().over(inside)).withColumns({f"{v}_before": F.lag(v).over(inside) for v in values}), borders, keys).where("_at = _range")
    out = out.withColumns({f"{v}_before": F.when(F.col("_place") == 1, F.col(f"_border.{v}")).otherwise(F.col(f"{v}_before")) for v in values})
    return out.drop("_range", "_at", "_border", "_place", *([] if by else [constant]))


def ranks_of_values(df: DataFrame, by: list[str], value: str, rank: str) -> DataFrame:
    """by, value, rank of each distinct present value: from 1, ties averaged. A hot value is one row, and a hot group is parted by ranges."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return running(counts, by, value, "_c", rank).withColumn(rank, F.col(rank) - (F.col("_c") - 1) / 2).drop("_c")


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str = "rank") -> DataFrame:
    """df with ranks of value within by, NULL for NULL."""
    return df.join(ranks_of_values(df, by, value, rank), [*by, value], "left")


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation; NULL for a constant side (the built-in one fails there under ANSI rules)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, rho over rows where both are present; NULL for fewer than 2 distinct values on a side."""
    return spearmans(df, by, a, b, F.array(F.lit(1)), 1).drop("k")


def spearmans(df: DataFrame, by: list[str], a: str, b: str, weights: Column, size: int) -> DataFrame:
    """by, k, n, rho for each weighting k (from 0; n > 0): the Spearman correlation over rows where both are present, each as often as the k-th of its ``size`` whole, present weights says.

    A row isn't made several: all weightings share the order of the values, so their ranks are running sums side by side, and a row's ranks meet its weights in one aggregate. Ranks are counted from
    the group's middle, where their mean is 0.
    """
    names = [f"_w{i}" for i in range(size)]
    group = [f"_g{i}" for i in range(len(by))]
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, group)], F.col(a).alias("_a"), F.col(b).alias("_b"), weights.alias("_w"))
    pairs = pairs.select(*group, "_a", "_b", *[F.col("_w")[i].cast("long").alias(n) for i, n in enumerate(names)])
    ranked = pairs
    for side in ("_a", "_b"):
        counts = cut(pairs.groupBy(*group, side).agg(*[F.sum(n).alias(n) for n in names]), "values")
        sizes = counts.groupBy(*group).agg(*[F.sum(n).alias(f"_of{i}") for i, n in enumerate(names)])
        placed = running(counts, group, side, names, [f"_k{i}" for i in range(len(names))])
        placed = _null_safe(placed, sizes, group) if by else placed.crossJoin(F.broadcast(sizes))  # one row
        middle = [(F.col(f"_k{i}") - F.col(n) / 2 - F.col(f"_of{i}") / 2).alias(f"_r{side}{i}") for i, n in enumerate(names)]
        ranked = ranked.join(placed.select(*group, side, *middle), [*group, side])
    x = lambda i: [F.col(f"_w{i}"), F.col(f"_r_a{i}"), F.col(f"_r_b{i}")]
    sums = [F.struct(F.lit(i).alias("k"), F.sum(w).alias("n"), F.sum(w * p * q).alias("_pq"), F.sum(w * p * p).alias("_pp"), F.sum(w * q * q).alias("_qq")) for i, (w, p, q) in enumerate(map(x, range(len(names))))]
    each = ranked.groupBy(*group).agg(F.array(*sums).alias("_s")).select(*[F.col(g).alias(c) for c, g in zip(by, group)], F.inline("_s"))
    rho = F.col("_pq") / F.nullif(F.sqrt("_pp") * F.sqrt("_qq"), F.lit(0.0))
    out = each.select(*by, "k", F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))
    return out.where("n > 0") if by else out


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, out: str = "q") -> DataFrame:
    """df with adjusted p values; NULL stays NULL and isn't counted. Equal p values share the last one's place, as the step-up rule gives them one q anyway.

    Rows are dealt to ranges of p once and stepped down within them, highest first, from the places that counts of ranges give; later ranges then lower the written steps. A value that is a
    range's border is a range of its own, whose rows all have one place: they are spread over tasks and not ordered, so that a hot value isn't one task's.
    """
    keys, constant = _keyed(by or [])
    rows = dealt(df if by else df.withColumn(constant, F.lit(0)), keys, p)
    border = F.coalesce(F.get("_cuts", F.col("_range")) == F.col(p), F.lit(False)) | F.col(p).isNull()
    rows = rows.withColumn("_border", border).withColumn("_range", F.when(F.col(p).isNotNull(), 2 * F.col("_range") + F.col("_border").cast("int")).otherwise(-1)).drop("_cuts")
    counts = rows.where(F.col(p).isNotNull()).groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    ends = counts.select(*keys, "_range", "_n", F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)).alias("_end"), F.sum("_n").over(group).alias("_m"))
    placed = _null_safe(rows.withColumn("_task", F.when(F.col("_border"), F.spark_partition_id()).otherwise(-1)), ends, [*keys, "_range"], "left")
    down = Window.partitionBy(*keys, "_range", "_task").orderBy(F.desc(p))  # never up to the following rows' end: Spark reads those anew for each row
    k = F.when(F.col("_border"), F.col("_end")).otherwise(F.col("_end") + 1 - F.row_number().over(down))
    steps = placed.withColumn("_raw", F.col(p) * F.col("_m") / k).withColumn("_low", F.min("_raw").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    steps = cut(steps.select(*dict.fromkeys([*df.columns, *keys]), "_range", "_low"), "steps")
    lows = steps.groupBy(*keys, "_range").agg(F.min("_low").alias("_l"))
    bases = lows.select(*keys, "_range", F.min("_l").over(group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_base"))
    q = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "_low", "_base"))
    return _null_safe(steps, bases, [*keys, "_range"]).select(*df.columns, q.alias(out))


def trimmed_mean(df: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """by, trimmed_mean: floor(share * n) values dropped at each end. Each distinct value enters as often as its places lie inside."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    placed = _null_safe(running(counts, by, value, "_c", "_k"), counts.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    cut = F.floor(F.col("_n") * share)
    kept = F.greatest(F.lit(0), F.least("_k", F.col("_n") - cut) - F.greatest(F.col("_k") - F.col("_c"), cut))
    return placed.groupBy(*by).agg((F.sum(kept * F.col(value)) / F.nullif(F.sum(kept), F.lit(0))).alias("trimmed_mean"))


def error_metrics(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates rmse, log_rmse (positive pairs), mae, bias, mape, r2, pearson and n over rows where both are present."""
    ok = actual.isNotNull() & predicted.isNotNull()
    y, p = F.when(ok, actual), F.when(ok, predicted)
    e = p - y
    return [
        F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(F.when((y > 0) & (p > 0), F.pow(F.ln(p) - F.ln(y), 2)))).alias("log_rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.avg(F.when(y != 0, F.abs(e / y))).alias("mape"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"), correlation(y, p).alias("pearson"),
    ]


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, missing, min, max, distinct values (numbers as double)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    v = F.col("value")
    return long.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_distinct(v).alias("distinct_values"))


def missingness(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(by, columns, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"))


def id_integrity(df: DataFrame, by: str, key: str) -> DataFrame:
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(blank).alias("blank_ids"), F.count_distinct(key).alias("unique_ids"), (F.count(key) - F.count_distinct(key)).alias("repeated_ids"))
