"""Queries on evaluation frontiers over time: snapshots, windows, records, decompositions and bridges, over orders as submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.operators import bridges, contributions, frontier, moments, pairs, stats
from mixlume.operators import origins as origins_panel
from mixlume.plans.entities import RUNS_SQL, SUBMISSIONS_SQL, keep, latest, runs, submissions, table
from mixlume.plans.registry import query

SUB = "WITH " + SUBMISSIONS_SQL
LATEST = SUB + ", late AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day DESC, row_no DESC) AS r FROM sub) WHERE r = 1)"
_ENDS = "ends AS (SELECT CAST(e AS DATE) AS month_end FROM (SELECT last_day(CAST(m AS DATE)) AS e FROM generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH) s(m)))"


@query("w1_latest_version", LATEST + " SELECT model, row_no, day, score FROM late", "score", "day")
def _(spark, d):
    return latest(submissions(spark, d)).select("model", "row_no", "day", "score")


def month_ends(spark: SparkSession) -> DataFrame:
    return spark.sql("select last_day(m) as month_end from (select explode(sequence(date'1996-01-01', date'2001-06-01', interval 1 month)) as m)")


_W7 = SUB + ", " + _ENDS + ", w AS (SELECT month_end, kind, score, log_n FROM ends JOIN sub ON day <= month_end AND day > month_end - INTERVAL 2 MONTH), q AS (SELECT month_end, kind, quantile_cont(score, 0.9) AS q90, max(score) AS top, count(*) AS n FROM w GROUP BY 1, 2)"


@query("w6_w7_window_anchor", _W7 + " SELECT month_end, kind, any_value(q90) AS q90, median(log_n) AS median_log_n, any_value(n) AS n FROM q JOIN w USING (month_end, kind) WHERE score >= q90 GROUP BY 1, 2", "q90 median_log_n", "month_end")
def _(spark, d):
    return frontier.window_anchors(submissions(spark, d), month_ends(spark), ["kind"], 2).select("month_end", "kind", "q90", "median_log_n", "n")


@query("w16_tail_gap", SUB + ", " + _ENDS + ", w AS (SELECT k, month_end, score FROM ends JOIN (SELECT unnest([1, 2, 3]) AS k) ON true JOIN sub ON day <= month_end AND day > month_end - to_months(k)) SELECT k, month_end, max(score) - quantile_cont(score, 0.9) AS gap FROM w GROUP BY 1, 2", "gap", "month_end")
def _(spark, d):
    return frontier.tail_gaps(submissions(spark, d), month_ends(spark), [1, 2, 3])


@query("w8_running_record", SUB + ", m AS (SELECT kind, day, max(score) AS s FROM sub GROUP BY 1, 2) SELECT kind, day, max(s) OVER (PARTITION BY kind ORDER BY day) AS record, max(s) OVER (PARTITION BY kind ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m", "record before", "day")
def _(spark, d):
    return frontier.running_record(submissions(spark, d), ["kind"])


@query("p31_g22_record_boundary", _W7 + """, m AS (SELECT kind, day, max(score) AS s FROM sub GROUP BY 1, 2), rec AS (SELECT kind, day, max(s) OVER (PARTITION BY kind ORDER BY day) AS record FROM m),
 r AS (SELECT month_end, kind, arg_max(record, day) AS record FROM ends JOIN rec ON day <= month_end GROUP BY 1, 2), g AS (SELECT month_end, kind, max(score) - quantile_cont(score, 0.9) AS gap FROM ends JOIN sub ON day <= month_end AND day > month_end - INTERVAL 6 MONTH GROUP BY 1, 2),
 b AS (SELECT month_end, kind, record, least(100.0, greatest(record, q90 + greatest(0.0, gap))) AS boundary FROM q JOIN r USING (month_end, kind) JOIN g USING (month_end, kind)), n AS (SELECT month_end, kind, max(score) AS next_top FROM ends JOIN sub ON day > month_end AND day <= last_day(month_end + INTERVAL 1 MONTH) GROUP BY 1, 2)
 SELECT month_end, kind, boundary, boundary > record AS above_record, next_top, next_top <= boundary AS held FROM b LEFT JOIN n USING (month_end, kind)""", "boundary next_top", "month_end")
def _(spark, d):
    """The boundary of each month from the two-month quantile, the record and the six-month gap, tested on the next month's top."""
    sub, ends = submissions(spark, d), month_ends(spark)
    q = frontier.window_quantiles(sub, ends, ["kind"], 2).select("month_end", "kind", "q90")
    g = frontier.window_quantiles(sub, ends, ["kind"], 6).select("month_end", "kind", (F.col("top") - F.col("q90")).alias("gap"))
    r = frontier.running_record(sub, ["kind"]).join(F.broadcast(ends), F.col("day") <= F.col("month_end")).groupBy("month_end", "kind").agg(F.max_by("record", "day").alias("record"))
    n = sub.join(F.broadcast(ends), (F.col("day") > F.col("month_end")) & (F.col("day") <= F.last_day(F.add_months("month_end", 1)))).groupBy("month_end", "kind").agg(F.max("score").alias("next_top"))
    b = q.join(r, ["month_end", "kind"]).join(g, ["month_end", "kind"]).withColumn("boundary", frontier.record_boundary(F.col("q90"), F.col("record"), F.col("gap")))
    return b.join(n, ["month_end", "kind"], "left").select("month_end", "kind", "boundary", (F.col("boundary") > F.col("record")).alias("above_record"), "next_top", (F.col("next_top") <= F.col("boundary")).alias("held"))


_ORIGINS = "o AS (SELECT CAST(x AS DATE) AS origin FROM (SELECT unnest([DATE '1997-01-01', DATE '1998-01-01', DATE '1999-01-01', DATE '2000-01-01']) AS x))"


def origins(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(array(date'1997-01-01', date'1998-01-01', date'1999-01-01', date'2000-01-01')) as origin")


_SNAP = SUB + ", " + _ORIGINS + ", snap AS (SELECT * EXCLUDE (r) FROM (SELECT origin, sub.*, row_number() OVER (PARTITION BY origin, model ORDER BY day DESC, row_no DESC) AS r FROM o JOIN sub ON day < origin) WHERE r = 1)"


@query("j14_past_snapshots", _SNAP + " SELECT origin, count(*) AS models, avg(score) AS mean, max(score) AS top FROM snap GROUP BY origin", "mean top", "origin")
def _(spark, d):
    s = frontier.past_snapshots(submissions(spark, d), origins(spark))
    return s.groupBy("origin").agg(F.count("*").alias("models"), F.avg("score").alias("mean"), F.max("score").alias("top"))


@query("r14_rolling_backtest", _SNAP + """, f AS (SELECT origin, regr_slope(score, t) AS b, regr_intercept(score, t) AS a, count(*) AS train_n FROM snap GROUP BY origin),
 te AS (SELECT origin, model, t, score FROM o JOIN sub ON day >= origin AND day < origin + INTERVAL 2 MONTH), seen AS (SELECT DISTINCT origin, model FROM snap)
 SELECT origin, train_n, count(*) AS test_n, quantile_cont(score, 0.9) AS actual_q90, sqrt(avg(power(a + b * t - score, 2))) AS rmse, avg(CAST(seen.model IS NOT NULL AS INT)) AS overlap
 FROM te JOIN f USING (origin) LEFT JOIN seen USING (origin, model) WHERE train_n >= 30 GROUP BY origin, train_n HAVING count(*) >= 10""", "actual_q90 rmse overlap", "origin")
def _(spark, d):
    return frontier.rolling_backtest(submissions(spark, d), origins(spark))


#: Yearly growth of resources, in powers of ten, and the scenarios that a forecast spans.
_GROWTH = 0.4
_SPAN = ([12.0, 24.0], {"historical": 1.0, "half": 0.5, "quarter": 0.25, "stopped": 0.0}, [0.25, 0.5, 0.75], [0.0, 0.5, 1.0], [0.5, 1.0, 1.5])


def _tested(spark: SparkSession, d: str) -> DataFrame:
    return keep(spark, d, "origins", lambda: origins_panel.backtest(submissions(spark, d), _GROWTH))


@query("m18_r14_origin_backtest", None, "actual predicted horizon model_overlap developer_overlap", "origin")
def _(spark, d):
    """Four frontier candidates (constant, monthly trend, quantile and mean planes in size and time) at each origin against the two months after it."""
    return _tested(spark, d)


@query("m18_candidate_comparison", None, "rmse mae bias worst")
def _(spark, d):
    """How each candidate did over all origins of a kind, and which one is selected."""
    return origins_panel.compare(_tested(spark, d))


@query("g21_scenario_union", None, "horizon point low high union_low union_high stress_low stress_high")
def _(spark, d):
    """Forecasts of all candidates under slowdowns, with the span over size shares, kept drifts and growth multipliers, their union, and the backtest's largest error as stress."""
    return origins_panel.scenarios(submissions(spark, d), _tested(spark, d), _GROWTH, *_SPAN)


@query("m1_ols", SUB + " SELECT kind, count(*) AS n, regr_slope(score, t) AS slope, regr_intercept(score, t) AS intercept FROM sub GROUP BY kind", "slope intercept")
def _(spark, d):
    return moments.slope(submissions(spark, d), ["kind"], "score", "t")


@query("ag26_resource_frontier", "WITH y AS (SELECT year(o_orderdate) AS y, quantile_cont(log10(o_totalprice), 0.9) AS q90, count(*) AS n FROM orders GROUP BY 1) SELECT regr_slope(q90, y) AS slope, regr_intercept(q90, y) AS intercept, CAST(sum(n) AS BIGINT) AS n FROM y WHERE y < 2001", "slope intercept")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").cast("double").alias("y"), F.log10("o_totalprice").alias("v"))
    y = stats.summarised(rows, ["y"], [F.count("*").alias("n")], {"q90": ("v", 0.9)})
    return y.where("y < 2001").agg(F.regr_slope("q90", "y").alias("slope"), F.regr_intercept("q90", "y").alias("intercept"), F.sum("n").alias("n"))


@query("ag27_annual_tops", SUB + " SELECT year(day) AS y, quantile_cont(score, 0.95) AS p95, max(score) AS top FROM sub GROUP BY 1", "p95 top")
def _(spark, d):
    return stats.summarised(submissions(spark, d).select(F.year("day").cast("long").alias("y"), "score"), ["y"], [F.max("score").alias("top")], {"p95": ("score", 0.95)})


@query("ag45_recent_tops", SUB + " SELECT kind, max(score) AS top, max(score) FILTER (day >= DATE '2001-01-01') AS recent, quantile_cont(score, 0.9) AS q90, count(*) FILTER (score > 80) AS over_80 FROM sub GROUP BY kind", "top recent q90")
def _(spark, d):
    s = F.col("score")
    aggs = [F.max(s).alias("top"), F.max(F.when(F.col("day") >= "2001-01-01", s)).alias("recent"), F.count_if(s > 80).alias("over_80")]
    return stats.summarised(submissions(spark, d), ["kind"], aggs, {"q90": ("score", 0.9)})


_CELLS = LATEST + """, e AS (SELECT CASE WHEN day < DATE '2001-01-01' THEN 'early' ELSE 'late' END AS era, floor(log_n / {w}) AS bin, score FROM late),
c AS (SELECT bin, count(*) FILTER (era = 'early') AS n0, count(*) FILTER (era = 'late') AS n1, avg(score) FILTER (era = 'early') AS m0, avg(score) FILTER (era = 'late') AS m1 FROM e GROUP BY bin),
s AS (SELECT * FROM c WHERE n0 >= 2 AND n1 >= 2), x AS (SELECT *, n0 / sum(n0) OVER () AS s0, n1 / sum(n1) OVER () AS s1 FROM s)
SELECT {w} AS width, sum((s1 - s0) * (m0 + m1) / 2) AS mix, sum((m1 - m0) * (s0 + s1) / 2) AS within_cells, sum(s1 * m1) - sum(s0 * m0) AS change, count(*) AS cells FROM x"""


@query("ag32_ag33_decomposition", " UNION ALL ".join(f"SELECT * FROM ({_CELLS.format(w=w)})" for w in (0.25, 0.5, 1.0)), "width mix within_cells change")
def _(spark, d):
    sub = latest(submissions(spark, d)).withColumn("era", F.when(F.col("day") < "2001-01-01", "early").otherwise("late"))
    return frontier.decompose(sub, [0.25, 0.5, 1.0])


_KINDS = SUB + ", r AS (SELECT kind, t, log_n, score, substr(licence, 1, 1) AS class, developer FROM sub), f AS (SELECT 'primary' AS filter, * FROM r UNION ALL SELECT 'strict', * FROM r WHERE class <> '5' UNION ALL SELECT 'permissive', * FROM r WHERE class IN ('1', '2')), b AS (SELECT filter, kind, min(t) AS t0 FROM f GROUP BY ALL)"
_KINDS += """, v AS (SELECT f.*, months, width, control, CAST(t <= t0 + months AS INT) AS e, CAST(t >= (SELECT max(t) FROM r) - months AS INT) AS l FROM f JOIN b USING (filter, kind), (SELECT unnest([3.0, 6.0, 12.0]) AS months), (SELECT unnest([0.25, 0.5, 0.75]) AS width), (SELECT unnest([false, true]) AS control)),
 c AS (SELECT filter, kind, months, width, control, class, CASE WHEN control THEN developer END AS dev, floor(log_n / width) AS bin, sum(e) AS n0, sum(l) AS n1, sum(score * e) AS s0, sum(score * l) AS s1, sum(log_n * e) AS x0, sum(log_n * l) AS x1 FROM v WHERE e + l > 0 GROUP BY ALL),
 g AS (SELECT *, s0 / n0 AS m0, s1 / n1 AS m1, abs(x1 / n1 - x0 / n0) AS sh FROM c WHERE n0 >= 2 AND n1 >= 2),
 k AS (SELECT filter, kind, months, width, control, class, dev, sum(n0) AS t0, sum(n1) AS t1 FROM g GROUP BY ALL), q AS (SELECT filter, kind, months, width, control, sum(t0 + t1) AS tt, count(*) AS strata FROM k GROUP BY ALL),
 h AS (SELECT g.*, (k.t0 + k.t1) / tt AS pi, g.n0 / k.t0 AS w0, g.n1 / k.t1 AS w1 FROM g JOIN k ON g.filter = k.filter AND g.kind = k.kind AND g.months = k.months AND g.width = k.width AND g.control = k.control AND g.class = k.class AND g.dev IS NOT DISTINCT FROM k.dev JOIN q ON g.filter = q.filter AND g.kind = q.kind AND g.months = q.months AND g.width = q.width AND g.control = q.control),
 p AS (SELECT filter, kind, months, width, control, count(*) AS cells, sum(n0) AS g0, sum(n1) AS g1, sum(pi * w0 * m0) AS a, sum(pi * w1 * m1) AS z, sum(pi * (w1 - w0) * (m1 + m0) / 2) AS scale, sum(pi * (w1 + w0) * (m1 - m0) / 2) AS temporal, max(sh) AS shift_in_bins FROM h GROUP BY ALL),
 o AS (SELECT filter, kind, months, width, control, sum(n0) AS n_early, sum(n1) AS n_late, sum(s1) / nullif(sum(n1), 0) - sum(s0) / nullif(sum(n0), 0) AS observed_change FROM c GROUP BY ALL HAVING sum(n0) >= 10 AND sum(n1) >= 10)
 SELECT o.filter, o.kind, o.months, o.width, o.control, CASE WHEN cells > 0 THEN 'OK' ELSE 'NO_COMMON_CELLS' END AS status, CAST(n_early AS BIGINT) AS n_early, CAST(n_late AS BIGINT) AS n_late, coalesce(cells, 0) AS cells, coalesce(strata, 0) AS strata,
  coalesce(g0, 0) / n_early AS coverage_early, coalesce(g1, 0) / n_late AS coverage_late, observed_change, a AS standard_start, z AS standard_end, z - a AS change, scale, temporal, observed_change - (z - a) AS gap,
  CASE WHEN abs(z - a) > 0.1 THEN scale / (z - a) END AS scale_share, CASE WHEN abs(z - a) > 0.1 THEN temporal / (z - a) END AS temporal_share, z - a - scale - temporal AS closure, shift_in_bins
 FROM o LEFT JOIN p USING (filter, kind, months, width, control) LEFT JOIN q USING (filter, kind, months, width, control)"""


@query("ag32_ag33_contributions", _KINDS, "months width coverage_early coverage_late observed_change standard_start standard_end change scale temporal gap scale_share temporal_share closure shift_in_bins")
def _(spark, d):
    """The decomposition for each licence filter, kind, window, bin width and developer control, within classes."""
    rows = submissions(spark, d).withColumn("class", F.substring("licence", 1, 1))
    c = F.col("class")
    return contributions.contributions(rows, {"primary": F.lit(True), "strict": c != "5", "permissive": c.isin("1", "2")}, [3, 6, 12], [0.25, 0.5, 0.75])


@query("m19_shapley", SUB + " SELECT row_no, 50 * ((1 / (1 + exp(-(z + a))) - 1 / (1 + exp(-z))) + (1 / (1 + exp(-(z + a + b))) - 1 / (1 + exp(-(z + b))))) AS size_part, 50 * ((1 / (1 + exp(-(z + b))) - 1 / (1 + exp(-z))) + (1 / (1 + exp(-(z + a + b))) - 1 / (1 + exp(-(z + a))))) AS time_part FROM (SELECT row_no, (score - 50) / 20 AS z, log_n / 4 AS a, t / 80 AS b FROM sub)", "size_part time_part")
def _(spark, d):
    x = submissions(spark, d).select("row_no", ((F.col("score") - 50) / 20).alias("z"), (F.col("log_n") / 4).alias("a"), (F.col("t") / 80).alias("b"))
    size, time = frontier.shapley(F.col("z"), F.col("a"), F.col("b"))
    return x.select("row_no", size.alias("size_part"), time.alias("time_part"))


_BRIDGE = "x AS (SELECT l_returnflag AS g, l_quantity / 10 AS loss, l_tax * 100 - l_quantity / 20 AS s FROM lineitem), f AS (SELECT g, regr_slope(s, loss) AS b, regr_intercept(s, loss) AS a, avg(s) AS m, min(loss) AS lo, max(loss) AS hi FROM x GROUP BY g), k AS (SELECT g, CASE WHEN b > 0 THEN 0 ELSE b END AS slope, CASE WHEN b > 0 THEN m ELSE a END AS intercept, lo, hi FROM f)"


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 10).alias("loss"), (F.col("l_tax") * 100 - F.col("l_quantity") / 20).alias("s"))
    return frontier.monotone_bridge(x, ["g"], "loss", "s")


@query("m15_monotone_bridge", f"WITH {_BRIDGE} SELECT g, slope, intercept FROM k", "slope intercept")
def _(spark, d):
    return _bridge(spark, d).select("g", "slope", "intercept")


_STRESS = f"WITH {_BRIDGE}, p AS (SELECT unnest([0.05, 1.0, 2.5, 4.0, 9.0]) AS loss), c AS (SELECT unnest([0.9, 1.0, 1.1]) AS scale), q AS (SELECT g, loss, scale, loss * scale AS x, slope, intercept, lo, hi FROM k, p, c), r AS (SELECT g, loss, scale, CASE WHEN x < lo THEN 'LOSS_BELOW_SUPPORT' WHEN x > hi THEN 'LOSS_ABOVE_SUPPORT' ELSE 'SUPPORTED' END AS status, CASE WHEN x BETWEEN lo AND hi THEN intercept + slope * x END AS score FROM q)"


def _stress(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.sql("select loss, scale from (select explode(array(0.05D, 1.0D, 2.5D, 4.0D, 9.0D)) as loss) cross join (select explode(array(0.9D, 1.0D, 1.1D)) as scale)")
    q = _bridge(spark, d).crossJoin(F.broadcast(grid)).withColumn("x", F.col("loss") * F.col("scale"))
    status, score = frontier.convert(F.col("x"))
    return q.select("g", "loss", "scale", status.alias("status"), score.alias("score"))


@query("p30_g23_coordinate_stress", _STRESS + " SELECT * FROM r", "loss scale score")
def _(spark, d):
    return _stress(spark, d)


@query("ag40_stress_summary", _STRESS + " SELECT g, count(*) FILTER (status = 'SUPPORTED') AS supported, min(score) AS low, max(score) AS high, bool_and(score > 0) AS all_positive FROM r GROUP BY g", "low high")
def _(spark, d):
    r = _stress(spark, d)
    return r.groupBy("g").agg(F.count_if(F.col("status") == "SUPPORTED").alias("supported"), F.min("score").alias("low"), F.max("score").alias("high"), F.bool_and(F.col("score") > 0).alias("all_positive"))


@query("ag41_policy_ranking", _STRESS + ", t AS (SELECT loss, scale, count(score) = count(*) AS complete, max(round(score, 6)) AS best FROM r GROUP BY 1, 2) SELECT loss, scale, string_agg(g, ';' ORDER BY g) AS winners FROM r JOIN t USING (loss, scale) WHERE complete AND round(score, 6) = best GROUP BY 1, 2", "loss scale")
def _(spark, d):
    r = _stress(spark, d).withColumn("s", F.round("score", 6))
    w = Window.partitionBy("loss", "scale")
    kept = r.withColumn("best", F.max("s").over(w)).withColumn("complete", F.count("s").over(w) == F.count("*").over(w)).where("complete and s = best")
    return kept.groupBy("loss", "scale").agg(F.array_join(F.array_sort(F.collect_list("g")), ";").alias("winners"))


@query("m20_m21_fit_sensitivity", SUB + ", v AS (SELECT 'all' AS variant, * FROM sub UNION ALL SELECT 'finished', * FROM sub WHERE kind = 'F' UNION ALL SELECT 'recent', * FROM sub WHERE day >= DATE '1999-01-01') SELECT variant, count(*) AS n, regr_slope(score, log_n) AS slope, regr_r2(score, log_n) AS r2, regr_slope(score, log_n) * (max(log_n) - min(log_n)) AS contribution FROM v GROUP BY variant", "slope r2 contribution")
def _(spark, d):
    v = submissions(spark, d).withColumn("variant", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("kind") == "F", "finished"), F.when(F.col("day") >= "1999-01-01", "recent")))))
    b = F.regr_slope("score", "log_n")
    return v.groupBy("variant").agg(F.count("*").alias("n"), b.alias("slope"), F.regr_r2("score", "log_n").alias("r2"), (b * (F.max("log_n") - F.min("log_n"))).alias("contribution"))


@query("r15_time_holdout", SUB + ", c AS (SELECT quantile_cont(t, 0.8) AS cut FROM sub), f AS (SELECT regr_slope(score, t) AS b, regr_intercept(score, t) AS a FROM sub, c WHERE t <= cut) SELECT count(*) AS test_n, sqrt(avg(power(a + b * t - score, 2))) AS rmse FROM sub, c, f WHERE t > cut", "rmse")
def _(spark, d):
    sub = submissions(spark, d)
    x = sub.crossJoin(F.broadcast(stats.quantiles(sub, [], {"cut": ("t", 0.8)})))  # one row
    fit = moments.slope(x.where("t <= cut"), [], "score", "t").drop("n")
    e = F.col("intercept") + F.col("slope") * F.col("t") - F.col("score")
    return x.where("t > cut").crossJoin(F.broadcast(fit)).agg(F.count("*").alias("test_n"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query("r13_leave_one_family_out", SUB + ", f AS (SELECT h AS held_out, regr_slope(score, t) AS b, regr_intercept(score, t) AS a FROM sub, (SELECT DISTINCT kind AS h FROM sub) WHERE kind <> h GROUP BY h) SELECT held_out, count(*) AS n, sqrt(avg(power(a + b * t - score, 2))) AS rmse FROM f JOIN sub ON kind = held_out GROUP BY held_out", "rmse")
def _(spark, d):
    return frontier.leave_one_group_out(submissions(spark, d), "kind", "score", "t")


_LOGIT = "ln(greatest(0.001, least(0.999, {0} / 100)) / (1 - greatest(0.001, least(0.999, {0} / 100))))"


@query("r13_leave_one_row_out", SUB + ", z AS (SELECT kind, licence, log_n AS x, score AS s, " + _LOGIT.format("score") + """ AS z FROM sub),
g AS (SELECT kind, licence, count(*) AS n, count(DISTINCT x) AS xs, sum(x) AS sx, sum(z) AS sz, sum(x * x) AS sxx, sum(x * z) AS sxz, var_pop(s) * count(*) AS ss FROM z GROUP BY 1, 2),
l AS (SELECT kind, licence, n, xs, ss, x, s, sx - x AS ox, sz - z AS oz, least(0, ((n - 1) * (sxz - x * z) - (sx - x) * (sz - z)) / ((n - 1) * (sxx - x * x) - (sx - x) * (sx - x))) AS b FROM z JOIN g USING (kind, licence)),
e AS (SELECT kind, licence, sqrt(avg(power(100 / (1 + exp(-(oz / (n - 1) + b * (x - ox / (n - 1))))) - s, 2))) AS rmse, sqrt(avg(power(100 / (1 + exp(-oz / (n - 1))) - s, 2))) AS constant_rmse FROM l WHERE n >= 4 AND xs >= 3 GROUP BY 1, 2),
f AS (SELECT kind, licence, n, ss, least(0, (n * sxz - sx * sz) / (n * sxx - sx * sx)) AS slope, (sz - least(0, (n * sxz - sx * sz) / (n * sxx - sx * sx)) * sx) / n AS intercept FROM g)
SELECT kind, licence, n, intercept, slope, rmse, constant_rmse, 1 - rmse * rmse * n / ss AS r2, CASE WHEN rmse IS NULL THEN 'insufficient' WHEN slope < 0 AND rmse < constant_rmse THEN 'accepted' ELSE 'not_accepted' END AS status FROM f LEFT JOIN e USING (kind, licence)""", "intercept slope rmse constant_rmse r2")
def _(spark, d):
    """A falling line of the score's logit on size for each kind and licence, tested on each row without it."""
    return bridges.leave_one_row_out(submissions(spark, d), ["kind", "licence"], "log_n", "score")


@query("j11_ag38_dominance", "WITH " + RUNS_SQL + ", p AS (SELECT CAST(n AS BIGINT) % 5 AS fam, n, d, loss FROM run) SELECT a.fam, count(*) AS pairs, count(*) FILTER (round(b.loss - a.loss, 9) < 0) AS agree FROM p a JOIN p b ON a.fam = b.fam AND b.n > a.n AND b.d >= a.d + 25 GROUP BY a.fam")
def _(spark, d):
    p = runs(spark, d).withColumn("fam", F.col("n").cast("long") % 5)
    return pairs.dominance_pairs(p, "fam", 25.0)


@query("ag37_order_concordance", "WITH " + RUNS_SQL + ", p AS (SELECT n, d, loss, 1 + 3 / n - d / 1000 AS fit FROM run) SELECT a.n, count(*) AS pairs, avg(CAST((b.loss - a.loss < -1e-9) = (b.fit - a.fit < 0) AS INT)) AS concordance FROM p a JOIN p b ON a.n = b.n AND a.d < b.d GROUP BY a.n", "concordance")
def _(spark, d):
    p = runs(spark, d).withColumn("fit", 1 + 3 / F.col("n") - F.col("d") / 1000)
    return pairs.order_concordance(p, "n", "d", "loss", "fit").select("n", "pairs", "concordance")


_ORDER = "WITH " + RUNS_SQL + ", p AS (SELECT n, d, loss, 1 + 3 / n + sin(d) AS fit FROM run), s AS (SELECT n, loss - lag(loss) OVER w AS da, fit - lag(fit) OVER w AS dp FROM p WINDOW w AS (PARTITION BY n ORDER BY d))"
_ORDER += ", t AS (SELECT n, count(*) AS slopes, avg(CAST(sign(da) = sign(dp) AS INT)) AS slope_accuracy FROM s WHERE abs(da) > 1e-9 GROUP BY n)"
_ORDER += ", o AS (SELECT a.n, count(*) AS scored, avg(CAST((b.loss < a.loss) = (b.fit < a.fit) AS INT)) AS order_share FROM p a JOIN p b ON a.n = b.n AND a.d < b.d AND abs(a.loss - b.loss) > 5e-10 AND abs(a.fit - b.fit) > 5e-10 GROUP BY a.n)"


@query("ag37_direction_of_curves", _ORDER + " SELECT n, scored, order_share, slopes, slope_accuracy FROM o JOIN t USING (n)", "order_share slope_accuracy")
def _(spark, d):
    """How often a prediction moves as the curve does: between neighbouring points, and over all pairs of points that differ in both."""
    p = runs(spark, d).withColumn("fit", 1 + 3 / F.col("n") + F.sin("d"))
    order = pairs.order_concordance(p, "n", "d", "loss", "fit").select("n", "scored", "order_share")
    return order.join(pairs.slope_signs(p, "n", "d", "loss", "fit").withColumnRenamed("accuracy", "slope_accuracy"), "n")


@query("j10_nearest_size", "WITH " + RUNS_SQL + ", m AS (SELECT n, arg_max(loss, d) AS last FROM run GROUP BY n), t AS (SELECT unnest([3.4, 7.7, 21.2, 90.0]) AS n1) SELECT n1, arg_min(n, (abs(ln(n / n1)), n)) AS n, arg_min(last, (abs(ln(n / n1)), n)) AS last FROM t, m GROUP BY n1", "n1 n last")
def _(spark, d):
    last = runs(spark, d).groupBy("n").agg(F.max_by("loss", "d").alias("last"))
    targets = spark.sql("select explode(array(3.4D, 7.7D, 21.2D, 90.0D)) as n1")
    key = F.struct(F.abs(F.ln(F.col("n") / F.col("n1"))), F.col("n"))
    return last.crossJoin(F.broadcast(targets)).groupBy("n1").agg(F.min_by("n", key).alias("n"), F.min_by("last", key).alias("last"))


@query("g20_context_scenarios", "SELECT min(v) AS low, quantile_cont(v, 0.5) AS mid, max(v) AS high, count(*) AS sizes FROM (SELECT DISTINCT p_size AS v FROM part)", "low mid high")
def _(spark, d):
    v = table(spark, d, "part").select(F.col("p_size").alias("v")).distinct()
    return v.agg(F.min("v").alias("low"), F.percentile("v", 0.5).alias("mid"), F.max("v").alias("high"), F.count("*").alias("sizes"))


_R4 = LATEST + """, e AS (SELECT CASE WHEN day < DATE '2001-01-01' THEN 'early' ELSE 'late' END AS era, floor(log_n / 0.5) AS bin, developer, score FROM late),
 b AS (SELECT developer, bin, count(*) FILTER (era = 'early') AS n0, count(*) FILTER (era = 'late') AS n1, coalesce(sum(score) FILTER (era = 'early'), 0) AS t0, coalesce(sum(score) FILTER (era = 'late'), 0) AS t1 FROM e GROUP BY 1, 2),
 u AS (SELECT rep, b.*, (CAST('0x' || substr(sha256('block|' || rep || '|' || developer), 1, 12) AS BIGINT) / 281474976710656.0) AS u FROM b, range(40) r(rep)),
 w AS (SELECT *, """ + " + ".join(f"CAST(u >= {c} AS INT)" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)) + """ AS k FROM u),
 c AS (SELECT rep, bin, sum(k * n0) AS n0, sum(k * n1) AS n1, sum(k * t0) AS t0, sum(k * t1) AS t1 FROM w GROUP BY 1, 2), x AS (SELECT rep, n0 / sum(n0) OVER (PARTITION BY rep) AS s0, n1 / sum(n1) OVER (PARTITION BY rep) AS s1, t0 / n0 AS m0, t1 / n1 AS m1 FROM c WHERE n0 >= 2 AND n1 >= 2),
 r AS (SELECT rep, sum((s1 - s0) * (m0 + m1) / 2) AS mix, sum((m1 - m0) * (s0 + s1) / 2) AS within_cells FROM x GROUP BY rep)
 SELECT quantile_cont(mix, 0.025) AS mix_low, quantile_cont(mix, 0.975) AS mix_high, quantile_cont(within_cells, 0.025) AS within_low, quantile_cont(within_cells, 0.975) AS within_high FROM r"""


@query("r4_block_bootstrap", _R4, "mix_low mix_high within_low within_high")
def _(spark, d):
    """Intervals of the decomposition when whole developers are drawn."""
    sub = latest(submissions(spark, d)).withColumn("era", F.when(F.col("day") < "2001-01-01", "early").otherwise("late"))
    r = frontier.decompose_replicates(sub, "developer", 0.5, 40, "block")
    ends = lambda c, n: [F.percentile(c, 0.025).alias(f"{n}_low"), F.percentile(c, 0.975).alias(f"{n}_high")]
    return r.agg(*ends("mix", "mix"), *ends("within_cells", "within"))


@query("m17_quantile_regression", None, "slope intercept below")
def _(spark, d):
    return frontier.quantile_fit(submissions(spark, d), "score", "t", 0.9)
