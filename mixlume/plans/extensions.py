"""Queries on quality extensions, nested validation, bridges, bounded optima, transitions, and further scans and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlume.operators import allocation, budget, extensions, laws, mixture, stats
from mixlume.plans.entities import LOSSES, MIX, RECIPES_SQL, RUNS_SQL, SUBMISSIONS_SQL, runs, submissions, table
from mixlume.plans.mixture import recipe_table
from mixlume.plans.registry import query
from mixlume.sources import io

REC = "WITH " + RECIPES_SQL
_LAW_Q = (1.05, 2.5, 0.9, 0.1, 0.3, 0.4)
_U = "(CAST('0x' || substr(sha256({}), 1, 12) AS BIGINT) / 281474976710656.0)"
_POISSON = "(" + " + ".join(f"CAST({{0}} >= {c} AS INT)" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)) + ")"


def ndq(spark: SparkSession, d: str) -> DataFrame:
    """idx, n, d, q, loss: recipes as points of size, tokens and quality."""
    q, _ = allocation.quality_proxy(F.col("loss_b"), 0.02, 0.057)
    return recipe_table(spark, d).select("idx", (1 + F.col("loss_d") * 10).alias("n"), (20 + F.col("loss_c") * 50).alias("d"), q.alias("q"), (1 + F.col("loss_a")).alias("loss"))


_NDQ = REC + ", p AS (SELECT idx, 1 + loss_d * 10 AS n, 20 + loss_c * 50 AS d, least(1.0, greatest(0.0, (loss_b - 0.02) / 0.037)) AS q, 1 + loss_a AS loss FROM rec)"

_NAMES = {"tools": ["gear", "bolt", "widget"], "jewels": ["ring", "gem"], "small": ["small", "tiny"]}


@query("p22_source_family", "SELECT family, count(*) AS parts FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(p_name), {chr(39)}{x}{chr(39)})' for x in v)} THEN '{k}'" for k, v in _NAMES.items()) + " ELSE 'other' END AS family FROM part) GROUP BY family")
def _(spark, d):
    return table(spark, d, "part").groupBy(extensions.first_match(F.col("p_name"), _NAMES).alias("family")).agg(F.count("*").alias("parts"))


@query("p23_comparability", "SELECT o_custkey, bool_and(o_totalprice > 0 AND o_orderstatus IS NOT NULL) AS all_usable, CASE WHEN bool_and(starts_with(lower(o_orderpriority), '1') OR starts_with(lower(o_orderpriority), '2')) THEN 'direct' WHEN bool_or(starts_with(lower(o_orderpriority), '1')) THEN 'near_direct' ELSE 'inferred' END AS grade FROM orders GROUP BY o_custkey")
def _(spark, d):
    p = F.lower("o_orderpriority")
    grade = F.when(F.bool_and(p.startswith("1") | p.startswith("2")), "direct").when(F.bool_or(p.startswith("1")), "near_direct").otherwise("inferred")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and((F.col("o_totalprice") > 0) & F.col("o_orderstatus").isNotNull()).alias("all_usable"), grade.alias("grade"))


@query("ag39_model_wins", "WITH " + RUNS_SQL + ", b AS (SELECT quantile_cont(d, 0.1) AS lo, quantile_cont(d, 0.9) AS hi FROM run), e AS (SELECT CAST(n AS BIGINT) % 4 AS scope, CASE WHEN d BETWEEN lo AND hi THEN 'inside' ELSE 'outside' END AS support, round(abs(1.05 + 3 / n - loss), 9) AS a, round(abs(1.05 + 2.5 * power(n, -0.9) - loss), 9) AS b FROM run, b) SELECT scope, support, count(*) AS points, count(*) FILTER (a < b) AS first_better, count(*) FILTER (a = b) AS ties, count(*) FILTER (a > b) AS second_better FROM e GROUP BY 1, 2")
def _(spark, d):
    """Which of two models is closer, counted by scope and support."""
    r = runs(spark, d)
    b = stats.quantiles(r, [], {"lo": ("d", 0.1), "hi": ("d", 0.9)})
    e = r.crossJoin(F.broadcast(b)).select(
        (F.col("n").cast("long") % 4).alias("scope"), F.when(F.col("d").between(F.col("lo"), F.col("hi")), "inside").otherwise("outside").alias("support"),
        F.round(F.abs(1.05 + 3 / F.col("n") - F.col("loss")), 9).alias("a"), F.round(F.abs(1.05 + 2.5 * F.pow("n", F.lit(-0.9)) - F.col("loss")), 9).alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return e.groupBy("scope", "support").agg(F.count("*").alias("points"), F.count_if(a < b).alias("first_better"), F.count_if(a == b).alias("ties"), F.count_if(a > b).alias("second_better"))


@query("ag42_strata", "WITH " + SUBMISSIONS_SQL + " SELECT kind, licence, count(*) AS rows, count(DISTINCT model) AS models, min(day) AS first_day, max(day) AS last_day, CASE WHEN count(*) >= 100 AND kind = 'F' THEN 'comparable' WHEN count(*) >= 100 THEN 'context_only' ELSE 'too_few' END AS status FROM sub GROUP BY kind, licence", "", "first_day last_day")
def _(spark, d):
    n = F.count("*")
    status = F.when((n >= 100) & (F.col("kind") == "F"), "comparable").when(n >= 100, "context_only").otherwise("too_few")
    return submissions(spark, d).groupBy("kind", "licence").agg(n.alias("rows"), F.count_distinct("model").alias("models"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), status.alias("status"))


@query("s3_file_scan", " UNION ALL ".join(f"SELECT '{t}' AS file, count(*) AS rows FROM {t}" for t in ("customer", "orders", "part", "supplier")))
def _(spark, d):
    """Several files in one scan, each row with the name of its file."""
    return io.scan_files(spark, f"{d}/{{customer,orders,part,supplier}}.parquet", "parquet", r"([^/]+)\.parquet").groupBy("file").agg(F.count("*").alias("rows"))


@query("s6_paired_scopes", "SELECT o_orderstatus AS scope, count(*) AS pairs, avg(l_discount) AS mean_loss, avg(o_totalprice) AS mean_size FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "mean_loss mean_size")
def _(spark, d):
    """Two tables of each scope joined by key and stacked with the scope as a column."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    scopes = {s: (orders.where(F.col("o_orderstatus") == s), lines) for s in ("F", "O", "P")}
    return io.paired(scopes, "o_orderkey").groupBy("scope").agg(F.count("*").alias("pairs"), F.avg("l_discount").alias("mean_loss"), F.avg("o_totalprice").alias("mean_size"))


@query("s7_nested_results", "WITH e AS (SELECT user_id, count(*) FILTER (contains(event_type, 'purchase')) AS n, max(value) FILTER (contains(event_type, 'purchase')) AS v FROM (SELECT user_id, event_type, round(value, 6) AS value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY event_id) AS r, CAST(ts AS DATE) AS day FROM events) GROUP BY user_id, day) SELECT CASE WHEN n = 1 THEN 'one' WHEN n = 0 THEN 'none' ELSE 'several' END AS status, count(*) AS files, sum(CASE WHEN n = 1 THEN v END) AS total FROM e GROUP BY 1", "total")
def _(spark, d):
    """Files of nested JSON: the one result whose data has the tag; none or several are a status. The files are a user's events of a day."""
    results = F.collect_list(F.struct(F.col("event_type").alias("val_data"), F.round("value", 6).alias("value")))
    files = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.to_json(F.struct(results.alias("results"))).alias("body"))
    return io.single_result(files, "body", "purchase").groupBy("status").agg(F.count("*").alias("files"), F.sum("value").alias("total"))


_MARGINALS = _NDQ + ", m AS (SELECT idx, 0.9 * 2.5 * power(n, -1.9) AS dn, 0.1 * 0.3 * power(d, -1.3) * exp(-0.4 * q) AS dd, 0.4 * 0.1 * power(d, -0.3) * exp(-0.4 * q) AS dq, n FROM p)"


@query("g26_tradeoffs", _MARGINALS + " SELECT idx, dn * 1000 AS per_size, dd * 1000 AS per_token, dq * 1000 AS per_quality, dq / dn AS size_for_quality, dd / dn AS size_for_token, n * dn / dq AS quality_for_size FROM m", "per_size per_token per_quality size_for_quality size_for_token quality_for_size")
def _(spark, d):
    """Marginal gains of size, tokens and quality, and how much size an increment of quality or tokens is worth at equal loss."""
    p = ndq(spark, d)
    _, dn, dd, dq = allocation.conditional_loss(F.col("n"), F.col("d"), F.col("q"), _LAW_Q)
    m = p.select("idx", "n", (-dn).alias("dn"), (-dd).alias("dd"), (-dq).alias("dq"))
    return m.select("idx", (F.col("dn") * 1000).alias("per_size"), (F.col("dd") * 1000).alias("per_token"), (F.col("dq") * 1000).alias("per_quality"), (F.col("dq") / F.col("dn")).alias("size_for_quality"), (F.col("dd") / F.col("dn")).alias("size_for_token"), (F.col("n") * F.col("dn") / F.col("dq")).alias("quality_for_size"))



@query("m16_bridge_panel", "WITH x AS (SELECT l_returnflag AS grade, l_quantity / 10 AS loss, l_extendedprice / 10000 AS size, l_tax * 100 - l_quantity / 20 AS s FROM lineitem), c AS (SELECT grade, count(*) AS n, var_pop(s) AS v, covar_pop(loss, s) AS c1, covar_pop(size, s) AS c2, var_pop(loss) AS v1, var_pop(size) AS v2, covar_pop(loss, size) AS c12 FROM x GROUP BY grade) SELECT grade, unnest(['constant', 'loss', 'loss_and_size', 'monotone']) AS model, n, sqrt(unnest([v, v - c1 * c1 / v1, v - (c1 * (v2 * c1 - c12 * c2) + c2 * (v1 * c2 - c12 * c1)) / (v1 * v2 - c12 * c12), CASE WHEN c1 > 0 THEN v ELSE v - c1 * c1 / v1 END])) AS rmse FROM c", "rmse")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grade"), (F.col("l_quantity") / 10).alias("loss"), (F.col("l_extendedprice") / 10000).alias("size"), (F.col("l_tax") * 100 - F.col("l_quantity") / 20).alias("s"))
    return extensions.bridge_panel(x, "grade", "s", "loss", "size")


@query("m18_frontier_candidates", "WITH " + SUBMISSIONS_SQL + ", f AS (SELECT kind, regr_slope(score, t) AS b, regr_intercept(score, t) AS a, max(t) AS t1, quantile_cont(score, 0.9) AS q FROM sub GROUP BY kind), r AS (SELECT kind, quantile_cont(score - a - b * t, 0.9) AS s FROM sub JOIN f USING (kind) GROUP BY kind) SELECT kind, unnest(['constant', 'trend', 'mean']) AS candidate, unnest([q, a + b * (t1 + 6) + s, a + b * (t1 + 6)]) AS forecast FROM f JOIN r USING (kind)", "forecast")
def _(spark, d):
    return extensions.frontier_candidates(submissions(spark, d), ["kind"], "score", "t", 0.9, 6.0)


_REPS = 40


@query("r7_two_level_bootstrap", REC + ", e AS (" + " UNION ALL ".join(f"SELECT idx, '{t}' AS target, power({t} - {v}, 2) AS e FROM rec" for t, v in (("loss_a", 0.05), ("loss_b", 0.04), ("loss_c", 0.5), ("loss_d", 0.4))) + f"), w AS (SELECT rep, e, {_POISSON.format(_U.format(chr(39) + 'two-row|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || idx'))} * {_POISSON.format(_U.format(chr(39) + 'two-target|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || target'))} AS w FROM e, range({_REPS}) r(rep)), m AS (SELECT rep, sum(w * e) / nullif(sum(w), 0) * 100 AS m FROM w GROUP BY rep) SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m", "low high")
def _(spark, d):
    """Interval of the mean squared error over targets and recipes, both drawn."""
    at = {"loss_a": 0.05, "loss_b": 0.04, "loss_c": 0.5, "loss_d": 0.4}
    e = recipe_table(spark, d).select("idx", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), (F.pow(F.col(t) - v, 2) * 100).alias("e")) for t, v in at.items()])))
    return extensions.two_level_bootstrap(e, "idx", "target", "e", _REPS, "two")


@query("r8_cluster_bootstrap", "WITH x AS (SELECT CAST(l_quantity AS BIGINT) AS n, l_returnflag AS d, l_tax AS q, l_discount AS y FROM lineitem), g AS (SELECT n, d, count(*) AS k, sum(q) AS sx, sum(y) AS sy, sum(q * q) AS sxx, sum(q * y) AS sxy FROM x GROUP BY 1, 2), w AS (SELECT rep, g.*, " + _POISSON.format(_U.format("'cluster|' || rep || '|' || n || '/' || d")) + f" AS w FROM g, range({_REPS}) r(rep)), s AS (SELECT rep, sum(w * k) AS s0, sum(w * sx) AS s1, sum(w * sy) AS s2, sum(w * sxx) AS s3, sum(w * sxy) AS s4 FROM w GROUP BY rep), b AS (SELECT (s0 * s4 - s1 * s2) / nullif(s0 * s3 - s1 * s1, 0) AS b FROM s) SELECT quantile_cont(b, 0.025) AS low, quantile_cont(b, 0.975) AS high FROM b", "low high")
def _(spark, d):
    """Interval of a quality slope when all qualities of one (size, tokens) are drawn together."""
    x = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("n"), F.col("l_returnflag").alias("d"), F.col("l_tax").alias("q"), F.col("l_discount").alias("y"))
    return extensions.cluster_bootstrap_slope(x, ["n", "d"], "y", "q", _REPS, "cluster")


def _law_points(spark: SparkSession, d: str) -> DataFrame:
    """ndq() with y, q in (0, 1] and coarse levels of size, tokens and quality."""
    p = ndq(spark, d).withColumn("q", 0.05 + 0.95 * F.col("q")).withColumnRenamed("loss", "y")
    return p.withColumns({"n_level": F.floor("n").cast("int"), "d_level": F.floor(F.col("d") / 5).cast("int"), "q_level": F.floor(F.col("q") * 4).cast("int")})


_AXES = ("n_level", "d_level", "q_level")


@query("m12_quality_families", None, "e a alpha b beta g rmse selection_score")
def _(spark, d):
    """Three families of quality terms fitted on all points and with each level of size, tokens and quality held out; the family with the least mean error is selected."""
    fits, scores = laws.family_panel(_law_points(spark, d), {k: F.col(k) for k in _AXES})
    return fits.join(scores, "family")


@query("r8_family_bootstrap", None, "e a alpha b beta g")
def _(spark, d):
    """Refits of the linear family when whole (size, tokens) cells are drawn, all qualities of a cell together; draws without a positive fit are rows, too."""
    p = _law_points(spark, d)
    fits = laws.fit_folds(p, ["linear"], {}, reps=20, cluster=F.concat_ws("/", F.col("n_level"), F.col("d_level")))
    return laws.as_table(spark, fits).where("axis = 'replicate'").select("level", "status", "e", "a", "alpha", "b", "beta", "g")


@query("m13_quality_increment", None, "ridge g0 g1 g2 rmse")
def _(spark, d):
    """What lacking quality adds to a backbone that is fixed at the fitted law without quality, not negative at the corners of the data; the ridge is chosen inside each fold."""
    p = _law_points(spark, d)
    full = next((f for f in laws.fit_folds(p, ["none"], {}) if f["status"] != "NO_POSITIVE_FIT"), None)
    backbone = budget.classic(F.col("n"), F.col("d"), *[full[k] for k in ("e", "a", "alpha", "b", "beta")]) if full else F.lit(1.0)
    low = p.agg(F.min("n"), F.max("n"), F.min("d"), F.max("d")).first()
    ends = [float(v) for v in low] if low[0] is not None else [1.0, 2.0, 1.0, 2.0]
    return laws.quality_increment(p, backbone, (0.0, 0.01, 0.1, 1.0), {k: F.col(k) for k in _AXES}, (ends[0], ends[1]), (ends[2], ends[3]))


@query("r11_nested_validation", None, "rmse")
def _(spark, d):
    """Linear shares against shares with interactions, chosen with their ridge inside each outer fold."""
    rec = recipe_table(spark, d)
    varied = [r["domain"] for r in mixture.most_variable(rec, MIX, 5).collect()]  # five names
    models = {"linear": MIX[:5], "interaction": [*MIX[:5], *mixture.interaction_names(varied)]}
    return extensions.nested_validation(mixture.with_interactions(rec, varied), "idx", models, "loss_a", (0.01, 0.1, 1.0, 10.0))


def _panel(spark, d):
    rec = recipe_table(spark, d)
    varied = [r["domain"] for r in mixture.most_variable(rec, MIX, 5).collect()]  # five names
    models = {"linear": MIX[:5], "interaction": [*MIX[:5], *mixture.interaction_names(varied)]}
    return extensions.nested_panel(mixture.with_interactions(rec, varied), "idx", models, LOSSES, (0.01, 0.1, 1.0, 10.0))


@query("r11_nested_panel", None, "inner_sse rmse")
def _(spark, d):
    """Both models in each outer fold for each of the four losses, and which of them the inner folds prefer."""
    return _panel(spark, d)


@query("r11_model_comparison", None, "median_rmse worst_rmse")
def _(spark, d):
    return extensions.compare_models(_panel(spark, d))


@query("m8_boosted_trees", None, "rmse")
def _(spark, d):
    """Boosted trees for each of the four losses; Spark's trees depend on sums in any order, so the rmse is given to three digits."""
    out = extensions.boosted(recipe_table(spark, d), "idx", MIX, LOSSES)
    return out.withColumn("rmse", F.round("rmse", 3))
