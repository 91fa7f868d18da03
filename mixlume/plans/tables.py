"""Queries on scans, checks, predicates, joins and windows over the order tables and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.operators import resample, stats, validate
from mixlume.plans.entities import RUNS_SQL, SUBMISSIONS_SQL, runs, submissions, table
from mixlume.plans.registry import query
from mixlume.sources import io


@query("s4_newest_parseable", """WITH f AS (SELECT user_id % 50 AS dir, event_id AS name, props AS body FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY name DESC) AS r FROM f WHERE json_valid(body)) SELECT dir, name, CAST(json_extract(body, '$.k') AS BIGINT) AS k FROM g WHERE r = 1""")
def _(spark, d):
    files = table(spark, d, "events").select((F.col("user_id") % 50).alias("dir"), F.col("event_id").alias("name"), F.col("props").alias("body"))
    wrapped = files.withColumn("body", F.when(F.expr("try_parse_json(body) is not null"), F.concat(F.lit('{"results":{"t":'), "body", F.lit("}}"))).otherwise(F.col("body")))
    newest, _ = io.newest_parseable(wrapped, "dir", "name", "body")
    return newest.select("dir", "name", F.col("results")["t"]["k"].try_cast("long").alias("k"))


@query("s5_dead_letters", "WITH f AS (SELECT 'event' AS dir, CAST(event_id AS VARCHAR) AS name, props AS body FROM events UNION ALL SELECT 'turn', conv_id || ':' || turn, text FROM conversations) SELECT dir, name, CASE WHEN trim(coalesce(body, '')) = '' THEN 'empty' ELSE 'not JSON' END AS reason FROM f WHERE NOT coalesce(json_valid(body), false)")
def _(spark, d):
    """Bodies of events and turns of conversations as files of one folder: those that aren't JSON, with a reason."""
    events = table(spark, d, "events").select(F.lit("event").alias("dir"), F.col("event_id").cast("string").alias("name"), F.col("props").alias("body"))
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("dir"), F.concat_ws(":", "conv_id", "turn").alias("name"), F.col("text").alias("body"))
    return io.newest_parseable(events.unionByName(turns), "dir", "name", "body")[1].select("dir", "name", "reason")


@query("f6_json_values", "SELECT event_type, count(*) AS rows, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY event_type", "k")
def _(spark, d):
    parsed = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,double>"))
    return parsed.select("event_type", F.explode(F.map_filter("m", lambda k, v: k.startswith("k"))).alias("key", "v")).groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("v").alias("k"))


@query("s9_inventory_difference", "SELECT CAST(s_suppkey AS BIGINT) AS key, 'missing' AS status FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey + 10 FROM lineitem WHERE l_quantity = 1) UNION ALL SELECT DISTINCT l_suppkey + 10, 'unexpected' FROM lineitem WHERE l_quantity = 1 AND l_suppkey + 10 NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    expected = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"))
    present = table(spark, d, "lineitem").where("l_quantity = 1").select((F.col("l_suppkey") + 10).alias("key"))
    return validate.inventory_difference(expected, present, "key")


@query("p13_p14_model_type_open", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'pretrained' WHEN o_orderpriority LIKE '%HIGH%' THEN 'fine-tuned' WHEN o_orderpriority LIKE '%MEDIUM%' THEN 'merge' ELSE 'other' END AS kind, CASE WHEN o_orderstatus = 'F' THEN false ELSE o_orderpriority NOT LIKE '%NOT SPECIFIED%' END AS is_open FROM orders")
def _(spark, d):
    p = F.lower("o_orderpriority")
    kind = F.when(p.contains("urgent"), "pretrained").when(p.contains("high"), "fine-tuned").when(p.contains("medium"), "merge").otherwise("other")
    return table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), F.when(F.col("o_orderstatus") == "F", False).otherwise(~p.contains("not specified")).alias("is_open"))


@query("p15_complete_cases", "WITH " + SUBMISSIONS_SQL + " SELECT kind, count(*) AS rows, count(*) FILTER (score IS NOT NULL AND day IS NOT NULL AND score BETWEEN 0 AND 90) AS complete FROM sub GROUP BY kind")
def _(spark, d):
    ok = F.col("score").isNotNull() & F.col("day").isNotNull() & F.col("score").between(0, 90)
    return submissions(spark, d).groupBy("kind").agg(F.count("*").alias("rows"), F.count_if(ok).alias("complete"))


_RULES = [
    ("short", "length(text) < 300", "char_length(text) < 300"), ("licence", "regexp_matches(text, '(?i)\\blicensed\\b')", "text rlike '(?i)\\\\blicensed\\\\b'"), ("mail", "contains(text, '@')", "contains(text, '@')"), ("table", "contains(text, '|')", "contains(text, '|')"), ("foreign", "lang <> 'en'", "lang <> 'en'"),
    ("missing_text", "text IS NULL OR regexp_matches(text, '^[ \\t\\r\\n]*$')", "text is null or text rlike '^[ \\\\t\\\\r\\\\n]*\\\\z'"), ("missing_language", "lang IS NULL OR trim(lang) = ''", "lang is null or trim(lang) = ''"), ("missing_source", "source IS NULL OR trim(source) = ''", "source is null or trim(source) = ''"),
    ("very_long", "length(text) > 50000", "char_length(text) > 50000"), ("link", "regexp_matches(text, '(?i)https?://')", "text rlike '(?i)https?://'"), ("no_sentence", "NOT regexp_matches(text, '[.!?]')", "not text rlike '[.!?]'"),
    ("many_digits", "length(regexp_replace(text, '[^0-9]', '', 'g')) > 0.1 * length(text)", "char_length(regexp_replace(text, '[^0-9]', '')) > 0.1 * char_length(text)"),
]


@query("p16_exclusion_reasons", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql, _ in _RULES) + "], lambda x: x IS NOT NULL), ';') AS reasons FROM documents")
def _(spark, d):
    reasons = validate.reasons({n: F.expr(s) for n, _, s in _RULES})
    return table(spark, d, "documents").select("doc_id", F.array_join(reasons, ";").alias("reasons"))


@query("ag28_reason_counts", "SELECT reason, count(*) AS rows FROM (SELECT unnest(list_filter([" + ", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql, _ in _RULES) + "], lambda x: x IS NOT NULL)) AS reason FROM documents) GROUP BY reason")
def _(spark, d):
    return table(spark, d, "documents").select(F.explode(validate.reasons({n: F.expr(s) for n, _, s in _RULES})).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


@query("p17_ratio_gates", "SELECT l_returnflag, count(*) FILTER (r BETWEEN 0.5 AND 2) AS primary_rows, count(*) FILTER (r BETWEEN 0.1 AND 10) AS wide_rows FROM (SELECT l_returnflag, l_extendedprice / (l_quantity * 1500) AS r FROM lineitem) GROUP BY 1")
def _(spark, d):
    r = F.col("l_extendedprice") / (F.col("l_quantity") * 1500)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(r.between(0.5, 2)).alias("primary_rows"), F.count_if(r.between(0.1, 10)).alias("wide_rows"))


@query("p18_numbers", "SELECT o_orderkey, TRY_CAST(nullif(trim(split_part(o_orderpriority, '-', CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END)), '') AS DOUBLE) AS v FROM orders")
def _(spark, d):
    part = F.when(F.col("o_orderkey") % 2 == 0, F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).otherwise(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    return table(spark, d, "orders").select("o_orderkey", expr.number(part).alias("v"))


_LOGIT = "ln(least(0.999, greatest(0.001, score / 100)) / (1 - least(0.999, greatest(0.001, score / 100))))"


@query("p19_bounded_logit", "WITH " + SUBMISSIONS_SQL + f" SELECT row_no, {_LOGIT} AS z, 100 / (1 + exp(-{_LOGIT})) AS back FROM sub", "z back")
def _(spark, d):
    z = expr.bounded_logit(F.col("score"))
    return submissions(spark, d).select("row_no", z.alias("z"), expr.score_of_logit(z).alias("back"))


@query("p20_p21_support", "WITH " + RUNS_SQL + """, b AS (SELECT quantile_cont(n, 0.1) AS n0, quantile_cont(n, 0.9) AS n1, quantile_cont(d, 0.1) AS d0, quantile_cont(d, 0.9) AS d1 FROM run)
SELECT n, d, CASE WHEN (n < n0 OR n > n1) AND (d < d0 OR d > d1) THEN 'both_outside' WHEN n < n0 OR n > n1 THEN 'N_outside' WHEN d < d0 OR d > d1 THEN 'D_outside' ELSE 'inside' END AS support,
 sqrt(power(greatest(0, ln(n0 / n), ln(n / n1)), 2) + power(greatest(0, ln(d0 / d), ln(d / d1)), 2)) AS distance FROM run, b""", "distance")
def _(spark, d):
    r = runs(spark, d)
    x = r.crossJoin(F.broadcast(stats.quantiles(r, [], {"n0": ("n", 0.1), "n1": ("n", 0.9), "d0": ("d", 0.1), "d1": ("d", 0.9)})))
    return x.select("n", "d", validate.support("n", "d").alias("support"), validate.extrapolation_distance("n", "d").alias("distance"))


@query("p24_trailing_blanks", r"SELECT doc_id, sha256(regexp_replace(text, '[ \t]+(\n|$)', '\1', 'g')) AS clean FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace("text", r"[ \t]+(\n|$)", "$1"), 256).alias("clean"))


@query("p25_identity_checks", "WITH x AS (SELECT l_returnflag, l_extendedprice / (l_quantity * (1000 + l_partkey % 1000)) AS r FROM lineitem) SELECT l_returnflag, count(*) AS rows, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.95) AS p95, count(*) FILTER (abs(r - 1) > 0.05) AS outliers FROM x GROUP BY 1", "median p95")
def _(spark, d):
    r = F.col("l_extendedprice") / (F.col("l_quantity") * (1000 + F.col("l_partkey") % 1000))
    x = table(spark, d, "lineitem").select("l_returnflag", r.alias("r"))
    return stats.summarised(x, ["l_returnflag"], [F.count("*").alias("rows"), F.count_if(F.abs(F.col("r") - 1) > 0.05).alias("outliers")], {"median": ("r", 0.5), "p95": ("r", 0.95)})


@query("p26_derived_keys", "WITH " + SUBMISSIONS_SQL + " SELECT row_no, floor(log_n / 0.5) AS bin, strftime(day, '%Y-%m') AS month, t FROM sub", "bin t")
def _(spark, d):
    return submissions(spark, d).select("row_no", F.floor(F.col("log_n") / 0.5).cast("double").alias("bin"), F.date_format("day", "yyyy-MM").alias("month"), "t")


@query("p27_rule_violations", "WITH v AS (SELECT c_custkey AS key, 'c_acctbal' AS col, 'positive' AS rule, CAST(c_acctbal AS VARCHAR) AS value FROM customer WHERE c_acctbal IS NULL OR c_acctbal <= 0 UNION ALL SELECT c_custkey, 'c_mktsegment', 'enum', c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') UNION ALL SELECT c_custkey, 'c_name', 'required', c_name FROM customer WHERE c_name IS NULL OR trim(c_name) = '') SELECT col, rule, count(*) AS rows, min(key) AS first_key FROM v GROUP BY 1, 2")
def _(spark, d):
    rules = {"c_acctbal": ("positive", None), "c_mktsegment": ("enum", ["BUILDING", "MACHINERY", "HOUSEHOLD"]), "c_name": ("required", None)}
    return validate.violations(table(spark, d, "customer"), "c_custkey", rules).groupBy("col", "rule").agg(F.count("*").alias("rows"), F.min("key").alias("first_key"))


@query("p32_control_characters", "SELECT lang, count(*) FILTER (regexp_matches(text, '[\n\r\t]')) AS with_control FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("[\n\r\t]")).alias("with_control"))


@query("ag29_column_profile", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ') SELECT "column", count(*) AS rows, count(*) FILTER (value IS NULL) AS missing, min(value) AS min, max(value) AS max, count(DISTINCT value) AS distinct_values FROM l GROUP BY "column"', "min max")
def _(spark, d):
    return stats.column_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("j1_one_to_one", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS left_repeated, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS right_repeated, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS left_only, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS right_only")
def _(spark, d):
    return validate.key_check(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("j7_coordinate_overlap", "WITH a AS (SELECT l_quantity AS n, l_discount AS q, avg(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_quantity AS n, l_discount AS q, avg(l_tax) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT count(*) AS shared, count(*) FILTER (abs(a.v - b.v) < 1e-9) AS equal, max(abs(a.v - b.v)) AS largest FROM a JOIN b USING (n, q)", "largest")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    side = lambda f, name: lines.where(F.col("l_returnflag") == f).groupBy(F.col("l_quantity").alias("n"), F.col("l_discount").alias("q")).agg(F.avg("l_tax").alias(name))
    gap = F.abs(F.col("a") - F.col("b"))
    return side("A", "a").join(side("R", "b"), ["n", "q"]).agg(F.count("*").alias("shared"), F.count_if(gap < 1e-9).alias("equal"), F.max(gap).alias("largest"))


@query("j8_key_coverage", "SELECT count(DISTINCT c_custkey) AS keys, count(DISTINCT c_custkey) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS uncovered FROM customer")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct()
    missing = keys.join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti").withColumn("gone", F.lit(1))
    return keys.join(missing, "k", "left").agg(F.count("*").alias("keys"), F.count("gone").alias("uncovered"))


@query("j16_many_to_one", "SELECT n_name, count(*) AS customers, avg(c_acctbal) AS mean_balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name", "mean_balance")
def _(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return validate.many_to_one(table(spark, d, "customer"), nation, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("mean_balance"))


@query("ag43_group_structure", "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS steps, count(*) = count(DISTINCT l_linenumber) AS unique_steps FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    n, k = F.count("*"), F.count_distinct("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(n.alias("rows"), k.alias("steps"), (n == k).alias("unique_steps"))


@query("ag44_support_ratio", "SELECT l_linestatus, avg(CAST(l_extendedprice > 50000 AS INT)) AS beyond FROM lineitem GROUP BY 1", "beyond")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.avg((F.col("l_extendedprice") > 50000).cast("int")).alias("beyond"))


@query("ag34_group_weights", "WITH c AS (SELECT l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1) SELECT g, n, 1.0 / ((SELECT count(*) FROM c) * n) AS weight FROM c", "weight")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.count("*").alias("k")))).select("g", "n", (1.0 / (F.col("k") * F.col("n"))).alias("weight"))


@query("ag23_task_summary", "WITH t AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS low, max(v) AS high, count(*) AS tasks FROM t GROUP BY user_id", "mean sd low high")
def _(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return t.groupBy("user_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("tasks"))


@query("ag24_profile_quantiles", "WITH t AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) SELECT quantile_cont(v, 0.1) AS q10, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.9) AS q90, count(*) FILTER (v > 10) AS over_ten FROM t", "q10 q50 q90")
def _(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("v"))
    return stats.summarised(t, [], [F.count_if(F.col("v") > 10).alias("over_ten")], {"q10": ("v", 0.1), "q50": ("v", 0.5), "q90": ("v", 0.9)})


@query("ag25_source_year_profile", "SELECT o_orderstatus AS source, year(o_orderdate) AS y, o_orderpriority AS task, avg(o_totalprice) AS mean, count(*) AS rows FROM orders GROUP BY 1, 2, 3", "mean")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("source"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("task")).agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("rows"))


@query("w2_ranks", "SELECT o_orderkey, rank() OVER w AS r, percent_rank() OVER w AS pr FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)", "pr")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    placed = resample.places(o, ["o_orderstatus"], "o_totalprice")  # places from below; the rank from above is one more than the rows above
    r = F.col("_of") - F.col("_place") + 1
    return placed.select("o_orderkey", r.alias("r"), ((r - 1) / F.nullif(F.col("_of") - 1, F.lit(0))).alias("pr"))


@query("w3_finite_differences", "WITH " + RUNS_SQL + ", x AS (SELECT n, d, round(loss - lag(loss) OVER (PARTITION BY n ORDER BY d), 9) AS dl FROM run) SELECT n, count(dl) AS steps, count(*) FILTER (dl < 0) AS down, count(*) FILTER (dl > 0) AS up FROM x GROUP BY n")
def _(spark, d):
    dl = F.round(F.col("loss") - F.lag("loss").over(Window.partitionBy("n").orderBy("d")), 9)
    return runs(spark, d).withColumn("dl", dl).groupBy("n").agg(F.count("dl").alias("steps"), F.count_if(F.col("dl") < 0).alias("down"), F.count_if(F.col("dl") > 0).alias("up"))


@query("w4_monotone", "WITH " + RUNS_SQL + ", x AS (SELECT n, d > lag(d) OVER w AS inc, loss <= lag(loss) OVER w AS dec FROM run WINDOW w AS (PARTITION BY n ORDER BY d)) SELECT n, bool_and(coalesce(inc, true)) AS d_increasing, bool_and(coalesce(dec, true)) AS loss_falling FROM x GROUP BY n")
def _(spark, d):
    w = Window.partitionBy("n").orderBy("d")
    x = runs(spark, d).select("n", (F.col("d") > F.lag("d").over(w)).alias("inc"), (F.col("loss") <= F.lag("loss").over(w)).alias("dec"))
    return x.groupBy("n").agg(F.bool_and(F.coalesce("inc", F.lit(True))).alias("d_increasing"), F.bool_and(F.coalesce("dec", F.lit(True))).alias("loss_falling"))


@query("w5_tail_split", "WITH " + RUNS_SQL + ", x AS (SELECT n, d, row_number() OVER (PARTITION BY n ORDER BY d) AS r, count(*) OVER (PARTITION BY n) AS k FROM run) SELECT n, d, CASE WHEN r <= greatest(1, least(k - 1, k * 7 // 10)) THEN 'train' ELSE 'tail' END AS part FROM x")
def _(spark, d):
    w = Window.partitionBy("n")
    r, k = F.row_number().over(w.orderBy("d")), F.count("*").over(w)
    return runs(spark, d).select("n", "d", F.when(r <= F.greatest(F.lit(1), F.least(k - 1, F.floor(k * 7 / 10))), "train").otherwise("tail").alias("part"))


@query("w9_year_growth", "WITH y AS (SELECT year(o_orderdate) AS y, max(o_totalprice) AS top, avg(o_totalprice) AS mean FROM orders GROUP BY 1) SELECT y, mean, mean / lag(mean) OVER (ORDER BY y) - 1 AS growth FROM y", "mean growth")
def _(spark, d):
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.avg("o_totalprice").alias("mean"))
    return y.withColumn("growth", F.col("mean") / F.lag("mean").over(Window.orderBy("y")) - 1)


@query("w10_normalised", "WITH " + RUNS_SQL + ", x AS (SELECT n, d, loss, first_value(loss) OVER w AS a, last_value(loss) OVER w AS b FROM run WINDOW w AS (PARTITION BY n ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT n, d, CASE WHEN abs(a - b) > 1e-9 THEN (loss - b) / (a - b) END AS y FROM x", "y")
def _(spark, d):
    w = Window.partitionBy("n").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = F.first("loss").over(w), F.last("loss").over(w)
    x = runs(spark, d).select("n", "d", "loss", a.alias("a"), b.alias("b"))
    return x.select("n", "d", F.when(F.abs(F.col("a") - F.col("b")) > 1e-9, (F.col("loss") - F.col("b")) / (F.col("a") - F.col("b"))).alias("y"))


@query("w11_state_changes", "WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(*) FILTER (before IS NOT NULL AND before <> event_type) AS changes FROM x GROUP BY user_id")
def _(spark, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", (before != F.col("event_type")).alias("c")).groupBy("user_id").agg(F.count_if("c").alias("changes"))


_W12 = "WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT user_id, string_agg(event_type, '>' ORDER BY r) AS s FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY r) AS b FROM o) WHERE b IS NULL OR b <> event_type GROUP BY 1), c AS (SELECT user_id, string_agg(event_type, '>' ORDER BY r) AS s FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY r) AS b FROM o WHERE r % 2 = 1) WHERE b IS NULL OR b <> event_type GROUP BY 1) SELECT user_id, f.s = c.s AS same_signature FROM f JOIN c USING (user_id)"


@query("w12_scan_signature", _W12)
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("r")
    rows = table(spark, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    def signature(x, name):
        kept = x.withColumn("b", F.lag("event_type").over(w)).where("b is null or b <> event_type")
        return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda s: s["event_type"]), ">").alias(name))
    return signature(rows, "f").join(signature(rows.where("r % 2 = 1"), "c"), "user_id").select("user_id", (F.col("f") == F.col("c")).alias("same_signature"))


@query("w14_contiguous_folds", "SELECT c_custkey, ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS fold FROM customer")
def _(spark, d):
    return resample.contiguous_folds(table(spark, d, "customer"), "c_custkey", 5, ["c_mktsegment"]).select("c_custkey", F.col("fold").cast("long").alias("fold"))


@query("w15_runner_up_gap", "WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, max(o_totalprice) FILTER (r = 1) - max(o_totalprice) FILTER (r = 2) AS gap FROM r WHERE r <= 2 GROUP BY 1", "gap")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    x = table(spark, d, "orders").withColumn("r", r).where("r <= 2")
    return x.groupBy("o_custkey").agg((F.max(F.when(F.col("r") == 1, F.col("o_totalprice"))) - F.max(F.when(F.col("r") == 2, F.col("o_totalprice")))).alias("gap"))


@query("t1_argmin", "SELECT l_returnflag, arg_min(k, (l_extendedprice, k)) AS best FROM (SELECT l_returnflag, l_extendedprice, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1")
def _(spark, d):
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min_by(k, F.struct("l_extendedprice", k)).alias("best"))


@query("u1_union_with_missing", "SELECT 'c' AS src, c_custkey AS key, c_acctbal AS bal, CAST(NULL AS DOUBLE) AS size FROM customer UNION ALL SELECT 'p', p_partkey, NULL, CAST(p_size AS DOUBLE) FROM part")
def _(spark, d):
    a = table(spark, d, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "part").select(F.lit("p").alias("src"), F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("ag30_error_metrics", "WITH x AS (SELECT l_returnflag AS g, l_extendedprice AS y, l_quantity * 1450 AS p FROM lineitem), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS rp FROM x), s AS (SELECT g, corr(ry, rp) AS spearman FROM r GROUP BY g) SELECT g, count(*) AS n, any_value(spearman) AS spearman, sqrt(avg((p - y) * (p - y))) AS rmse, sqrt(avg(power(ln(p) - ln(y), 2))) AS log_rmse, avg(abs(p - y)) AS mae, avg(p - y) AS bias, avg(abs((p - y) / y)) AS mape, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2, corr(y, p) AS pearson FROM x JOIN s USING (g) GROUP BY g", "spearman log_rmse rmse mae bias mape r2 pearson")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1450).alias("p"))
    ranked = stats.spearman(x, ["g"], "y", "p").select("g", F.col("rho").alias("spearman"))
    return x.groupBy("g").agg(*stats.error_metrics(F.col("y"), F.col("p"))).join(F.broadcast(ranked), "g")


@query("f3_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderdate - INTERVAL 2 MONTH AS DATE) AS two_back, (epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 2629800 AS months FROM orders", "months", "two_back")
def _(spark, d):
    o = F.col("o_orderdate")
    months = (o.cast("timestamp").cast("long") - F.lit("1995-01-01 00:00:00").cast("timestamp").cast("long")) / 2629800
    return table(spark, d, "orders").select("o_orderkey", F.date_format(o, "yyyy-MM").alias("month"), F.to_date(F.expr("o_orderdate - interval 2 months")).alias("two_back"), months.alias("months"))


@query("m27_reproduction_diff", "WITH a AS (SELECT l_returnflag AS k, avg(l_discount) AS v FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS k, sum(l_discount) / count(*) AS v FROM lineitem GROUP BY 1) SELECT count(*) AS rows, max(abs(a.v - b.v)) AS largest, max(abs(a.v - b.v)) <= 1e-9 AS ok FROM a FULL JOIN b USING (k)", "largest")
def _(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"))
    return validate.compare(x.agg(F.avg("l_discount").alias("v")), x.agg((F.sum("l_discount") / F.count("*")).alias("v")), "k", "v", 1e-9)
