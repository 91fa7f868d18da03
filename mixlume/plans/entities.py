"""How the given tables stand for the entities of the library, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixlume.functions import expr
from mixlume.sources.io import cut
from mixlume.functions.text import COUNTS, LEAST_WORDS, RATIOS, text_signals

DSIR = ["dsir_books", "dsir_wiki", "dsir_math"]
#: List signals: first element (from 1) and length of their slice of an embedding.
LISTS = {
    "fineweb_edu": (1, 1), "ad_en": (2, 2), "fluency_en": (4, 2), "qurater": (6, 4), "modernbert_professionalism": (10, 6),
    "modernbert_readability": (16, 6), "modernbert_reasoning": (22, 6), "modernbert_cleanliness": (28, 6),
}
RPS = COUNTS + RATIOS
FAMILIES = {"rps": RPS, "dsir": DSIR, "model": list(LISTS)}
METRICS = RPS + DSIR + list(LISTS)
TYPES = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, domain, eleven text signals, three importance scores and eight list signals; documents without an embedding have no list signals and no scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    lists = [F.slice("v", start, n).alias(name) for name, (start, n) in LISTS.items()]
    scores = [F.element_at("v", 34 + k).alias(name) for k, name in enumerate(DSIR)]
    return text_signals(docs, others=["source", "lang"]).join(vectors, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), "lang", *RPS, *scores, *lists)


def compressed(raw: DataFrame, mode: str = "expectation") -> DataFrame:
    """Scalar, transformed signals: log counts, signed log importance scores, list signals by expectation or argmax."""
    pick = expr.expected_class if mode == "expectation" else expr.argmax_class
    rest = [c for c in raw.columns if c not in METRICS]
    return raw.select(*rest, *[expr.log_count(F.col(c)).alias(c) for c in COUNTS], *RATIOS, *[expr.signed_log(F.col(c)).alias(c) for c in DSIR], *[pick(F.col(c)).alias(c) for c in LISTS])


_kept: dict[tuple, DataFrame] = {}
_STATED = ("documents", "embeddings", "lineitem", "part", "orders")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and time of change of the tables that kept stages are made from, as their file system tells."""
    jvm = spark.sparkContext._jvm
    out = []
    for name in _STATED:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            summary = fs.getContentSummary(path)
            out.append((name, summary.getLength(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def keep(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What make() gives, written once for each session and state of the input's files: stages of the scoring pipeline are tables that many queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    if key not in _kept:
        _kept[key] = cut(make(), name)
    return _kept[key]


def forget() -> None:
    _kept.clear()


def signals(spark: SparkSession, sf_dir: str, mode: str = "expectation") -> DataFrame:
    return keep(spark, sf_dir, f"signals-{mode}", lambda: compressed(keep(spark, sf_dir, "raw", lambda: raw_signals(spark, sf_dir)), mode))


def _sql_list(name: str, mode: str) -> str:
    start, n = LISTS[name]
    v = f"list_slice(v, {start}, {start + n - 1})"
    if n == 1:
        return f"v[{start}]"
    if mode == "argmax":
        return f"CAST(list_position({v}, list_max({v})) - 1 AS DOUBLE)"
    e = f"list_transform({v}, lambda x: exp(x - list_max({v})))"
    return f"list_sum(list_transform({e}, lambda x, i: x * (i - 1))) / list_sum({e})"


def signals_sql(mode: str = "expectation") -> str:
    """The SQL of signals(), as WITH entries ending in ``sig``."""
    ratio = lambda x: f"CASE WHEN n >= {LEAST_WORDS} THEN {x} END"
    return f"""
d0 AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
d1 AS (SELECT *, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars FROM d0),
g1 AS (SELECT doc_id, n, unnest(ws) AS g FROM d1),
c1 AS (SELECT doc_id, -sum((c / n) * ln(c / n)) AS entropy FROM (SELECT doc_id, n, g, CAST(count(*) AS DOUBLE) AS c FROM g1 GROUP BY ALL) GROUP BY doc_id),
g2 AS (SELECT doc_id, unnest(list_transform(list_zip(list_slice(ws, 1, n - 1), list_slice(ws, 2, n)), lambda z: z[1] || ' ' || z[2])) AS g FROM d1 WHERE n > 1),
c2 AS (SELECT doc_id, max(CASE WHEN c > 1 THEN c * length(replace(g, ' ', '')) ELSE 0 END) AS top2 FROM (SELECT doc_id, g, count(*) AS c FROM g2 GROUP BY ALL) GROUP BY doc_id),
g3 AS (SELECT doc_id, unnest(list_transform(list_zip(list_slice(ws, 1, n - 2), list_slice(ws, 2, n - 1), list_slice(ws, 3, n)), lambda z: z[1] || ' ' || z[2] || ' ' || z[3])) AS g FROM d1 WHERE n > 2),
c3 AS (SELECT doc_id, max(CASE WHEN c > 1 THEN c * length(replace(g, ' ', '')) ELSE 0 END) AS top3 FROM (SELECT doc_id, g, count(*) AS c FROM g3 GROUP BY ALL) GROUP BY doc_id),
ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
raw AS (SELECT doc_id AS id, source AS domain, lang, v, CAST(n AS DOUBLE) AS wc, CAST(length(regexp_replace(t, '[^.!?]', '', 'g')) AS DOUBLE) AS ns,
    {ratio('round(entropy, 9)')} AS rps_doc_unigram_entropy, {ratio('len(list_distinct(ws)) / n')} AS rps_doc_frac_unique_words,
    {ratio("len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]'))) / n")} AS rps_doc_frac_no_alph_words,
    {ratio('top2 / chars')} AS rps_doc_frac_chars_top_2gram, {ratio('top3 / chars')} AS rps_doc_frac_chars_top_3gram, {ratio('chars / n')} AS rps_doc_mean_word_length,
    {ratio("length(regexp_replace(t, '[^A-Z]', '', 'g')) / length(t)")} AS rps_lines_uppercase_letter_fraction,
    {ratio("len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]$'))) / len(ls)")} AS rps_lines_ending_with_terminal_punctution_mark,
    {ratio("length(regexp_replace(t, '[^0-9]', '', 'g')) / length(t)")} AS rps_lines_numerical_chars_fraction
  FROM d1 LEFT JOIN c1 USING (doc_id) LEFT JOIN c2 USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN ve ON vec_id = doc_id),
sig AS (SELECT id, domain, lang, ln(1 + greatest(wc, 0)) AS rps_doc_word_count, ln(1 + greatest(ns, 0)) AS rps_doc_num_sentences, {', '.join(RATIOS)},
    {', '.join(f'sign(v[{34 + k}]) * ln(1 + abs(v[{34 + k}])) AS {c}' for k, c in enumerate(DSIR))}, {', '.join(f'{_sql_list(c, mode)} AS {c}' for c in LISTS)} FROM raw)"""


def long_sql(source: str = "sig", ids: str = "id, domain", metrics: list[str] | None = None) -> str:
    """SELECT of ids, metric, value for each metric of a wide table, missing values too."""
    return " UNION ALL ".join(f"SELECT {ids}, '{m}' AS metric, {m} AS value FROM {source}" for m in metrics or METRICS)


#: Each mean loss: its column and how many micro-units make one of the loss.
_MEANS = {"loss_a": ("l_discount", 1e6), "loss_b": ("l_tax", 1e6), "loss_c": ("l_quantity", 5e7), "loss_d": ("l_extendedprice", 1e11)}


def _micros(column: str) -> Column:
    """A column of decimal numbers as whole millionths (NULL for NaN and infinity): sums are exact in any order, so means that meet a limit or each other do so in any engine."""
    return F.round(F.col(column) * 1e6).try_cast("long")


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx (customer), revenue share of each part type, four mean losses and the number of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("idx"))
    joined = lines.join(parts, "l_partkey").join(orders, "l_orderkey")
    price = _micros("l_extendedprice")
    sold = F.sum(price).cast("double")
    shares = [(F.sum(F.when(F.col("p_type") == t, price).otherwise(0)).cast("double") / sold).alias(f"mix_{t.lower()}") for t in TYPES]
    losses = [(F.sum(_micros(c)).cast("double") / (unit * F.count(_micros(c)).cast("double"))).alias(name) for name, (c, unit) in _MEANS.items()]
    return joined.groupBy("idx").agg(*shares, *losses, F.count("*").alias("n_lines"))


MIX = [f"mix_{t.lower()}" for t in TYPES]
LOSSES = ["loss_a", "loss_b", "loss_c", "loss_d"]
_MICROS_SQL = "TRY_CAST(round({} * 1e6) AS BIGINT)"
_PRICE_SQL = _MICROS_SQL.format("l_extendedprice")
RECIPES_SQL = f"""
rec AS (SELECT o_custkey AS idx, {', '.join(f"CAST(sum(CASE WHEN p_type = '{t}' THEN {_PRICE_SQL} ELSE 0 END) AS DOUBLE) / CAST(sum({_PRICE_SQL}) AS DOUBLE) AS mix_{t.lower()}" for t in TYPES)},
    {', '.join(f"CAST(sum({_MICROS_SQL.format(c)}) AS DOUBLE) / ({unit:.0e} * CAST(count({_MICROS_SQL.format(c)}) AS DOUBLE)) AS {name}" for name, (c, unit) in _MEANS.items())}, count(*) AS n_lines
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, model, day, t (months since 1995), kind, developer, log_n, score in [0, 100]: all versions of all models."""
    orders = table(spark, sf_dir, "orders")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    seconds = F.col("o_orderdate").cast("timestamp").cast("long") - F.lit("1995-01-01 00:00:00").cast("timestamp").cast("long")
    return orders.join(owners, "o_custkey").select(
        F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("model"), F.to_date("o_orderdate").alias("day"), (seconds / 2629800).alias("t"), F.col("o_orderstatus").alias("kind"),
        F.col("c_nationkey").alias("developer"), F.log10(F.abs("c_acctbal") + 1).alias("log_n"), F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("score"), F.col("o_orderpriority").alias("licence"),
    )


SUBMISSIONS_SQL = """
sub AS (SELECT o_orderkey AS row_no, o_custkey AS model, CAST(o_orderdate AS DATE) AS day, (epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 2629800 AS t, o_orderstatus AS kind,
    c_nationkey AS developer, log10(abs(c_acctbal) + 1) AS log_n, least(100.0, o_totalprice / 5000) AS score, o_orderpriority AS licence FROM orders JOIN customer ON c_custkey = o_custkey)"""


def latest(sub: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The last version of each model: latest day, then highest row number."""
    w = Window.partitionBy(*(key or ["model"])).orderBy(F.desc("day"), F.desc("row_no"))
    return sub.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n (size), d (tokens), loss: training points; equal (n, d) are averaged."""
    lines = table(spark, sf_dir, "lineitem")
    points = lines.select(F.col("l_quantity").alias("n"), F.round(F.col("l_extendedprice") / 1000, 1).alias("d"), (1 + F.col("l_discount") + 3 / F.col("l_quantity")).alias("loss"))
    return points.where("n > 0 and d > 0").groupBy("n", "d").agg(F.avg("loss").alias("loss"))


RUNS_SQL = "run AS (SELECT l_quantity AS n, round(l_extendedprice / 1000, 1) AS d, avg(1 + l_discount + 3 / l_quantity) AS loss FROM lineitem WHERE l_quantity > 0 AND round(l_extendedprice / 1000, 1) > 0 GROUP BY 1, 2)"
